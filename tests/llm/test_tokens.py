"""Encoding, files of records, packing: all against the tokenizer libraries on whole texts."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import TEXTS, docs, table_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing, pieces, queries, records
from lectern.llm.queries import tokenizer_path
from lectern.llm.subword import AlignedNormalizer, LibraryEncoder, PieceEncoder

WORD, BYTE, PIECE = (tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = st.text(st.sampled_from("aAbz09 '\t\n.é ▁\u00a0\u2003\u0301ß\x1c\x85日😀<|>sİ.,Σ"), max_size=60)


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    return {p: (LibraryEncoder(p, p == WORD), Tokenizer.from_file(p)) for p in (WORD, BYTE)}


@given(st.lists(ODD, max_size=4))
@settings(max_examples=150, deadline=None)
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_encode_as_whole_texts(coders, path, texts):
    own, whole = coders[path]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == want


CONTROL = st.text(st.sampled_from([chr(c) for c in range(32)] + list("ab. é\x7f")), max_size=20)


@given(st.lists(CONTROL, max_size=4))
@settings(max_examples=150, deadline=None)
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_control_characters_encode_as_whole_texts(coders, path, texts):
    own, whole = coders[path]
    texts = [*texts, "\x02abc def", "\x02", "a \x02 b", "x\n\x02y. \x02"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == want


SIGNS = st.lists(st.sampled_from(["İ", "İ.", "İ,", "aİ.", "i\u0307.", "I.", "ı,", "ǅ.", "ΑΣ.", "ß,", "é.", "e\u0301.", ".", ",", "ẞ.", "ŉ.", "ﬁ,", "x."]), max_size=6)


@given(SIGNS)
@settings(max_examples=300, deadline=None)
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_signs_behind_odd_letters_encode_as_whole_texts(coders, path, words):
    own, whole = coders[path]
    texts = [" ".join(words), "".join(words), "İ.", "İ, x. İ.", "x"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == want


PIECES = PieceEncoder(PIECE, remembered=50)


@given(st.lists(ODD, max_size=4))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_as_whole_texts(texts):
    for t, (ids, begins, ends) in zip(texts, PIECES.encode([t.encode() for t in texts])):
        assert ids.tolist() == PIECES.sp.encode(t) + [PIECES.eos]
        check_spans(t.encode(), ids, begins, ends)


def check_spans(data, ids, begins, ends):
    """Spans are in order and cover the text; the plain pieces stand there."""
    assert len(ids) == len(begins) == len(ends) and (begins <= ends).all()
    at = 0
    for i, b, e in zip(ids[:-1].tolist(), begins.tolist(), ends.tolist()):
        assert b <= at <= max(e, at)
        at = max(at, e)
        if not PIECES.sp.is_byte(i) and not PIECES.sp.is_unknown(i):
            piece = PIECES.sp.id_to_piece(i).replace("▁", " ").encode()
            got = data[b:e].replace("▁".encode(), b" ")
            assert got == piece or b == 0 and b" " + got == piece
    assert at == len(data) and begins[-1] == ends[-1] == len(data)


@pytest.mark.parametrize("text", ["ﬁne ① ｗｉｄｅ  x", "  a\tb　c ", "", "   ", "Å é ﷺ", "plain ascii text"])
def test_compiled_map_as_the_library_has_it(text):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True,
                                                 escape_whitespaces=True)
    spec = pb.ModelProto.FromString(norm.serialized_model_proto()).normalizer_spec
    own, begins, ends = AlignedNormalizer(spec.precompiled_charsmap, True, True)(text.encode())
    assert own.decode() == norm.normalize(text)
    assert len(begins) == len(ends) == len(own) and (np.diff(begins) >= 0).all() and (begins <= ends).all()


def test_sources_of_normalised_bytes():
    own, begins, ends = AlignedNormalizer(b"", True, False)("a é".encode())
    assert own.decode() == "▁a▁é" and begins.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2] and ends.tolist() == [0, 0, 0, 1, 2, 2, 2, 4, 4]
    slow = AlignedNormalizer(b"", True, False)
    slow._identity = lambda data: None
    for text in ("a é", "", " x  日 ", "plain"):
        for a, b in zip(slow(text.encode()), AlignedNormalizer(b"", True, False)(text.encode())):
            assert np.array_equal(a, b) if not isinstance(a, bytes) else a == b
    assert AlignedNormalizer(b"", True, False)(b"a\xff")[0] == "▁a\ufffd".encode()


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_pieces_of_odd_rows(spark, rows):
    found = pieces.encode_decode(docs(spark, rows), PIECE).collect()
    want = sorted(((i, PIECES.sp.encode(t or "") + [2]) for i, t in rows), key=str)
    assert sorted(((r["id"], r["ids"]) for r in found), key=str) == want
    assert all(r["decoded"] == PIECES.sp.decode(r["ids"]) for r in found)


def test_records_are_framed_and_checked():
    data = records.frame(b"some record")
    assert data[:8] == struct.pack("<Q", 11) and records.unframe(data) == b"some record"
    for k in (0, 9, 14, len(data) - 1):
        with pytest.raises(ValueError):
            records.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1:])


def files_match(df, rows, coders, tmp_path, **options):
    found = [r.asDict() for r in records.encode_to_files(df, WORD, str(tmp_path / "out"), **options).collect()]
    whole = coders[WORD][1]
    ids = [(i, (t or "").encode(), whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, want = 0, []
    for i, _, x in ids:
        want.append((i, start, x))
        start += len(x)
    assert sorted(((r["id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found), key=lambda r: r[1]) == want


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_files_of_odd_rows(spark, coders, tmp_path, rows):
    files_match(docs(spark, rows), rows, coders, tmp_path, shards=5)


def test_starts_behind_a_dotted_capital_i(spark, coders, tmp_path):
    rows = [(1, "İ. and İ, or İ"), (2, "next"), (3, "İ."), (4, "last, word.")]
    files_match(docs(spark, rows), rows, coders, tmp_path, shards=2)


def test_a_repeated_id_goes_over_several_shards(spark, coders, tmp_path):
    """Rows without an id, and rows of one id with one text, aren't left to one shard."""
    rows = [(None, f"text {k:05}") for k in range(600)] + [(5, "same")] * 600 + [(k, "x") for k in range(6, 30)]
    df = docs(spark, rows).repartition(4)
    files_match(df, rows, coders, tmp_path, shards=8)
    per_shard = [r["records"] for r in records.write_shards(df, f"file://{tmp_path}/again", WORD, shards=8).collect()]
    assert sum(per_shard) == len(rows) and max(per_shard) < 400


def test_wide_ids_and_missing_keys_survive():
    for key, ids in ((None, [1, 70_000]), (-3, [65_535, 0]), (7, [])):
        raw = np.asarray(ids, "<u4").tobytes()
        assert records.unpack_record(records.pack_record(key, raw)) == (key, raw)


def test_files_of_the_whole_table(spark, coders, tmp_path):
    df, rows = table_rows(spark)
    files_match(df, rows, coders, tmp_path)


def pack_matches(df, rows, coders, most_padding):
    found = packing.pack(df, BYTE).collect()
    whole = coders[BYTE][1]
    want = sorted(whole.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows)
    docs_, windows = {}, {}
    for r in found:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_to"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
        docs_.setdefault((r["id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    used = padded = 0
    for ps in windows.values():
        at = 0
        for offset, n, to in sorted(ps):
            assert offset == at
            at += n
        assert at <= 1024 and to == (at if at & (at - 1) == 0 else 1024)
        used, padded = used + at, padded + to
    assert used == sum(map(len, want)) and padded - used <= most_padding
    return docs_, want


def test_packing_of_odd_rows(spark, coders):
    rows = [r for r in TEXTS if r[0] is not None and r[0] not in (12, 13)]
    got, want = pack_matches(docs(spark, rows).coalesce(1), rows, coders, 1024)
    whole = []
    for (_, total), parts in got.items():
        ids = [x for _, p in sorted(parts) for x in p]
        assert len(ids) == total
        whole.append(ids)
    assert sorted(whole) == want
    pack_matches(docs(spark), TEXTS, coders, 1024 * 8)
    assert packing.pack(docs(spark, []), BYTE).collect() == []


def test_packing_of_the_whole_table(spark, coders):
    df, rows = table_rows(spark)
    got, want = pack_matches(df, rows, coders, 1024 * 8)
    assert sorted([x for _, p in sorted(parts) for x in p] for parts in got.values()) == want


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    p = packing.Packer(window=32, max_open=10_000)
    for k in range(500):
        size = int(rng.integers(1, 32))

        def after(h):
            n = p.count.copy()
            n[h] -= h > 0
            if h + size < 32:
                n[h + size] += 1
            return int((n[:32].astype(int) ** 2)[1:].sum())

        options = [h for h in range(32 - size + 1) if h == 0 or p.count[h]]
        assert after(p.level_for(size)) == min(map(after, options))
        p.place((k, 0, b"\0\0\0\0" * size, size), size)


@pytest.mark.parametrize("sizes", [[600] * 50, [1], [31] * 3, [513, 511], list(range(1, 200))])
def test_closing_leaves_one_window_open(sizes):
    p = packing.Packer(max_open=20)
    for k, n in enumerate(sizes):
        p.add(k, struct.pack("<I", k) * n)
    p.close()
    assert sum(map(len, p.open)) <= 1
    bins = p.done + [b for x in p.open for b in x]
    got = {}
    for b in bins:
        assert sum(len(x[2]) for x in b) <= 4096
        for id_, start, ids, total in b:
            got.setdefault(id_, []).append((start, ids))
    for k, n in enumerate(sizes):
        at = 0
        for start, ids in sorted(got[k]):
            assert start == at
            at += len(ids) // 4
        assert at == n


def test_checksums_are_of_the_ids(spark):
    assert zlib.crc32(struct.pack("<2I", 5, 0)) == spark.range(1).selectExpr("crc32(X'0500000000000000') as c").first()["c"]


def test_spans_of_the_query_cover_the_texts(spark):
    """The query's spans are those of the aligned encoding: in order, within the text,
    and every character that is no blank lies in one."""
    sf = "/root/testdata/sf0.001"
    df, rows = table_rows(spark)
    found = {r["id"]: r for r in pieces.encode_decode(df, PIECE).collect()}
    got = {r["doc_id"]: r["spans_sha256"] for r in queries.op10_sentencepiece(spark, sf).collect()}
    for i, text in rows:
        data, r = (text or "").encode(), found[i]
        spans = list(zip(r["begins"], r["ends"]))
        assert got[i] == hashlib.sha256(" ".join(f"{a}:{b}" for a, b in spans).encode()).hexdigest()
        assert spans[-1] == (len(data), len(data)) and all(0 <= a <= b <= len(data) for a, b in spans)
        assert r["begins"] == sorted(r["begins"])
        held = bytearray(len(data))
        for a, b in spans:
            held[a:b] = b"\1" * (b - a)
        assert not any(c > 32 and not h for c, h in zip(data, held))


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_words_of_letters_reach_the_model_as_they_are(kind, monkeypatch):
    """Chunks of letters aren't matched one by one, and the letters are those of
    the patterns that take chunks apart."""
    import public_tokenizers
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    from lectern.llm import subword

    class Never:
        def fullmatch(self, text):
            raise AssertionError(text)

        findall = fullmatch

    signs = [chr(c) for c in range(0x300)]
    letters = pc.match_substring_regex(pa.array(signs), subword._LETTERS).to_pylist()
    assert letters == [re.fullmatch(f"[{subword._L}]", c) is not None for c in signs]
    path = public_tokenizers.path("word_bpe_49k.json" if kind == "word" else "byte_bpe_50k.json")
    for name in ("_WORD_PLAIN", "_WORD_PARTS", "_BYTE_PLAIN", "_BYTE_PARTS"):
        monkeypatch.setattr(subword, name, Never())
    texts = ["Some plain Words", "wörds ÄÉß Ǆ and ɏ", "a", ""]
    got = subword.LibraryEncoder(path, spaces_dropped=kind == "word").encode([t.encode() for t in texts if t])
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts if t]
