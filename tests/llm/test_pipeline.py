import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import test_simhash
import test_suffixes
from helpers import TEXTS, docs

from lectern.llm import common, exact, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def labels(spark, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_each_stage_on_odd_rows(spark, tmp_path, rows):
    sf, before = labels(spark, tmp_path), docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.dtypes == before.dtypes, name
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "suffix-array dedup":
            assert after.exceptAll(before).count() == 0, name
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf).count() >= before.count()


def test_what_stages_drop(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r["doc_id"], r["text"]) for r in stages["exact dedup"](spark, docs(spark), "").collect()]
    assert sorted(i for i, _ in kept if i is not None) == [-5, 1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 12, 13, 14, 15, 16, 17]
    assert len([t for i, t in kept if i is None]) == 1  # the passage without an id is a copy of 8
    near = [r["doc_id"] for r in stages["simhash near-dedup"](spark, docs(spark), "").collect()]
    assert near.count(13) == 1 and 3 not in near and 7 not in near and 6 in near
    cut = {r["doc_id"]: r for r in stages["suffix-array dedup"](spark, docs(spark, [t for t in TEXTS if t[0] in (8, 9, 10)]), "").collect()}
    assert cut[9]["text"] == "before it.  and after" and cut[9]["n_chars"] == 21 and cut[10]["text"].startswith("日本語") and cut[8]["n_chars"] == 84


def test_run_returns_all_pieces(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    per_doc = got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert per_doc and all(r["sum(length)"] == r["max(doc_tokens)"] for r in per_doc)


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "suffix-array dedup", "packing"]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_one_row_of_an_id_and_text_stays(spark, monkeypatch, most):
    """By broadcast and by shuffle; null ids, repeats, and an id with two texts."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "n"), (None, "n"), (2, "a"), (3, None), (4, ""), (5, "z")]
    df = docs(spark, rows)
    kept = {(1, "a"), (None, "n"), (3, None), (5, "z")}
    found = spark.createDataFrame([(i, t, (i, t) in kept) for i, t in rows], "id long, text string, kept boolean").select(
        "id", common.text_key("text").alias("raw"), "kept")
    got = [(r["doc_id"], r["text"]) for r in common.without_losers(df, found).collect()]
    assert sorted(got, key=str) == sorted(kept, key=str)
    assert common.without_losers(df.limit(0), found.limit(0)).collect() == []


def test_exact_groups_keep_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b")]
    df = docs(spark, rows)
    got = common.without_losers(df, exact.equal_groups(df)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == [(1, "a"), (None, "b")]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents, sf).select("doc_id").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    new = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]  # nothing was learned from these
    toxic, clean = ([i for i, y in new if y == t] for t in (1, 0))
    assert sum(i not in kept for i in toxic) >= 0.9 * len(toxic) > 0
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) > 0


def test_run_equals_brute_force(spark):
    """The kept documents, their cut texts and all ids, stage by stage in plain Python
    behind the fitted scores."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(documents, toxicity.fit(documents, labels)).select("row.doc_id", "row.text", "score").collect()
    rows = [(r["doc_id"], r["text"]) for r in scored if r["score"] < 0.5]
    assert 0 < len(rows) <= len(scored)
    groups = {}
    for i, t in sorted(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), (i, t))
    rows = sorted(groups.values())
    rows = [(i, t) for (i, t), (_, _, least) in zip(rows, sorted(test_simhash.brute_groups(rows))) if i == least]
    cut = {i: (size, begins, ends) for i, size, begins, ends, _ in test_suffixes.brute(rows)}
    tok = Tokenizer.from_file(corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        data, keep = t.encode(), bytearray(b"\1" * len(t.encode()))
        for lo, hi in zip(cut[i][1], cut[i][2]):
            # a character that is cut in part stays whole
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi -= 1
            keep[lo:hi] = b"\0" * (hi - lo)
        left = bytes(c for c, k in zip(data, keep) if k).decode()
        want[i] = np.asarray(tok.encode(left, add_special_tokens=False).ids + [0], "<u4")
    pieces, windows = {}, {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, found in pieces.items():
        at = 0
        for start, length, crc, total in sorted(found):
            assert start == at and total == len(want[i]) and crc == zlib.crc32(want[i][start:start + length].tobytes()), i
            at += length
        assert at == len(want[i])
    for ps in windows.values():
        assert sum(n for _, n in ps) <= 1024 and [o for o, _ in sorted(ps)] == np.cumsum([0, *[n for _, n in sorted(ps)]])[:-1].tolist()
