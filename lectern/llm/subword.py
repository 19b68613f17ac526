"""Whole-document subword encoding through the public tokenizer libraries.

A document's ids are the concatenation of the ids of its white-space chunks
wherever the tokenizer can't join symbols across that chunk border.  Chunks
repeat, documents don't, so each worker keeps the ids of recent chunks and asks
the library only for new ones.  A text in which a border might not hold is
given to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm.common import release

#: Characters that some tokenizers take for white space although ASCII doesn't.
_ODD_SPACE = re.compile(rb"[\x02\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Opens a byte-level chunk that no space stands before; byte-level texts that hold
#: it go the long way.
_JOINED = "\x02"
#: The same in RE2's form, or a space between two other blanks: there, single
#: spaces are no borders.
_WIDE = (r"[\t-\r ] [\t-\r ]|[\x02\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_SPACED = re.compile(rb"[\x09-\x0d ]*[^\x09-\x0d ]+|[\x09-\x0d ]+")

# Chunks of these characters alone are cut into the tokenizers' pre-tokens here:
# Latin letters that no normalisation changes but for their case, digits, and
# ASCII signs but the apostrophe, which opens contractions, and what could open a
# special token.
_L, _N, _P = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", "0-9", r"!-&(-/:;=-@\[-`{}~"
_WORD_PLAIN = re.compile(f"[{_L}{_N}{_P}]+")
_WORD_PARTS = re.compile(f"[{_L}]+|[{_N}]|[{_P}]+")
_BYTE_PLAIN = re.compile(f" ?[{_L}{_N}{_P}]+(?:\n[{_L}{_N}{_P}]+)*")
_BYTE_PARTS = re.compile(f" ?[{_L}]+| ?[{_N}]+| ?[{_P}]+|\n")
#: A chunk of letters alone, in RE2's form: most are, and each is one pre-token.
_LETTERS = "^ ?[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}]+$"

#: Chunks that a worker remembers, in each of two generations.
REMEMBERED = 100_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 ones for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, more = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + more)
            more += 1
    return [table[b] for b in range(256)]


class _Recent:
    """Values by key in two generations: a full young one replaces the old."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def ensure(self, keys: set | list, make) -> dict:
        """A mapping that holds every one of ``keys``, each once; ``make(list)`` gives the
        values of those not remembered."""
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        if new:
            young.update(zip(new, make(new)))
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return young


    def forget(self) -> None:
        """Between tasks only the young generation stays."""
        self.old = {}


class LibraryEncoder:
    """Ids by the ``tokenizers`` library, as little-endian uint32 bytes.

    ``spaces_dropped``: the tokenizer lower-cases, drops white space and never
    joins symbols across it; otherwise it is of the byte-level kind, whose
    pre-tokens start with the space before a word.
    """

    def __init__(self, path: str, spaces_dropped: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.spaces_dropped = spaces_dropped
        self.chunks, self.firsts, self.parts = (_Recent(n) for n in (remembered, remembered // 10, remembered))
        self.shown = byte_characters()

    def forget(self) -> None:
        for recent in (self.chunks, self.firsts, self.parts):
            recent.forget()
        release()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, parts: list[str]) -> list[bytes]:
        """The ids of pre-tokens by the library's model."""
        ids, ends, shown, tokenize = [], [0], self.shown, self.model.tokenize
        for p in parts:
            if not p.isascii() or p == "\n":
                p = "".join([shown[b] for b in p.encode()])
            elif p[0] == " ":
                p = shown[32] + p[1:]
            ids += [t.id for t in tokenize(p)]
            ends.append(len(ids))
        raw = array("I", ids).tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(ends, ends[1:])]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        dropped = self.spaces_dropped
        plain, parts = (_WORD_PLAIN.fullmatch, _WORD_PARTS.findall) if dropped else (_BYTE_PLAIN.fullmatch, _BYTE_PARTS.findall)
        letters = pc.match_substring_regex(pa.array(chunks, pa.string()), _LETTERS).to_numpy(zero_copy_only=False)
        out: list = [None] * len(chunks)
        alone = np.flatnonzero(letters).tolist()
        words = [chunks[k] for k in alone]
        for k, ids in zip(alone, self._part([w.lower() for w in words] if dropped else words)):
            out[k] = ids
        others = np.flatnonzero(~letters).tolist()
        cut = [(parts(chunks[k].lower() if dropped else chunks[k]) if plain(chunks[k]) else None) for k in others]
        got = self.parts.ensure({p for c in cut if c for p in c}, self._part).__getitem__
        for k, c in zip(others, cut):
            out[k] = self._whole(chunks[k]) if c is None else b"".join(map(got, c))
        return out

    def _lookup(self, flat: pa.Array, recent: _Recent, source=None) -> tuple[np.ndarray, memoryview]:
        """The ids of all chunks behind one another, and where each begins;
        ``source`` gives the text that a chunk stands for."""
        coded = flat.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        got = recent.ensure(keys, lambda new: self._encode([source(k) for k in new] if source else new))
        values = pa.array([got[k] for k in keys], pa.binary()).take(coded.indices)
        _, offsets, data = values.buffers()
        return np.frombuffer(offsets, np.int32)[: len(values) + 1], memoryview(data) if data is not None else memoryview(b"")

    def encode(self, datas: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8 bytes), whole texts in and out."""
        if not datas:
            return []
        texts = pa.array([d.decode("utf-8", "replace") for d in datas], pa.string())
        if self.spaces_dropped:
            # a sign at a word's end is a pre-token of its own, but not behind the
            # dotted capital I: its small form ends in a mark, which keeps the sign
            texts = pc.replace_substring_regex(texts, pattern=r"([^\PL\x{130}])([.,])(\s|$)", replacement=r"\1 \2\3")
            lists = pc.ascii_split_whitespace(texts)
            begin, ids = self._lookup(lists.flatten(), self.chunks)
            at = begin[np.asarray(lists.offsets)].tolist()
            return [bytes(ids[a:b]) for a, b in zip(at, at[1:])]
        wide = pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False)
        # a sign at a word's end and a lone line end are pre-tokens of their own
        texts = pc.replace_substring_regex(texts, pattern=r"(\pL)([.,])(\s|$)", replacement=rf"\1 {_JOINED}\2\3")
        texts = pc.replace_substring_regex(texts, pattern=r"(\S)\n(\S)", replacement=f"\\1 {_JOINED}\n {_JOINED}\\2")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        flat = lists.flatten()
        begin, ids = self._lookup(flat, self.chunks, lambda k: k[1:] if k[:1] == _JOINED else " " + k)
        heads = flat.take(pa.array(offsets[:-1])).to_pylist()
        first = self.firsts.ensure(set(heads), lambda new: self._encode(new))
        rest = zip(begin[offsets[:-1] + 1].tolist(), begin[offsets[1:]].tolist())
        out = [first[h] + bytes(ids[a:b]) for h, (a, b) in zip(heads, rest)]
        for k in np.flatnonzero(wide).tolist():
            out[k] = self._spaced(datas[k])
        return out

    def _spaced(self, data: bytes) -> bytes:
        """A text with runs of blanks: they belong to the chunk behind them."""
        if _ODD_SPACE.search(data):
            return self._whole(data.decode("utf-8", "replace"))
        return b"".join(self._encode([c.decode("utf-8", "replace") for c in _SPACED.findall(data)]))


class PieceEncoder:
    """Ids and original byte spans by the ``sentencepiece`` library.

    Normalisation is redone here by longest-prefix steps through the model's
    compiled character map, keeping for every normalised byte the place in the
    source that it came from; pieces then project to source spans.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        self.norm = AlignedNormalizer(spec.precompiled_charsmap, spec.add_dummy_prefix,
                                      spec.remove_extra_whitespaces)
        byte = pb.ModelProto.SentencePiece.BYTE
        self.size = np.asarray([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.unk = self.sp.unk_id()
        # Before a space a text can be cut if nothing is rewritten and no piece has
        # the space sign behind another character; the library itself then puts
        # the sign before each part.
        self.chunked = (not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
                        and not any("▁" in p.piece.lstrip("▁") for p in model.pieces))
        self.eos = self.sp.eos_id()
        self.recent = _Recent(remembered)

    def _sizes(self, normed: bytes, ids: np.ndarray) -> np.ndarray:
        """The normalised bytes that each id stands for."""
        if not (ids == self.unk).any():
            return self.size[ids]
        # an unknown piece has the length of what it stands for
        pieces = self.sp.encode(normed.decode("utf-8", "replace"), out_type="immutable_proto").pieces
        return np.asarray([len(p.surface.encode()) for p in pieces], np.int32) if len(pieces) == len(ids) else self.size[ids]

    def _ids(self, datas: list[bytes], texts: pa.Array) -> list[np.ndarray]:
        if not self.chunked:
            return [np.asarray(x, np.int32) for x in self.sp.encode(texts.to_pylist(), num_threads=1)]
        whole = pc.match_substring_regex(texts, "^ | {2}| $|^$|▁").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        got = self.recent.ensure(set(keys), lambda new: [array("i", x).tobytes() for x in self.sp.encode(new, num_threads=1)])
        values = pa.array([got[k] for k in keys], pa.binary()).take(coded.indices)
        _, offsets, raw = values.buffers()
        begin = np.frombuffer(offsets, np.int32)[: len(values) + 1] // 4
        ids = np.frombuffer(raw, np.int32) if raw is not None else np.empty(0, np.int32)
        at = begin[np.asarray(lists.offsets)].tolist()
        out = [ids[a:b] for a, b in zip(at, at[1:])]
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.asarray(self.sp.encode(texts[k].as_py()), np.int32)
        return out

    def encode(self, datas: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids with the end id last, and for each id the
        begin and end of its span in the text's UTF-8 bytes."""
        if not datas:
            return []
        out = []
        for data, ids in zip(datas, self._ids(datas, pa.array([d.decode("utf-8", "replace") for d in datas], pa.string()))):
            begin, end = self.norm.spans(data, lambda normed: self._sizes(normed, ids)) if len(ids) else (ids, ids)
            stop = np.int32([len(data)])
            out.append((np.append(ids, np.int32(self.eos)), np.concatenate((begin, stop)), np.concatenate((end, stop))))
        return out


class AlignedNormalizer:
    """Normalised bytes and, for each of them, the begin and the end of the source
    bytes that it comes from.

    ``charsmap``: a compiled character map, a double-array trie (public
    darts-clone layout: one uint32 a unit) followed by the zero-ended
    replacement strings; empty for the identity.  At each place the longest
    prefix in the trie is replaced, else one character is kept (an invalid
    byte becomes U+FFFD).
    """

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, strip: bool = False):
        self.units, self.pool = None, b""
        if charsmap:
            n = int.from_bytes(charsmap[:4], "little")
            self.units = np.frombuffer(charsmap[4:4 + n], "<u4").tolist()
            self.pool = charsmap[4 + n:]
        self.dummy_prefix, self.strip = dummy_prefix, strip

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest entry at ``at``; (0, 0) if none."""
        units, best = self.units, (0, 0)
        pos = self._step(units[0])
        for k in range(at, len(data)):
            pos ^= data[k]
            if pos >= len(units) or units[pos] & 0x800000FF != data[k]:
                break
            unit = units[pos]
            pos ^= self._step(unit)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[pos] & 0x7FFFFFFF)
        return best

    def _char(self, data: bytes, at: int) -> tuple[int, bytes]:
        first = data[at]
        n = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4 if first >> 3 == 30 else 0
        one = data[at:at + n]
        try:
            one.decode("utf-8")
        except UnicodeDecodeError:
            n = 0
        return (n, one) if n else (1, b"\xef\xbf\xbd")

    def _plain(self, data: bytes) -> list[tuple[bytes, int, int]]:
        """(new bytes, source begin, source end) in order."""
        out, at = [], 0
        while at < len(data):
            n, place = self._longest(data, at) if self.units else (0, 0)
            if n:
                new = self.pool[place:self.pool.index(b"\0", place)]
            else:
                n, new = self._char(data, at)
            out.append((new, at, at + n))
            at += n
        return out

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        if self.units is None and not self.strip and (plain := self._identity(data)):
            return plain
        out, begins, ends = bytearray(), [], []

        def put(new: bytes, begin: int, end: int) -> None:
            out.extend(new)
            begins.extend([begin] * len(new))
            ends.extend([end] * len(new))

        sign, steps, lead = b"\xe2\x96\x81", self._plain(data), 0
        if self.strip:  # spaces at both ends go, runs of them become one
            while steps and not steps[0][0].strip(b" "):
                lead = steps.pop(0)[2]
        if self.dummy_prefix and (steps or not self.strip):
            put(sign, lead, lead)
        blank = self.strip
        for new, begin, end in steps:
            for k in range(len(new)):
                c = new[k:k + 1]
                if c != b" ":
                    put(c, begin, end)
                    blank = False
                elif not (self.strip and blank):
                    put(sign, begin, end)
                    blank = True
        while self.strip and out.endswith(sign) and len(out) > len(sign):
            del out[-3:], begins[-3:], ends[-3:]
        return bytes(out), np.asarray(begins, np.int32), np.asarray(ends, np.int32)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray] | None:
        """Without a map only spaces change; none for text that isn't UTF-8."""
        sign, raw = b"\xe2\x96\x81", np.frombuffer(data, np.uint8)
        wide = np.where(raw == 32, 3, 1)
        n = np.arange(len(data), dtype=np.int32)
        begin, end = n, n + np.int32(1)
        if not data.isascii():
            try:
                data.decode("utf-8")
            except UnicodeDecodeError:
                return None
            opens = (raw & 0xC0) != 0x80
            first = np.flatnonzero(opens).astype(np.int32)
            which = np.cumsum(opens) - 1
            begin, end = first[which], np.append(first[1:], np.int32(len(data)))[which]
        lead = np.zeros(3 if self.dummy_prefix else 0, np.int32)
        return ((sign if self.dummy_prefix else b"") + data.replace(b" ", sign),
                np.concatenate((lead, np.repeat(begin, wide))), np.concatenate((lead, np.repeat(end, wide))))

    def spans(self, data: bytes, sizes) -> tuple[np.ndarray, np.ndarray]:
        """The source spans of consecutive pieces; ``sizes(normed)`` gives the
        normalised bytes of each."""
        normed, begins, ends = self(data)
        stops = np.minimum(np.cumsum(sizes(normed)), len(normed))
        starts = np.concatenate(([0], stops[:-1]))
        return begins[np.minimum(starts, len(normed) - 1)], ends[np.maximum(stops - 1, 0)]
