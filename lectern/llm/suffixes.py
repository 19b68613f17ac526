"""Removal of repeated byte strings by a distributed difference-cover sort.

Asked is, for every string of 50 bytes in a text, whether it also starts in a
text with a smaller id.  Sorting all suffixes by their first 50 bytes answers
that by comparing neighbours; the difference-cover method sorts only a sample
first:

1.  *Sampled triples.*  Positions whose remainder modulo 31 is in a difference
    cover of six are sampled.  For any two positions some shift of at most 30
    moves both into the sample, so two equal strings of 50 bytes contain equal
    sampled strings of 20.  Such a string is a triple of overlapping 8-byte
    words.  The triples are named, sorted and compared with their neighbours
    over all texts; a sample suffix whose name is unique has its rank already
    and takes no further part, nor does any suffix that would need it.
2.  *Recursion on names.*  Names of longer strings are names of triples of
    names.  The remaining sample suffixes are sorted by their 80-byte names.  One that also stands in
    a smaller text has all its strings of 50 answered, and these need not be
    sorted; equal ones in a smaller text speak for them.  A string of 50
    goes 15 bytes or more beyond one end of its sampled string of 20; of the
    sample suffixes with an open string of 50 around them, both these strings
    of 35 are sorted by their names, and most have become unique.
3.  *Merge.*  All open suffixes that hold a remaining string of 35 are sorted by
    their 50-byte names together, neighbours are compared, and all but those of
    the smallest text are marked.

Texts travel once: in blocks of some megabytes, compressed, partitioned by
block.  Every sort moves names only, in the order of a block and bucket, and gets
back one bit for each.  A block sends a name once, however often it has it, so
a name in very many texts is one entry per block.

Names are 64-bit hashes sorted within buckets chosen by an independent hash, so
two different strings are confused with probability 2^-(64 + bits of the number
of buckets); the number of buckets grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, pairs, release, shuffle_partitions

MIN_LENGTH = 50
MODULUS = 31
#: A difference cover: every remainder is a difference of two of these modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
TRIPLE = MIN_LENGTH - MODULUS + 1
LONG = 80
#: What a string of 50 has beyond one end of a sampled string in it, at least.
SIDE = (MODULUS - 1) // 2
#: Bytes of text in a block and, about, behind each bucket of a sort.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20

_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    """The name of a triple of 64-bit values."""
    h = a * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h += _U(salt * 2 + 1)
    h ^= b
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    h ^= c
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(30)
    return h


class _Block:
    """The texts of one block, one behind another, with what is known of them."""

    def __init__(self, blob: bytes, ids: bytes, sizes: bytes):
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = len(raw)
        self.text = np.frombuffer(raw, np.uint8)
        self.words = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(8), np.uint8)[:8].view("<u8"), (n + 1,), (1,))
        self.ids = np.frombuffer(ids, "<i8")
        self.sizes = np.frombuffer(sizes, "<i8")
        self.ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.room = np.repeat(self.ends.astype(np.int32), self.sizes) - np.arange(n, dtype=np.int32)  # bytes to the end of the text
        self.known, rank = np.unique(self.ids, return_inverse=True)
        self.rank = rank.astype(np.int32)

    def _words(self, at: np.ndarray, *shifts: int) -> list[np.ndarray]:
        return [self.words[at + k] for k in shifts]

    def name20(self, at: np.ndarray) -> np.ndarray:
        return _mix(*self._words(at, 0, 8, TRIPLE - 8), 20)

    def name35(self, at: np.ndarray) -> np.ndarray:
        return _mix(_mix(*self._words(at, 0, 8, 16), 24), *self._words(at, 24, TRIPLE + SIDE - 8), 35)

    def name50(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names."""
        parts = _mix(*self._words(at, 0, 8, 16), 24), _mix(*self._words(at, 24, 32, 40), 25), self.words[at + MIN_LENGTH - 8]
        return _mix(*parts, 50), _mix(*parts, 51)

    def name80(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names."""
        parts = [_mix(*self._words(at, k, k + 8, k + 16), k) for k in (0, 24, 48)]
        whole = _mix(*parts, 72), *self._words(at, LONG - 8, LONG - 16)
        return _mix(*whole, 80), _mix(*whole, 81)

    def sample(self) -> np.ndarray:
        """Sampled positions of texts that hold any string of 50 bytes."""
        rows = -(-len(self.text) // MODULUS)
        at = (np.arange(rows)[:, None] * MODULUS + np.asarray(COVER)).ravel()
        at = at[: np.searchsorted(at, len(self.text))]
        return at[(self.room[at] >= TRIPLE) & (self.sizes[self.doc[at]] >= MIN_LENGTH)]


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order; by radix where the numbers are small."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


class _Names:
    """The names of one sort within a block: distinct, dealt to buckets, and each
    with the smallest id that has it here.  The number of buckets is a power of
    two.  Narrow names are dealt by their upper bits, so that buckets and the
    order in them follow the order of the names; others by a second name, and
    stand in the order of the ids."""

    def __init__(self, block: _Block, at: np.ndarray, names: np.ndarray, second: np.ndarray | None, buckets: int):
        self.narrow, self.shift = second is None, 64 - buckets.bit_length() + 1
        self.at = at
        order = np.argsort(names)
        srt = names[order]
        new = np.empty(len(srt), bool)
        new[:1] = True
        np.not_equal(srt[1:], srt[:-1], out=new[1:])
        first = np.flatnonzero(new)
        self.which = np.empty(len(at), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.rank = block.rank[block.doc[at]]
        by_name = self.rank[order]
        self.names = srt[first]
        self.low = np.minimum.reduceat(by_name, first) if len(first) else by_name
        self.known = block.known
        if self.narrow:
            self.alone = (self.low == np.maximum.reduceat(by_name, first)) if len(first) else np.empty(0, bool)
            borders = np.arange(1, buckets, dtype=np.uint64) << _U(self.shift)
            self.deal = np.arange(len(first))
            self.edges = np.concatenate(([0], np.searchsorted(self.names, borders), [len(first)]))
        else:
            bucket = second[order[first]] >> _U(self.shift)
            self.deal = _order(self.low)
            self.deal = self.deal[_order(bucket[self.deal])]
            self.edges = np.searchsorted(bucket[self.deal], np.arange(buckets + 1, dtype=np.uint64))

    def below(self, part: np.ndarray) -> np.ndarray:
        """The 32 bits of narrow names that follow those of the bucket."""
        return (self.names[part] >> _U(self.shift - 32) & _U(0xFFFFFFFF)).astype("<u4")

    def marked(self, bits: dict[int, bytes]) -> np.ndarray:
        """For each distinct name the answer of its bucket."""
        out = np.zeros(len(self.names), bool)
        for b, raw in bits.items():
            part = self.deal[self.edges[b]:self.edges[b + 1]]
            out[part] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(part)).astype(bool)
        return out


def _triples(block: _Block, buckets: int) -> _Names:
    at = block.sample()
    return _Names(block, at, block.name20(at), None, buckets)


def _repeated(names: _Names, bits: dict) -> np.ndarray:
    """Positions whose string stands in more than one text."""
    return names.at[(names.marked(bits) | ~names.alone)[names.which]]


def _longs(block: _Block, buckets: int, repeated: np.ndarray) -> _Names:
    at = repeated[block.room[repeated] >= LONG]
    return _Names(block, at, *block.name80(at), buckets)


def _in_smaller(names: _Names, bits: dict) -> np.ndarray:
    """Positions whose string also stands in a text with a smaller id."""
    return names.at[names.marked(bits)[names.which] | (names.rank > names.low[names.which])]


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of n places whether it is within ``length`` of one of the
    ascending ``starts``."""
    step = np.zeros(n + 1, np.int8)
    if len(starts):
        apart = starts[1:] > starts[:-1] + length
        step[starts[np.r_[True, apart]]] = 1
        step[np.minimum(starts[np.r_[apart, True]] + length, n)] -= 1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


def _open(block: _Block, inner: np.ndarray, reach: int, long_hits: np.ndarray) -> np.ndarray:
    """For each place whether a string of 50 bytes starts there, at most
    ``reach`` bytes before one of ``inner``, that no longer one answers."""
    n = len(block.text)
    near = _covered(n, np.maximum(inner - reach, 0), reach + 1)
    near &= block.room >= MIN_LENGTH
    return near & ~_covered(n, long_hits, LONG - MIN_LENGTH + 1)


def _live(block: _Block, buckets: int, repeated: np.ndarray, long_hits: np.ndarray) -> _Names:
    """The strings of 35 at both sides of sample suffixes, where a string of 50
    that holds one is open."""
    left = repeated[block.sizes[block.doc[repeated]] - block.room[repeated] >= SIDE] - SIDE
    at = np.unique(np.concatenate((repeated, left)))
    at = at[block.room[at] >= TRIPLE + SIDE]
    sums = np.concatenate(([0], np.cumsum(_open(block, repeated, MODULUS - 1, long_hits), dtype=np.int32)))
    at = at[sums[at + 1] > sums[np.maximum(at - SIDE, 0)]]
    return _Names(block, at, block.name35(at), None, buckets)


def _rest(block: _Block, buckets: int, live: np.ndarray, long_hits: np.ndarray) -> _Names:
    at = np.flatnonzero(_open(block, live, SIDE, long_hits))
    return _Names(block, at, *block.name50(at), buckets)


_MESSAGE = "bucket int, block long, ids binary, counts binary, names binary"


def _send(names: _Names, block_id: int) -> pa.RecordBatch | None:
    """One message per bucket.  Narrow ones only tell whether a name is in
    several blocks: 32 further bits of it, which may mark too much but never
    too little.  Others have the name and the smallest id of this block."""
    rows = []
    for b in range(len(names.edges) - 1):
        part = names.deal[names.edges[b]:names.edges[b + 1]]
        if not len(part):
            continue
        ids = counts = b""
        if names.narrow:
            # as differences, byte by byte: the high bytes are nearly all 0
            data = np.diff(names.below(part), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        else:
            own, n = np.unique(names.low[part], return_counts=True)
            ids, counts = np.diff(names.known[own], prepend=0).astype("<i8").tobytes(), n.astype("<u4").tobytes()
            data = names.names[part].astype("<u8").tobytes()
        rows.append((b, block_id, ids, counts, data))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                      names=["bucket", "block", "ids", "counts", "names"])


def _answer_narrow(table: pa.Table) -> pa.Table:
    names = []
    for raw in table.column("names").to_pylist():
        planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
        names.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32))
    every = np.concatenate(names)
    every.sort()
    again = every[1:][every[1:] == every[:-1]]
    again = again[np.r_[True, again[1:] != again[:-1]]] if len(again) else again
    if not len(again):
        return _answers(table, [np.zeros(len(x), bool) for x in names])
    # both sides are sorted
    return _answers(table, [again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x for x in names])


def _answer_wide(table: pa.Table) -> pa.Table:
    names = [np.frombuffer(x, "<u8") for x in table.column("names").to_pylist()]
    owners = [np.repeat(np.cumsum(np.frombuffer(i, "<i8")), np.frombuffer(c, "<u4"))
              for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist())]
    every, owner = np.concatenate(names), np.concatenate(owners)
    order = np.argsort(every)
    srt = every[order]
    new = np.r_[True, srt[1:] != srt[:-1]]
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(owner[order], first)
    later = np.empty(len(every), bool)
    later[order] = owner[order] > np.repeat(low, np.diff(np.r_[first, len(srt)]))
    return _answers(table, np.split(later, np.cumsum([len(x) for x in names])[:-1]))


def _answers(table: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def _sort(messages: DataFrame, buckets: int, narrow: bool) -> DataFrame:
    """Sort the names bucket by bucket, compare neighbours, and gather each
    block's answers."""
    bits = (messages.repartition(buckets, "bucket").groupBy("bucket")
            .applyInArrow(_answer_narrow if narrow else _answer_wide, "block long, bucket int, bits binary"))
    # at most one entry per bucket
    return cut(bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")))


def _blocks(docs: DataFrame, block_bytes: int, partitions: int) -> DataFrame:
    """Texts in blocks, partitioned by block and materialised, with the other
    columns of their rows."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("id", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, k = TaskContext.get().partitionId() << 32, 0
        ids, datas, rest, held = [], [], [], 0

        def out():
            nonlocal ids, datas, rest, held, k
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(datas))
            batch = pa.RecordBatch.from_pylist([{
                "block": part + k, "n": held, "blob": blob, "has_id": np.packbits([i is not None for i in ids]).tobytes(),
                "ids": np.asarray([_NO_ID if i is None else i for i in ids], "<i8").tobytes(),
                "sizes": np.asarray([len(d) for d in datas], "<i8").tobytes(),
                "rest": zstandard.ZstdCompressor().compress(_ipc(rest)) if others else b""}], schema=schema)
            ids, datas, rest, held, k = [], [], [], 0, k + 1
            return batch

        schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("has_id", pa.binary()),
                            ("ids", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for j, (id_, data) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())):
                    ids.append(id_)
                    datas.append(data)
                    held += len(data)
                    if others:
                        rest.append(piece.select(others).slice(j, 1))
                    if held >= block_bytes or len(ids) >= block_bytes // 64:
                        yield out()
        if ids:
            yield out()
        release()

    made = docs.mapInArrow(run, "block long, n long, blob binary, has_id binary, ids binary, sizes binary, rest binary")
    # A checkpoint made under adaptive execution forgets how it is partitioned,
    # and every later join would move the texts again.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(made.repartition(partitions, "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _ipc(parts: list[pa.RecordBatch]) -> bytes:
    table = pa.Table.from_batches(parts).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _each(fn, schema: str):
    """Run ``fn(row)``, which yields record batches, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from fn(batch.slice(k, 1).to_pylist()[0])
        release()

    return lambda df: df.mapInArrow(run, schema)


def _bits(row: dict, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["bits"] for x in row[name] or ()}


def repeated_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                   whole_characters: bool = False) -> DataFrame:
    """``docs(id long, data binary)`` -> ``id``, ``n_bytes``, ``begins`` and ``ends``
    (the maximal removed runs) and ``kept`` (the remaining bytes), one row each;
    further columns of ``docs`` follow unchanged.

    ``whole_characters``: a UTF-8 character of which only some bytes are
    repeated stays.  Rows with one id don't remove from each other; rows without
    an id lose to all others and remove from none.  Empty texts, and texts of
    fewer than 50 bytes, stay as they are.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    partitions = max(shuffle_partitions(spark), 1)
    others = [c for c in docs.columns if c not in ("id", "data")]
    blocks = _blocks(docs, block_bytes, partitions)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(3, (total // bucket_bytes).bit_length())

    def sampled(row):
        block = _Block(row["blob"], row["ids"], row["sizes"])
        return block, _triples(block, buckets)

    def long_ones(row):
        block, names = sampled(row)
        rep = _repeated(names, _bits(row, "bits1"))
        return block, rep, _longs(block, buckets, rep)

    def live_ones(row):
        block, rep, names = long_ones(row)
        longs = _in_smaller(names, _bits(row, "bits2"))
        return block, longs, _live(block, buckets, rep, longs)

    def merged(row):
        block, longs, names = live_ones(row)
        return block, longs, _rest(block, buckets, _repeated(names, _bits(row, "bits3")), longs)

    def sends(step):
        def run(row):
            if (out := _send(step(row)[-1], row["block"])) is not None:
                yield out

        return run

    def final(row):
        import zstandard

        block, longs, names = merged(row)
        hits = _in_smaller(names, _bits(row, "bits4"))
        n = len(block.text)
        gone = _covered(n, longs, LONG) | _covered(n, hits, MIN_LENGTH)
        if whole_characters and n:
            first = np.flatnonzero((block.text & 0xC0) != 0x80)
            first = first if len(first) and first[0] == 0 else np.concatenate(([0], first))
            gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.concatenate((first, [n]))))
        step = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        raw, has = block.text.tobytes(), np.unpackbits(np.frombuffer(row["has_id"], np.uint8), count=len(block.ids))
        begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all() if others else None
        cols: list[list] = [[] for _ in range(5)]
        done = 0
        for k, (end, size) in enumerate(zip(block.ends.tolist(), block.sizes.tolist())):
            start = end - size
            lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(begins, end, "left")
            b = np.maximum(begins[lo:hi], start) - start
            e = np.minimum(ends[lo:hi], end) - start
            kept = raw[start:end] if lo >= hi else block.text[start:end][~gone[start:end]].tobytes()
            for c, v in zip(cols, (int(block.ids[k]) if has[k] else None, size, b, e, kept)):
                c.append(v)
            if len(cols[0]) >= 512 or k + 1 == len(block.ids):
                arrays = [pa.array(c, t) for c, t in zip(cols, _RESULT_TYPES)]
                if others:
                    arrays += rest.slice(done, len(cols[0])).combine_chunks().columns
                arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "begins", "ends", "kept", *others])
                done, cols = done + len(cols[0]), [[] for _ in range(5)]

    def told(state: DataFrame, bits: DataFrame, name: str) -> DataFrame:
        return state.join(bits.withColumnRenamed("bits", name).hint("shuffle_hash"), "block", "left")

    state = blocks
    for name, step, narrow in (("bits1", sampled, True), ("bits2", long_ones, False), ("bits3", live_ones, True), ("bits4", merged, False)):
        state = told(state, _sort(_each(sends(step), _MESSAGE)(state), buckets, narrow), name)
    schema = "id long, n_bytes long, begins array<long>, ends array<long>, kept binary"
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return _each(final, ", ".join([schema, *(f"`{c}` {types[c]}" for c in others)]))(state)


_RESULT_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
