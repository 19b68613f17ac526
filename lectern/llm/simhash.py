"""SimHash near-duplicate groups with covering locality-sensitive hashing.

Fingerprints of 64 bits are linked when they differ in at most ``radius`` bits.
Each bit position i gets a non-zero vector m(i) of radius + 1 bits; table v
(one for each non-zero vector v) keeps the bits with <m(i), v> odd.  The at most
``radius`` vectors of the bits in which a pair differs span a space that some v
is orthogonal to, and that table's mask avoids all of them: every pair within
the radius shares a bucket of some table.  With radius 3 these are 15 tables
that keep 32 or more bits each.

Buckets hold distinct fingerprints, one row each.  A bucket with more than
``large`` of them is dealt out again by the same masks built over the bits that
its own mask left free, which keeps the guarantee and bounds a bucket by the
number of values of the bits still free.
Inside a bucket only the edges of a spanning forest leave the task, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, map_rows, min_labels, pairs, signed

SEED = 42
BITS = 64
SHINGLE = 3
RADIUS = 3
#: Distinct fingerprints in a bucket from which it is dealt out again.
LARGE = 512


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text given as UTF-8 bytes, as an unsigned number."""
    import xxhash

    words = data.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())),
                    np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):  # very long texts by blocks
        counts += np.unpackbits(h[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def covering_masks(free: int = (1 << BITS) - 1, radius: int = RADIUS) -> list[int]:
    """The masks of the tables over the bits set in ``free``."""
    n = (1 << (radius + 1)) - 1
    places = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for k, i in enumerate(places) if bin((k % n + 1) & v).count("1") & 1) for v in range(1, n + 1)]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct fingerprint the smallest of its component within the
    bucket.  A breadth-first search compares each of them with those not yet
    reached only, so a dense bucket costs little more than its size."""
    left = np.sort(fps).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    one, other = [], []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                hit = left[near]
                one.append(np.full(len(hit), root))
                other.append(hit)
                front.extend(hit)
                left = left[~near]
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate(x).view(np.int64) if x else empty for x in (one, other))


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket; a bucket may span batches."""
        key, held = None, []

        def close():
            if sum(map(len, held)) > 1:
                a, b = _forest(np.concatenate(held), radius)
                if len(a):
                    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                now = tuple(c[a] for c in cols[:3])
                if now != key:
                    if (done := close()) is not None:
                        yield done
                    key, held = now, []
                held.append(cols[3][a:b].copy())
        if (done := close()) is not None:
            yield done

    return run


def links(fps: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` (signed
    64 bits) which a chain of links of at most ``radius`` bits connects."""
    outer = covering_masks(radius=radius)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(outer)])).alias("x")
    ).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "k"])
    again = F.lit(None).cast("array<struct<t2:int,k2:bigint>>")
    for t, m in enumerate(outer):
        inner = covering_masks(~m & ((1 << BITS) - 1), radius)
        again = F.when(F.col("t") == t, F.array(*[
            F.struct(F.lit(u).alias("t2"), F.col("fp").bitwiseAND(F.lit(signed(i))).alias("k2")) for u, i in enumerate(inner)])
        ).otherwise(again)
    alone = F.array(F.struct(F.lit(-1).alias("t2"), F.lit(0).cast("bigint").alias("k2")))
    dealt = shared.select("t", "k", "fp", F.explode(F.when(F.col("n") > large, again).otherwise(alone)).alias("y")).select(
        (F.col("t") * 64 + F.col("y.t2")).alias("t"), "k", F.col("y.k2").alias("k2"), "fp")
    return (dealt.repartition("t", "k", "k2").sortWithinPartitions("t", "k", "k2")
            .mapInArrow(_bucket_edges(radius), "a long, b long"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, raw, fp)`` for every row; ``fp`` holds the 64 bits as a signed long
    and ``raw`` is the row's ``text_key``."""

    def fn(ids, datas):
        import xxhash

        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([signed(xxhash.xxh64_intdigest(d, 42)) for d in datas], pa.int64()),
             pa.array([signed(fingerprint(d, shingle)) for d in datas], pa.int64())], names=["id", "raw", "fp"])

    return map_rows(pairs(df, id_col, text_col), fn, "id long, raw long, fp long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """One row per input row: ``id``, ``raw``, ``fp``, ``component`` (the smallest
    id that a chain of links reaches, its own included) and ``kept``, true for
    the rows of one text of that id in each component.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows each get their row.  A row with a null id gets its
    component's smallest id; that is null if no row of it has an id.  An empty
    table gives no rows; other columns are not read.
    """
    base = cut(fingerprints(df, id_col, text_col, shingle))
    firsts = base.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")).alias("low"))
    labels = min_labels(links(firsts.select("fp"), radius, large)).withColumnRenamed("node", "fp")
    grouped = firsts.join(labels, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = grouped.groupBy("label").agg(F.min("low").alias("least"))
    classes = grouped.join(least, "label").select("fp", "least")
    return base.join(classes, "fp").select(
        "id", "raw", "fp", F.col("least.id").alias("component"),
        (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("raw") == F.col("least.raw"))).alias("kept"))
