"""Turns of conversations in order, and running sums over them.

No conversation has to fit in one task: rows are range-partitioned by
conversation and place, so that a very long one spreads over many partitions, and
what a partition needs to know of those before it is one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, shuffle_partitions

#: Leading characters of a text that order rows of one turn; then its hash does.
LEAD = 24


def turn_columns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``id, turn, role, text`` with null roles and texts empty, and ``seq``, which
    tells repeated rows apart."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                     *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))],
                     F.monotonically_increasing_id().alias("seq"))


def turn_order(text: Column | str = "text") -> list[Column]:
    """By conversation and turn (null first); rows of one turn by role, leading
    characters and hash of the text.  Rows alike in all of these are repeats."""
    return [F.col("id"), F.col("turn"), F.col("role"), F.substring(text, 1, LEAD), F.xxhash64(text), F.col("seq")]


def sort_by_range(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sorted over all partitions, with the partition's number as ``part``."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def _segments(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def _run(batch: pa.RecordBatch, key: str, sums: list[str], carry: tuple | None):
    """The keys, and for each sum its values and its running sums (modulo 2^64)."""
    k = batch.column(key).to_numpy(zero_copy_only=False)
    begin = _segments(k)
    lengths = np.diff(np.concatenate((begin, [len(k)])))
    values, totals = [], []
    for j, name in enumerate(sums):
        v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(v)
        total -= np.repeat(total[begin] - v[begin], lengths)
        if carry is not None and carry[0] == k[0]:
            total[:lengths[0]] += np.int64(carry[1][j])
        values.append(v)
        totals.append(total)
    return k, values, totals


def _wrap(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def running(df: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """``df`` with each of the columns ``sums`` replaced by its running sum along
    its ``key`` (a long, not null), this row included, and as ``<name>_before``
    without it.  Sums of longs wrap around.

    ``df`` comes from ``sort_by_range`` and was materialised.  Each partition tells
    the driver one row: its first and last key and the sums of the last.
    """
    names = df.columns

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = carry = part = None
        one = True
        for batch in batches:
            if batch.num_rows:
                k, _, totals = _run(batch, key, sums, carry)
                first = int(k[0]) if first is None else first
                one = one and bool((k == first).all())
                carry = (int(k[-1]), [int(t[-1]) for t in totals])
                part = batch.column("part")[0].as_py()
        if carry is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([carry[0]], pa.int64()), pa.array([one]),
                 pa.array([carry[1]], pa.list_(pa.int64()))], names=["part", "first", "last", "one", "sums"])

    found = df.mapInArrow(tails, "part int, first long, last long, one boolean, sums array<long>").collect()
    before, carry = {}, None
    for row in sorted(found, key=lambda r: r["part"]):
        goes_on = carry is not None and carry[0] == row["first"]
        if goes_on:
            before[row["part"]] = carry
        if goes_on and row["one"]:
            carry = (carry[0], [_wrap(a + b) for a, b in zip(carry[1], row["sums"])])
        else:
            carry = (row["last"], list(row["sums"]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for n, batch in enumerate(b for b in batches if b.num_rows):
            if n == 0:
                carry = before.get(batch.column("part")[0].as_py())
            k, values, totals = _run(batch, key, sums, carry)
            carry = (k[-1], [t[-1] for t in totals])
            new = dict(zip(sums, totals))
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], pa.int64()) if c in new else batch.column(c) for c in names]
                + [pa.array(t - v, pa.int64()) for t, v in zip(totals, values)], names=names + [f"{s}_before" for s in sums])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {'bigint' if c in sums else kinds[c]}" for c in names] + [f"`{s}_before` bigint" for s in sums])
    return cut(df.mapInArrow(add, schema))
