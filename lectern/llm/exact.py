"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally
within their partitions, and each is compared in full with its neighbour.  The
splitters are taken from small keys (leading bytes, a hash of the whole text and
the id), so that sampling moves little to the driver, and the id at their end
lets one large group spread over many partitions.  Groups cut by a partition
border are put together from one or two rows per partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, shuffle_partitions, signed, utf8

_BLANKS = re.compile(rb"[\x20\x09-\x0d]+")
#: Bytes of the text that lead the sort key; the order only, never a comparison, depends on it.
LEAD = 24

_SCHEMA = ("part int, grp long, id long, raw long, n long, digest string, low long, first boolean, "
           "edge string, edge_text binary")


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, text) rows -> each row with its group in this partition; for
    the first and the last group a further row with the text and the count."""
    import hashlib

    import xxhash

    part, grp, last = TaskContext.get().partitionId(), -1, None
    low = digest = first_group = None
    count, made = 0, []

    def row(**x):
        made.append({"part": part, "grp": grp, "id": None, "raw": None, "n": None, "digest": None, "low": None,
                     "first": None, "edge": None, "edge_text": None} | x)

    def flush():
        nonlocal made
        out, made = made, []
        return pa.RecordBatch.from_pylist(out, schema=_ARROW)

    for batch in batches:
        for id_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = _BLANKS.sub(b" ", data)
            opens = last is None or text != last
            if opens:
                if grp >= 0:
                    row(edge="group", n=count, low=low, edge_text=last if grp == 0 else None)
                grp, last, low, count, digest = grp + 1, text, id_, 0, hashlib.sha256(text).hexdigest()
            count += 1
            row(id=id_, raw=signed(xxhash.xxh64_intdigest(data, 42)), digest=digest, first=opens)
            if len(made) >= 4096:
                yield flush()
    if grp >= 0:
        row(edge="last", n=count, low=low, edge_text=last)
    if made:
        yield flush()


_ARROW = pa.schema([("part", pa.int32()), ("grp", pa.int64()), ("id", pa.int64()), ("raw", pa.int64()), ("n", pa.int64()),
                    ("digest", pa.string()), ("low", pa.int64()), ("first", pa.bool_()),
                    ("edge", pa.string()), ("edge_text", pa.binary())])


def equal_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None) -> DataFrame:
    """One row per input row: ``id``, ``raw`` (see ``text_key``), ``keep_id``,
    ``group_size``, ``kept``, ``digest`` (SHA-256 of the normalised text, hex).

    Texts are equal when they are the same after each run of blanks became one
    space.  Null counts as the empty text.  The smallest id stays; null ids
    sort behind all others, so ``keep_id`` is null only if no row of the group
    has an id.  Of repeated rows with one id exactly one is ``kept``.  An empty
    table gives no rows; other columns are not read.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    data = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("data"))
    norm = F.regexp_replace(F.col("data").cast("string"), r"[\x20\x09-\x0D]+", " ")
    keyed = (data.withColumn("norm", norm)
             .select("id", "data", F.substring(F.col("norm").cast("binary"), 1, LEAD).alias("lead"),
                     F.xxhash64("norm").alias("hash"), F.col("id").isNull().alias("no_id")))
    key = ["lead", "hash", "no_id", "id"]
    marked = cut(keyed.repartitionByRange(n, *key)
                 .withColumn("norm", norm).sortWithinPartitions("lead", "hash", "norm", "no_id", "id")
                 .select("id", "data").mapInArrow(_marker, _SCHEMA))
    groups = marked.where("edge is not null").select("part", "grp", "n", "low", "edge", "edge_text")

    # Groups at a border: an island of the same text over consecutive rows.
    # One or two rows a partition, so a single window holds them all.
    border = groups.where("edge_text is not null")
    order = Window.orderBy("part", "grp")
    island = (border.withColumn("opens", F.coalesce((F.lag("edge_text").over(order) != F.col("edge_text")).cast("int"), F.lit(1)))
              .withColumn("island", F.sum("opens").over(order)).drop("edge_text"))
    over = Window.partitionBy("island")
    joined = island.select(
        "part", "grp", F.sum("n").over(over).alias("all_n"), F.min("low").over(over).alias("all_low"),
        (F.row_number().over(over.orderBy("part", "grp")) == 1).alias("leads"))
    sizes = (groups.select("part", "grp", "n", "low").join(F.broadcast(joined), ["part", "grp"], "left")
             .select("part", "grp", F.coalesce("all_n", "n").alias("group_size"),
                     F.when(F.col("all_n").isNotNull(), F.col("all_low")).otherwise(F.col("low")).alias("keep_id"),
                     F.coalesce("leads", F.lit(True)).alias("leads")))
    rows = marked.where("edge is null").select("part", "grp", "id", "raw", "digest", "first")
    return rows.join(sizes, ["part", "grp"]).select(
        "id", "raw", "keep_id", "group_size", (F.col("first") & F.col("leads")).alias("kept"), "digest")
