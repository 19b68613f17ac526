"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import materialize


#: Keys of 16 bytes that may be sent to every task.
BROADCAST_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | Column) -> Column:
    """The text's UTF-8 bytes; a null text counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text bytes, as ``id`` and ``data``, so that other
    columns of the input can have any names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                     utf8(F.col(f"`{text_col}`")).alias("data"))


def signed(x: int) -> int:
    """An unsigned 64-bit number as the signed one of the same bits."""
    return x - (1 << 64) if x >> 63 else x


def text_key(text_col: str) -> Column:
    """XXH64 of the text's UTF-8 bytes: with the id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def without_losers(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows of ``df`` that ``found(id, raw, kept)`` keeps, one of each id
    and text: of rows with both alike the first in no set order.  ``found`` has a
    row for every row of ``df``.

    Texts stay where they are: only what goes, and what stands there more than
    once, is looked up, by a broadcast of at most ``BROADCAST_ROWS`` keys and by a
    shuffle where there are more.
    """
    marks = cut(found.groupBy(F.col("id").alias("m_id"), F.col("raw").alias("m_raw"))
                .agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    n, repeated = marks.agg(F.count("*"), F.count_if("stays")).first()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("raw"))
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("raw") == F.col("m_raw"))

    def side(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if n <= BROADCAST_ROWS else keys

    single = rows.join(side(marks), same, "left_anti").select("row.*")
    if not repeated:
        return single
    one = Window.partitionBy("id", "raw").orderBy("id")
    several = rows.join(side(marks.where("stays")), same, "left_semi").withColumn("nth", F.row_number().over(one))
    return single.unionByName(several.where("nth = 1").select("row.*"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder."""
    return materialize(df)


def release() -> None:
    """Give what a task has freed back to the system.  A worker lives on through
    the stages behind, and the C library keeps the most that any of them used."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 5 << 20) -> Iterator[tuple[list, list]]:
    """``(ids, datas)`` of at most so many rows, and of not much more than so many
    bytes; they keep a task's memory flat."""
    for batch in batches:
        ids, datas, held = [], [], 0
        for id_, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(id_)
            datas.append(data.as_py())
            held += len(datas[-1])
            if len(ids) >= rows or held >= size:
                yield ids, datas
                ids, datas, held = [], [], 0
        if ids:
            yield ids, datas


def map_rows(df: DataFrame, fn: Callable[[list, list], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``fn(ids, datas)``, which returns a record batch, over slices of the
    rows ``(id, data)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, datas in slices(batches):
            yield fn(ids, datas)
        release()

    return df.mapInArrow(run, schema)


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges(a long, b long)`` -> ``(node long, label long)`` with the smallest
    node of each component as its label; only nodes that have an edge appear.
    Every round takes the smallest label among the neighbours and then jumps to
    that label's own label, until no label changes; both steps are joins whose
    label side has one row per node, so a node with very many edges only makes
    many rows of the other side.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        new = cut(hooked.join(roots, "low").select(
            "node", F.least("low", "root").alias("label"), (F.least("low", "root") < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
