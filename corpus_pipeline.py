"""The corpus pipeline: documents to packed training sequences.

Each stage calls one operator of ``lectern.llm`` on all rows that the stage
before kept.  ``run`` writes every stage's result as Parquet to the shared
folder and reads it again, so a stage is never computed twice and a lost
executor costs tasks of one stage only.

Every stage takes null ids and texts, texts of any length, repeated rows and
further columns as its operator does; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact, packing, simhash, suffixes, toxicity
from lectern.llm.common import table, utf8, without_losers
from lectern.llm.queries import tokenizer_path
from lectern.session import checkpoint_dir

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is ``TOXIC_FROM`` or more.
    The scores are learned from the labelled rows that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same words and blanks: that with the
    smallest id, and one row of it."""
    return without_losers(docs, exact.equal_groups(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, and
    one row of it."""
    return without_losers(docs, simhash.near_groups(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of 50 that a document with a
    smaller id has too.  Characters stay whole, a null text becomes empty, and
    ``n_chars``, where there is one, follows the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), utf8("text").alias("data"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    found = suffixes.repeated_spans(rows, whole_characters=True).withColumn("text", F.col("kept").cast("string"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens."""
    found = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                        "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Fitted trees, subword tokenizers and online packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
