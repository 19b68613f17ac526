"""Wide parallel tables and two-column bitext."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import require_columns

# Fixed column names of the two corpus layouts.
TEST_COLUMNS = ["std_text", "ife_text", "ilaje_text", "ijebu_text", "english_text"]
TRAIN_COLUMNS = ["Ife Dialect", "Ilaje Dialect", "Ijebu Dialect", "Standard Yoruba", "English"]


# Fields that the reference's reader takes for missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
               "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def _csv(spark: SparkSession, multi_line: bool):
    return (spark.read.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def read_parallel(spark: SparkSession, path: str, columns: list[str] | None = None,
                  fmt: str = "csv", row_id: str | None = "row_id", multi_line: bool = True) -> DataFrame:
    """The named columns of a wide parallel table, as strings.

    Columns are found by the header's names, in any order and beside others; a
    missing one is an error that lists what there is (P6).  Empty fields and the
    usual missing-value words become null.  ``multi_line=False`` lets Spark split
    large files that have no line breaks within fields; Parquet is the format
    for large input.  ``row_id`` is unique within one evaluation: materialise the
    table before joining by it (as the jobs do).
    """
    columns = TEST_COLUMNS if columns is None else columns
    df = spark.read.parquet(path) if fmt == "parquet" else _csv(spark, multi_line).option("header", True).csv(path)
    df = require_columns(df, columns).select(*[F.col(f"`{c}`") for c in columns])
    df = df if fmt == "parquet" else _nulls(df)
    return df.withColumn(row_id, F.monotonically_increasing_id()) if row_id else df


def read_bitext(spark: SparkSession, path: str, reverse: bool = False,
                header: bool = True, multi_line: bool = True) -> DataFrame:
    """Two-column TSV taken by position, quoted and with missing values as in S1.

    Forward direction the file holds ``(target, source)``; reversed it holds
    ``(source, target)``.  The header row, if any, is skipped, not used.
    """
    schema = T.StructType([T.StructField("c0", T.StringType()), T.StructField("c1", T.StringType())])
    df = _nulls(_csv(spark, multi_line).schema(schema).option("sep", "\t").option("header", header).csv(path))
    names = ["src_txt", "tgt_txt"] if reverse else ["tgt_txt", "src_txt"]
    return df.toDF(*names).select("src_txt", "tgt_txt")
