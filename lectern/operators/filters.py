"""Filters and caps and per-split counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import is_scorable
from ..session import materialize

#: Rows up to which an ungrouped cap is a plain ordered limit.
LIMIT_ROWS = 10_000


def filter_scorable(df: DataFrame, col: str) -> DataFrame:
    """keep rows whose stripped raw text is neither empty nor the sentinel."""
    return df.where(is_scorable(F.col(col)))


def filter_duration(df: DataFrame, n_samples: str = "n_samples", rate: str = "sampling_rate",
                    min_s: float = 0.0, max_s: float = 20.0) -> DataFrame:
    """strict range ``min_s * rate < n_samples < max_s * rate``.

    Runs on the header manifest (no audio decode), so it is a pushed-down
    filter ahead of any expensive per-clip work.
    """
    n, r = F.col(n_samples), F.col(rate)
    return df.where((n > F.lit(min_s) * r) & (n < F.lit(max_s) * r))


def cap(df: DataFrame, n: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """L1: the first ``n`` rows by ``order`` (per ``by`` group when given).

    Per group this is ``row_number() <= n``; Spark plans a WindowGroupLimit
    below the shuffle, so each task forwards at most ``n`` rows per group and
    a hot group does not move all of its rows.  Without groups a small ``n`` is an
    ordered limit, which gathers ``n`` rows in one task, and a large one is
    :func:`first_rows`.
    """
    if not by:
        return df.orderBy(*order).limit(n) if n <= LIMIT_ROWS else first_rows(df, n, order)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by ``order`` with no task that sees them all: sampled
    splitters deal the rows to sorted partitions, the partitions are counted, and
    the one in which the count is reached keeps as many rows as are missing."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition number in the high bits, place in the sorted partition in the low 33
    at = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a partition
    left = n
    for r in counts:
        if r["count"] >= left:
            last = (r["part"] << 33) + left
            return placed.where(F.col("_at") < last).drop("_at")
        left -= r["count"]
    return placed.drop("_at")


def _counts(cap_n: int | None) -> tuple:
    n = F.count(F.lit(1))
    return n, F.least(F.lit(cap_n).cast("long"), n) if cap_n is not None else n


def split_counts(df: DataFrame, split: str = "split", cap_n: int | None = None) -> DataFrame:
    """Rows per split and the reported sample count ``min(cap, n)``."""
    n, samples = _counts(cap_n)
    return df.groupBy(split).agg(n.alias("n_rows"), samples.alias("samples"))


def observed_split_counts(df: DataFrame, splits: list[str], split: str = "split") -> tuple[DataFrame, Observation]:
    """K5/M13 without a pass of its own: the rows, and an observation that has the
    number of rows of each of ``splits`` once they were written."""
    seen = Observation(f"splits-{uuid.uuid4().hex}")
    return df.observe(seen, *[F.count_if(F.col(split) == s).alias(s) for s in splits]), seen
