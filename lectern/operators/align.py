"""Align sources, hypotheses and references by key, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, on: list[str] | str,
          how: str = "inner") -> DataFrame:
    """Equi-join two keyed tables.

    The join strategy is Catalyst's (sort-merge, or broadcast when AQE sees a
    small side at run time); nothing is hinted because neither side has a
    size bound.  The output stays hash-partitioned on ``on`` so per-pair
    aggregations keyed by a superset of ``on`` need no further shuffle.
    """
    on = [on] if isinstance(on, str) else list(on)
    return left.join(right, on=on, how=how)


def unmatched(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``left`` with no partner in ``right`` (to report, not to drop silently)."""
    on = [on] if isinstance(on, str) else list(on)
    return left.join(right.select(*on), on=on, how="left_anti")


def conversation_pairs(conversations: DataFrame, ref_role: str = "user",
                       hyp_role: str = "assistant") -> DataFrame:
    """Scored pairs from a dialogue table: turn t of ``ref_role`` is the
    reference, turn t+1 of ``hyp_role`` in the same conversation the
    hypothesis.  Output ``(conv_id, turn, ref, hyp)`` keyed by the reference turn.
    """
    ref = (conversations.where(F.col("role") == ref_role)
           .select("conv_id", "turn", F.col("text").alias("ref")))
    hyp = (conversations.where(F.col("role") == hyp_role)
           .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp")))
    return align(ref, hyp, ["conv_id", "turn"])
