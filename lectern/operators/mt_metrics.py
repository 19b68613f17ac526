"""BLEU, chrF, model-score summaries and the scorecard.

Scores are closed formulas over the additive statistics of
:mod:`lectern.operators.ngram`; a sentence score applies the formula to one
pair's row, a corpus score to the group's column sums (partial aggregation,
then a one-row-per-group final step).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram import BLEU_ORDER, CHRF_ORDER, pair_statistics

# Fixed values of the metrics: BLEU uses exponential smoothing and a log of
# zero taken as -9999999999; chrF uses beta = 2.
LOG_ZERO = -9999999999.0
CHRF_BETA = 2


def _r(c: Column, digits: int | None) -> Column:
    return F.bround(c, digits) if digits is not None else c


def bleu_formula(hyp_len: Column, ref_len: Column, h: list[Column], m: list[Column],
                 digits: int | None = None) -> Column:
    """BLEU from (summed) statistics; ``h`` are hypothesis n-gram totals."""
    order = len(h)
    hl, rl = hyp_len.cast("double"), ref_len.cast("double")
    bp = F.when(hyp_len < ref_len,
                F.when(hyp_len > 0, F.exp(F.lit(1.0) - rl / hl)).otherwise(F.lit(0.0))
                ).otherwise(F.lit(1.0))
    logs = []
    zeros = F.lit(0)
    for n in range(order):
        zeros = zeros + F.when(m[n] == 0, 1).otherwise(0)
        p = F.when(m[n] == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * h[n].cast("double"))
                   ).otherwise(F.lit(100.0) * m[n].cast("double") / h[n].cast("double"))
        logs.append(F.log(p))
    mean_log = reduce(lambda a, b: a + b, logs) / F.lit(float(order))
    all_zero = reduce(lambda a, b: a & b, [x == 0 for x in m])
    score = (F.when(all_zero, F.lit(0.0))
             .when(h[order - 1] == 0, F.lit(0.0))
             .otherwise(bp * F.exp(mean_log)))
    return _r(score, digits)


def chrf_formula(h: list[Column], r: list[Column], m: list[Column], beta: int = CHRF_BETA,
                 digits: int | None = None) -> Column:
    """chrF from (summed) statistics, averaging precision and recall over the
    orders where both sides have n-grams."""
    factor = float(beta ** 2)
    prec, rec, eff = F.lit(0.0), F.lit(0.0), F.lit(0)
    for hn, rn, mn in zip(h, r, m):
        both = (hn > 0) & (rn > 0)
        prec = prec + F.when(both, mn.cast("double") / hn.cast("double")).otherwise(F.lit(0.0))
        rec = rec + F.when(both, mn.cast("double") / rn.cast("double")).otherwise(F.lit(0.0))
        eff = eff + F.when(both, 1).otherwise(0)
    p = F.when(eff > 0, prec / eff.cast("double")).otherwise(F.lit(0.0))
    rc = F.when(eff > 0, rec / eff.cast("double")).otherwise(F.lit(0.0))
    score = F.when((p + rc) > 0,
                   F.lit(100.0) * ((F.lit(1.0 + factor) * p * rc) / (F.lit(factor) * p + rc))
                   ).otherwise(F.lit(0.0))
    return _r(score, digits)


def _total(c: str) -> Column:
    """Sum over pairs; rows repeated as a whole count as often as they stand."""
    return F.sum(F.col(c) * F.col("n_pairs"))


def _cols(prefix: str, order: int, agg: bool) -> list[Column]:
    return [_total(f"{prefix}{n}") if agg else F.col(f"{prefix}{n}") for n in range(1, order + 1)]


def pair_stats(pairs: DataFrame, key: list[str], ref="ref", hyp="hyp", by: list[str] | None = None,
               metrics: str = "bc") -> DataFrame:
    """BLEU (``b_*``) and chrF (``c_*``) statistics side by side, one row per pair
    (see :mod:`lectern.operators.ngram` for repeated rows and null sides)."""
    return pair_statistics(pairs, key, ref, hyp, metrics, carry=by)


def _scored(score: Column, n_pairs: Column) -> Column:
    return F.when(n_pairs > 0, score)


def sentence_bleu(digits: int | None = None, prefix: str = "b_") -> Column:
    """M4 column over a row of BLEU statistics; null where a side is."""
    score = bleu_formula(F.col(prefix + "hyp_len"), F.col(prefix + "ref_len"),
                         _cols(prefix + "h", BLEU_ORDER, False), _cols(prefix + "m", BLEU_ORDER, False), digits)
    return _scored(score, F.col("n_pairs"))


def sentence_chrf(digits: int | None = None, prefix: str = "c_") -> Column:
    """M6 column over a row of chrF statistics; null where a side is."""
    score = chrf_formula(*[_cols(prefix + x, CHRF_ORDER, False) for x in "hrm"], digits=digits)
    return _scored(score, F.col("n_pairs"))


def corpus_bleu_agg(digits: int | None = None, prefix: str = "b_") -> Column:
    """M5 aggregate expression (use inside ``groupBy(...).agg``); null for a group without a whole pair."""
    score = bleu_formula(_total(prefix + "hyp_len"), _total(prefix + "ref_len"),
                         _cols(prefix + "h", BLEU_ORDER, True), _cols(prefix + "m", BLEU_ORDER, True), digits)
    return _scored(score, F.sum("n_pairs"))


def corpus_chrf_agg(digits: int | None = None, prefix: str = "c_") -> Column:
    """M7 aggregate expression."""
    score = chrf_formula(*[_cols(prefix + x, CHRF_ORDER, True) for x in "hrm"], digits=digits)
    return _scored(score, F.sum("n_pairs"))


def bleu(pairs: DataFrame, key: list[str], by: list[str] | None = None, ref="ref", hyp="hyp",
         digits: int | None = None) -> DataFrame:
    """M5: corpus BLEU per group (``by``); ``key`` identifies a pair."""
    st = pair_stats(pairs, key, ref, hyp, by, "b")
    return st.groupBy(*(by or [])).agg(corpus_bleu_agg(digits).alias("bleu"))


def chrf(pairs: DataFrame, key: list[str], by: list[str] | None = None, ref="ref", hyp="hyp",
         digits: int | None = None) -> DataFrame:
    """M7: corpus chrF per group."""
    st = pair_stats(pairs, key, ref, hyp, by, "c")
    return st.groupBy(*(by or [])).agg(corpus_chrf_agg(digits).alias("chrf"))


def sentence_scores(pairs: DataFrame, key: list[str], ref="ref", hyp="hyp", digits: int | None = None) -> DataFrame:
    """Per-pair BLEU and chrF (M4, M6) keyed by ``key``; null where a side is.
    Rows repeated as a whole share one row."""
    return sentence_from_stats(pair_stats(pairs, key, ref, hyp), key, digits)


def sentence_from_stats(stats: DataFrame, key: list[str], digits: int | None = None) -> DataFrame:
    return stats.select(*key, sentence_bleu(digits).alias("bleu"), sentence_chrf(digits).alias("chrf"))


def corpus_scores(pairs: DataFrame, key: list[str], by: list[str] | None = None, ref="ref",
                  hyp="hyp", digits: int | None = None) -> DataFrame:
    """Corpus BLEU and chrF per group, with the pairs scored and those skipped
    for a null side."""
    return corpus_from_stats(pair_stats(pairs, key, ref, hyp, by), by, digits)


def corpus_from_stats(stats: DataFrame, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    return stats.groupBy(*(by or [])).agg(
        corpus_bleu_agg(digits).alias("bleu"), corpus_chrf_agg(digits).alias("chrf"),
        F.sum("n_pairs").alias("n_pairs"), F.sum("n_skipped").alias("n_skipped"))


def score_summary(df: DataFrame, score: str, by: list[str] | None = None,
                  digits: int | None = None) -> DataFrame:
    """M8: group mean of a per-row model score (the system-level score)."""
    return df.groupBy(*(by or [])).agg(_r(F.avg(score), digits).alias(f"{score}_mean"),
                                       F.count(score).alias("n_scored"))


def gen_len(df: DataFrame, ids: str, pad: int, by: list[str] | None = None,
            digits: int | None = 4) -> DataFrame:
    """Mean count of non-pad ids per prediction."""
    n = F.size(F.filter(F.col(ids), lambda x: x != F.lit(pad)))
    return df.groupBy(*(by or [])).agg(_r(F.avg(n), digits).alias("gen_len"))


def scorecard(wide: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Long scorecard ``(group, metric, score)`` from a per-group table,
    plus the flat ``{group}_{metric}`` key the JSON sink writes."""
    long = wide.unpivot([by], metrics, "metric", "score")
    return long.select(by, "metric", "score",
                       F.concat_ws("_", F.regexp_replace(F.col(by).cast("string"), " ", "_"),
                                   F.col("metric")).alias("key"))
