"""Word and character error rates.

Per pair only additive statistics are kept (edit distance, reference
length); a corpus rate is ``sum(dist) / sum(len)``, so the group step is a
partial (map-side) aggregation followed by a tiny final one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit import char_edit_distance, document_errors, with_word_distances
from ..functions.text import basic_normalize
from ..functions.tokenize import cer_text, wer_words


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_pairs(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Pairs with both sides; the others have no error rate."""
    return pairs.where(F.col(ref).isNotNull() & F.col(hyp).isNotNull())


def _stage_tokens(df: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Project word arrays and CER strings for each named side pair once."""
    keep = [F.col(c) for c in df.columns]
    cols = []
    for p, (ref, hyp) in sides.items():
        cols += [wer_words(ref).alias(f"_{p}_rw"), wer_words(hyp).alias(f"_{p}_hw"),
                 cer_text(ref).alias(f"_{p}_rc"), cer_text(hyp).alias(f"_{p}_hc")]
    return df.select(*keep, *cols)


def error_stats(df: DataFrame, sides: dict[str, tuple[str, str]],
                kinds: tuple[str, ...] = ("wer", "cer"), long_pairs: bool = False) -> DataFrame:
    """Add ``{prefix}{kind}_err`` / ``{prefix}{kind}_n`` per side pair.

    ``sides`` maps an output prefix to ``(ref column, hyp column)``.  With
    ``long_pairs`` texts may be whole documents: one function takes each pair
    apart and counts, in linear memory and about a step per symbol.
    """
    keep = list(df.columns)
    if long_pairs:
        st = df.select(*keep, *[document_errors(ref, hyp, "wer" in kinds, "cer" in kinds).alias(f"_{p}_e") for p, (ref, hyp) in sides.items()])
        return st.select(*keep, *[F.col(f"_{p}_e.{k}_{c}").alias(f"{p}{k}_{c}") for p in sides for k in ("wer", "cer") if k in kinds
                                  for c in ("err", "n")])
    st = _stage_tokens(df, sides)
    if "wer" in kinds:
        st = with_word_distances(st, [(f"_{p}_rw", f"_{p}_hw", f"_{p}_wd") for p in sides])
    out = [F.col(c) for c in keep]
    for p in sides:
        if "wer" in kinds:
            out += [F.col(f"_{p}_wd").alias(f"{p}wer_err"), F.size(f"_{p}_rw").alias(f"{p}wer_n")]
        if "cer" in kinds:
            out += [char_edit_distance(f"_{p}_rc", f"_{p}_hc").alias(f"{p}cer_err"),
                    F.length(f"_{p}_rc").alias(f"{p}cer_n")]
    return st.select(*out)


def rate(errors: Column, total: Column, digits: int | None = 2) -> Column:
    """100 * errors / total, rounded half-even; null when there is no reference."""
    r = F.when(total > 0, F.lit(100.0) * errors / total)
    return F.bround(r, digits) if digits is not None else r


def pair_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp",
                normalized: bool = True, keep_marks: bool = False, long_pairs: bool = False) -> DataFrame:
    """Per-pair statistics for the ASR report.

    The normalised texts are projected first, so that each is made once for
    all tokenisers that read it.
    """
    base = list(pairs.columns)
    sides = {"": (ref, hyp)}
    if normalized:
        pairs = pairs.select(*base, basic_normalize(ref, keep_marks).alias("_nref"),
                             basic_normalize(hyp, keep_marks).alias("_nhyp"))
        sides["norm_"] = ("_nref", "_nhyp")
    st = error_stats(pairs, sides, long_pairs=long_pairs)
    return st.drop("_nref", "_nhyp")


def _rates(prefixes: list[str], digits: int | None) -> list[Column]:
    return [rate(F.sum(f"{p}_err"), F.sum(f"{p}_n"), digits).alias(p) for p in prefixes]


def spread(pairs: DataFrame, columns: list[str], key: list[str] | None, partitions: int | None) -> DataFrame:
    """The columns over an explicit number of tasks (default
    ``spark.sql.shuffle.partitions``): pairs are small, but the distances are
    quadratic in them, so the few tasks that AQE would leave do all the work.
    With ``key``, the columns that tell pairs apart, Spark drops the step where a
    join has placed them by these; without, rows are dealt in turn.
    """
    n = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = list(dict.fromkeys(columns))
    if key is None:
        return pairs.select(*keep).repartition(n)
    return pairs.select(*dict.fromkeys([*key, *keep])).repartition(n, *key).select(*keep)


def wer(pairs: DataFrame, by: list[str] | None = None, ref="ref", hyp="hyp",
        digits: int | None = 2, key: list[str] | None = None, partitions: int | None = None,
        long_pairs: bool = False) -> DataFrame:
    """M1: corpus WER per group (micro-average; may exceed 100)."""
    st = error_stats(spread(valid_pairs(pairs, ref, hyp), [*(by or []), ref, hyp], key, partitions), {"": (ref, hyp)}, ("wer",), long_pairs)
    return st.groupBy(*(by or [])).agg(*_rates(["wer"], digits))


def cer(pairs: DataFrame, by: list[str] | None = None, ref="ref", hyp="hyp",
        digits: int | None = 2, key: list[str] | None = None, partitions: int | None = None,
        long_pairs: bool = False) -> DataFrame:
    """M2: corpus CER per group (inner spaces count as characters)."""
    st = error_stats(spread(valid_pairs(pairs, ref, hyp), [*(by or []), ref, hyp], key, partitions), {"": (ref, hyp)}, ("cer",), long_pairs)
    return st.groupBy(*(by or [])).agg(*_rates(["cer"], digits))


def asr_report(pairs: DataFrame, by: list[str] | None = None, ref: str = "ref",
               hyp: str = "hyp", digits: int | None = 2,
               keep_marks: bool = False, key: list[str] | None = None, partitions: int | None = None,
               long_pairs: bool = False) -> DataFrame:
    """M3: WER, normalised WER, CER, normalised CER and pair count in one pass.

    Normalisation is the basic normaliser applied to both sides (the
    reference normalises references and predictions alike).  ``long_pairs``
    as in :func:`error_stats`.
    """
    by = by or []
    st = pair_errors(spread(valid_pairs(pairs, ref, hyp), [*by, ref, hyp], key, partitions), ref, hyp, True, keep_marks, long_pairs)
    return st.groupBy(*by).agg(
        *_rates(["wer", "norm_wer", "cer", "norm_cer"], digits),
        F.count(F.lit(1)).alias("n_pairs"),
    )
