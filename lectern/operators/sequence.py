"""Array and sequence operators: label masks, argmax, CTC
decoding, batch padding, waveform normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_trim
from .vocab import token_of

IGNORE_INDEX = -100
FEATURE_EPS = 1e-7  # variance floor of the waveform normaliser


def unmask(ids, pad: int) -> Column:
    """A2: replace the ignore label ``-100`` by the pad id."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: F.when(x == IGNORE_INDEX, F.lit(pad)).otherwise(x))


def argmax_frames(logits) -> Column:
    """A3: per frame the 0-based index of the first maximum."""
    c = F.col(logits) if isinstance(logits, str) else logits
    return F.transform(c, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def frames(flat, width: int) -> Column:
    """Reshape a flat array into consecutive frames of ``width`` values; none of a
    shorter array, null of null."""
    c = F.col(flat) if isinstance(flat, str) else flat
    n = F.floor(F.size(c) / width).cast("int")
    # a sequence can't be empty: it has one place too many then
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda f: f < n)
    return F.when(c.isNotNull(), F.transform(places, lambda f: F.slice(c, f * width + 1, width)))


def ctc_collapse(ids, pad: int, group: bool = True) -> Column:
    """A4 (ids part): merge adjacent repeats (when ``group``), then drop pads."""
    c = F.col(ids) if isinstance(ids, str) else ids
    if group:
        kept = F.filter(c, lambda x, i: (i == 0) | (x != F.element_at(c, F.greatest(i, F.lit(1)))))
    else:
        kept = c
    return F.filter(kept, lambda x: x != F.lit(pad))


def ctc_decode(ids, tokens: Column, pad: int, delimiter: str = "|",
               group: bool = True) -> Column:
    """A4: CTC greedy decode to text: collapse, drop pad, id -> token (of a
    :func:`lectern.operators.vocab.token_table`), delimiter -> space,
    concatenate (an unknown id adds nothing), strip."""
    toks = F.transform(ctc_collapse(ids, pad, group), lambda x: token_of(tokens, x))
    toks = F.transform(toks, lambda t: F.when(t == F.lit(delimiter), F.lit(" ")).otherwise(t))
    return unicode_trim(F.array_join(toks, ""))


def pad_batch(df: DataFrame, batch: str, col: str, fill: int = IGNORE_INDEX,
              out: str | None = None, mask: str | None = "attention_mask") -> DataFrame:
    """A5: pad every array of a batch to the batch's longest; optional 1/0 mask.

    The longest of a batch is a partial aggregate joined back, so that no batch,
    whatever its size, has to lie in one task; null is a batch like any other.
    """
    out = out or col
    longest = df.groupBy(F.col(batch).alias("_b")).agg(F.max(F.size(col)).alias("_m"))
    st = df.join(longest, F.col(batch).eqNullSafe(F.col("_b"))).drop("_b")
    padded = F.concat(F.col(col), F.array_repeat(F.lit(fill), F.col("_m") - F.size(col)))
    cols = {out: padded}
    if mask:
        cols[mask] = F.concat(F.array_repeat(F.lit(1), F.size(col)),
                              F.array_repeat(F.lit(0), F.col("_m") - F.size(col)))
    return st.withColumns(cols).drop("_m")


def with_normalized_wave(df: DataFrame, samples: str, out: str = "input_values",
                         length: str = "input_length", eps: float = FEATURE_EPS) -> DataFrame:
    """A6 as staged projections (the mean is computed once, not per sample).  A clip
    without samples has an empty wave of length 0, null stays null."""
    c = F.col(samples)
    st = df.withColumn("_n", F.size(c)).withColumn(
        "_mean", F.try_divide(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.col("_n")))
    st = st.withColumn("_var", F.try_divide(F.aggregate(
        c, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - F.col("_mean")) * (x.cast("double") - F.col("_mean"))
    ), F.col("_n")))
    st = st.withColumn("_sd", F.sqrt(F.col("_var") + F.lit(eps)))
    norm = F.transform(c, lambda x: (x.cast("double") - F.col("_mean")) / F.col("_sd"))
    return st.withColumn(out, norm).withColumn(length, F.col("_n")).drop("_n", "_mean", "_var", "_sd")
