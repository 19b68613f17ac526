"""Projection and reshape operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import add_prompt, fold_punct

# Dialect column names of the training layout and language tags.
DIALECT_COLUMNS = ["Ife Dialect", "Ilaje Dialect", "Ijebu Dialect", "Standard Yoruba"]
PIVOT_LANGUAGE = "English"
LANG_CODES = {"Ife": "ife_Yoru", "Ilaje": "ila_Yoru", "Ijebu": "ije_Yoru"}
DEFAULT_SOURCE_CODE = "yor_Latn"
ENGLISH_CODE = "eng_Latn"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def resolve_dialects(single_dialect: str | None = None) -> list[str]:
    """``None`` -> all four columns; ``Standard`` -> ``Standard Yoruba``;
    ``X`` -> ``X Dialect``."""
    if not single_dialect:
        return list(DIALECT_COLUMNS)
    if single_dialect == "Standard":
        return ["Standard Yoruba"]
    return [f"{single_dialect} Dialect"]


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail early, listing the available columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {', '.join(missing)} not found; available: "
                         f"{', '.join(df.columns)}")
    return df


def unpivot_dialects(df: DataFrame, dialects: list[str] | None = None,
                     pivot_lang: str = PIVOT_LANGUAGE, reverse: bool = False,
                     ids: list[str] | None = None) -> DataFrame:
    """Wide -> long, one row per (row, dialect); nulls are kept.

    Forward the dialect text is ``src_txt`` and the pivot language
    ``tgt_txt``; ``reverse=True`` exchanges them.  A narrow transformation
    (Expand), no shuffle.
    """
    dialects = resolve_dialects() if dialects is None else list(dialects)
    ids = list(ids or [])
    require_columns(df, ids + dialects + [pivot_lang])
    base = df.select(*[_q(c) for c in ids], _q(pivot_lang).alias("_pivot"),
                     *[_q(c).alias(f"_d{i}") for i, c in enumerate(dialects)])
    long = base.unpivot(ids + ["_pivot"], [f"_d{i}" for i in range(len(dialects))],
                        "_dk", "_txt")
    names = F.create_map(*[x for i, c in enumerate(dialects) for x in (F.lit(f"_d{i}"), F.lit(c))])
    src, tgt = ("_pivot", "_txt") if reverse else ("_txt", "_pivot")
    return long.select(*ids, F.col(src).alias("src_txt"), F.col(tgt).alias("tgt_txt"),
                       F.element_at(names, F.col("_dk")).alias("dialect"))


def tag_lang(df: DataFrame, joint: bool = True, reverse: bool = False,
             dialect: str = "dialect") -> DataFrame:
    """``src_lang``/``tgt_lang`` tags.  In joint training every dialect is
    ``yor_Latn``; trained separately a dialect gets its own code."""
    if joint:
        code = F.lit(DEFAULT_SOURCE_CODE)
    else:
        short = F.regexp_replace(F.col(dialect), " Dialect$", "")
        m = F.create_map(*[x for k, v in LANG_CODES.items() for x in (F.lit(k), F.lit(v))])
        code = F.coalesce(F.element_at(m, short), F.lit(DEFAULT_SOURCE_CODE))
    src, tgt = (F.lit(ENGLISH_CODE), code) if reverse else (code, F.lit(ENGLISH_CODE))
    return df.withColumns({"src_lang": src, "tgt_lang": tgt})


def union_bitext(*dfs: DataFrame) -> DataFrame:
    """Bag union by name; a source without ``dialect`` gets nulls."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def fold_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """T1 over every (or the given) string column."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"] \
        if cols is None else cols
    return df.withColumns({c: fold_punct(_q(c)) for c in cols})


def with_prompt(df: DataFrame, col: str, prompt: str, out: str | None = None) -> DataFrame:
    """The prompt column ``"{col} prompt"``."""
    return df.withColumn(out or f"{col} prompt", add_prompt(_q(col), prompt))


def long_to_wide(long: DataFrame, row: list[str], group: str, values: list,
                 metrics: list[str], names: dict | None = None, complete: bool = False) -> DataFrame:
    """One row per ``row``; for every group value ``g`` and metric ``m`` a
    column ``"{name(g)} {m}"``.  The pivot values are explicit, so no extra
    job computes them; (row, group) is unique, so ``max`` picks the value.
    ``complete`` makes a group value outside ``values`` an error instead of
    leaving its rows out.
    """
    names = names or {}
    if complete:
        stray = F.concat(F.lit(f"{group} has a value without a column: "), F.coalesce(F.col(group).cast("string"), F.lit("null")))
        long = long.where(F.when(F.col(group).isin(values), True).otherwise(F.raise_error(stray).cast("boolean")))
    aggs = []
    for v in values:
        label = names.get(v, str(v))
        for m in metrics:
            aggs.append(F.max(F.when(F.col(group) == F.lit(v), F.col(m))).alias(f"{label} {m}"))
    return long.groupBy(*row).agg(*aggs)
