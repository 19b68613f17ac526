"""Batched model application through Arrow (``mapInPandas``).

A model is a picklable zero-argument factory returning ``f(list) -> list``
(one output per input, same order).  The factory runs once per Python worker,
which keeps the model for all of its tasks; rows are fed in slices of
``batch_size``.  A row with a null input never reaches the model: its output is
null and it is no failure.  ``on_error`` decides what a failing slice does:
``"fail"`` raises, ``"keep"`` retries the slice row by row and records the error
text per row, ``"drop"`` does the same and then removes the failed rows (F3).
Inference is the expensive, non-repeatable step: checkpoint its output
(:func:`lectern.session.materialize`) before scoring so a lost executor never
re-runs the model, or keep a ledger (:func:`resumable_infer`) so that a lost
job doesn't either.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_spaced
from ..session import materialize

ModelFactory = Callable[[], Callable[[list], list]]
#: Longest wait between two tries, in seconds.
LONGEST_WAIT = 60.0


def _tried(fn, chunk: list, retries: int, wait: float) -> list:
    """``fn(chunk)``, tried again after a wait that doubles each time."""
    for k in range(retries + 1):
        try:
            got = list(fn(chunk))
            if len(got) != len(chunk):
                raise ValueError(f"model returned {len(got)} outputs for {len(chunk)} inputs")
            return got
        except Exception:  # noqa: BLE001 - the caller records it
            if k == retries:
                raise
            if wait:
                time.sleep(min(wait * 2 ** k, LONGEST_WAIT))
    return []


def _apply(fn, values: list, batch_size: int, on_error: str, retries: int, wait: float = 0.0):
    outs, errs = [], []
    for i in range(0, len(values), batch_size):
        chunk = values[i:i + batch_size]
        try:
            outs.extend(_tried(fn, chunk, retries, wait))
            errs.extend([None] * len(chunk))
            continue
        except Exception:  # noqa: BLE001 - recorded per row below
            if on_error == "fail":
                raise
        for v in chunk:  # isolate the failing rows
            try:
                outs.extend(_tried(fn, [v], 0, 0.0))
                errs.append(None)
            except Exception as e:  # noqa: BLE001
                outs.append(None)
                errs.append(f"{type(e).__name__}: {e}")
    return outs, errs


def _is_null(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and v != v)


def batch_infer(df: DataFrame, in_cols: list[str], out: str, make_fn: ModelFactory,
                out_type: T.DataType = T.StringType(), batch_size: int = 16,
                on_error: str = "keep", retries: int = 0,
                concurrency: int | None = None, wait: float = 0.0, profile: ResourceProfile | None = None) -> DataFrame:
    """Apply a model to ``in_cols`` in batches.

    One input column passes values; several pass tuples.  A row with a null (or
    NaN) in any of them is not sent and gets null.  ``concurrency``
    bounds the number of simultaneous model clients (a rate-limited remote
    service) by repartitioning to that many tasks first.  A slice that fails is
    sent again up to ``retries`` times, after ``wait`` seconds, then twice as long,
    and so on.  ``profile`` asks for executors with what the model needs (GPUs,
    memory) where the cluster schedules by stage.
    """
    if on_error not in ("fail", "keep", "drop"):
        raise ValueError("on_error must be fail, keep or drop")
    schema = T.StructType(df.schema.fields + [T.StructField(out, out_type, True),
                                              T.StructField("error", T.StringType(), True)])
    src = df.repartition(concurrency) if concurrency else df
    model = uuid.uuid4()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark.ml.model_cache import ModelCache

        fn = ModelCache.get(model)
        if fn is None:
            fn = make_fn()
            ModelCache.add(model, fn)
        for pdf in batches:
            if len(in_cols) == 1:
                vals = pdf[in_cols[0]].tolist()
                sent = [k for k, v in enumerate(vals) if not _is_null(v)]
            else:
                vals = list(zip(*[pdf[c].tolist() for c in in_cols]))
                sent = [k for k, v in enumerate(vals) if not any(map(_is_null, v))]
            outs, errs = [None] * len(vals), [None] * len(vals)
            for k, o, e in zip(sent, *_apply(fn, [vals[k] for k in sent], batch_size, on_error, retries, wait)):
                outs[k], errs[k] = o, e
            pdf = pdf.copy()
            pdf[out] = pd.Series(outs, index=pdf.index, dtype=object)
            pdf["error"] = pd.Series(errs, index=pdf.index, dtype=object)
            yield pdf

    res = src.mapInPandas(run, schema, profile=profile)
    if on_error == "drop":
        res = res.where(F.col("error").isNull())
    return res


def _read_ledger(df: DataFrame, ledger: str, schema: T.StructType) -> DataFrame:
    spark = df.sparkSession
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def resumable_infer(df: DataFrame, key: list[str], in_cols: list[str], out: str, make_fn: ModelFactory, ledger: str,
                    out_type: T.DataType = T.StringType(), parts: int = 16, retry_failed: bool = True, **options) -> DataFrame:
    """I3 as a job that can be stopped: ``batch_infer`` over a written ledger.

    Results are appended to the Parquet folder ``ledger`` in ``parts`` commits.  A
    row whose ``key`` and inputs stand in the ledger is not sent again; a run that
    was stopped goes on with what is missing, at most the part that was under
    way.  A changed input is a new row; rows repeated with key and inputs are
    sent once.  Failed rows are tried again by the next run unless
    ``retry_failed`` is false.  Returns ``df`` with ``out`` and ``error`` as the
    ledger has them, whatever run made them.
    """
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField(out, out_type), T.StructField("error", T.StringType())])
    named = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*key, *in_cols])])
    rows = df.withColumn("_id", F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256))
    done = _read_ledger(df, ledger, schema)
    done = done.where(F.col("error").isNull()) if retry_failed else done
    todo = rows.select("_id", *dict.fromkeys(in_cols)).join(done.select("_id"), "_id", "left_anti").dropDuplicates(["_id"])
    # the rows of all parts are settled before the first part is written
    todo = materialize(todo.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts))))
    for k in sorted(r["_part"] for r in todo.select("_part").distinct().collect()):
        part = todo.where(F.col("_part") == k).drop("_part")
        batch_infer(part, in_cols, out, make_fn, out_type, **options).select(*schema.names).write.mode("append").parquet(ledger)
    # a row that failed first and worked later has two entries
    best = _read_ledger(df, ledger, schema).groupBy("_id").agg(F.min_by(F.struct(out, "error"), F.col("error").isNotNull()).alias("_found"))
    return rows.join(best, "_id", "left").select(*[F.col(f"`{c}`") for c in df.columns], f"_found.{out}", "_found.error")


def _failures() -> list:
    failed = F.col("error").isNotNull()
    return [F.count_if(failed).alias("n_failed"), F.count_if(~failed).alias("n_kept")]


def observed_failures(inferred: DataFrame) -> tuple[DataFrame, Observation]:
    """F3 without a pass of its own: the rows, and an observation that has
    ``n_failed`` and ``n_kept`` once they were written or checkpointed."""
    seen = Observation(f"inference-{uuid.uuid4().hex}")
    return inferred.observe(seen, *_failures()), seen


def failure_counts(inferred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows kept and rows lost to failed inference, from an ``on_error="keep"``
    result, per group."""
    return inferred.groupBy(*(by or [])).agg(*_failures())


def transcribe(df: DataFrame, audio_cols: list[str], make_fn: ModelFactory, out: str = "prediction",
               batch_size: int = 16, on_error: str = "drop", out_type: T.DataType = T.StringType()) -> DataFrame:
    """I4: ASR over audio rows; the model gets ``(samples, sampling_rate)`` tuples
    and returns texts, or frames of scores (``out_type``) for A3 and A4."""
    return batch_infer(df, audio_cols, out, make_fn, out_type, batch_size, on_error)


def score_pairs(df: DataFrame, make_fn: ModelFactory, src: str = "src", mt: str = "mt",
                ref: str = "ref", out: str = "score", batch_size: int = 8, spaced: bool = False) -> DataFrame:
    """Learned quality score from ``(src, mt, ref)`` triples -> DOUBLE.
    ``spaced`` gives the model source and translation character by character
    (T6) and the reference as it is."""
    if not spaced:
        return batch_infer(df, [src, mt, ref], out, make_fn, T.DoubleType(), batch_size, "keep")
    views = df.withColumns({"_src": char_spaced(src), "_mt": char_spaced(mt)})
    return batch_infer(views, ["_src", "_mt", ref], out, make_fn, T.DoubleType(), batch_size, "keep").drop("_src", "_mt")
