"""W2/A6 audio work that needs sample values: decode, resample, features.

Per clip numpy inside ``mapInPandas``: Spark partitions the clips, Arrow moves
them in batches, each task decodes its own files.  The output is a new
dataset (the reference overwrote files in place).

``on_error`` says what a clip does that can't be decoded (null or damaged bytes,
another sample format): ``"fail"`` stops the job, ``"keep"`` leaves null results
and the reason in ``error``, ``"drop"`` leaves the clip out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wav

TARGET_RATE = 16000
ON_ERROR = ("fail", "keep", "drop")


def _each_clip(df: DataFrame, content: str, keep: list[T.StructField], made: list[T.StructField],
               clip: Callable[[bytes], tuple], on_error: str) -> DataFrame:
    """The columns ``keep`` beside those that ``clip`` makes of each row's bytes."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}")
    names, new = [f.name for f in keep], [f.name for f in made]
    error = T.StructField("_clip_error", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf[content]:
                try:
                    if data is None:
                        raise ValueError("no bytes")
                    rows.append((*clip(bytes(data)), None))
                except Exception as e:  # noqa: BLE001 - recorded per clip below
                    if on_error == "fail":
                        raise
                    rows.append((*[None] * len(new), f"{type(e).__name__}: {e}"))
            out = pdf[names].copy()
            for name, values in zip([*new, error.name], zip(*rows) if rows else [()] * (len(new) + 1)):
                out[name] = pd.Series(list(values), index=out.index, dtype=object)
            yield out

    out = df.mapInPandas(run, T.StructType([*keep, *made, error]))
    if on_error == "keep":  # in place of an input column of that name
        return out.withColumn("error", F.col(error.name)).drop(error.name)
    return (out.where(F.col(error.name).isNull()) if on_error == "drop" else out).drop(error.name)


def decode_samples(df: DataFrame, content: str = "content", target_rate: int | None = TARGET_RATE, on_error: str = "fail") -> DataFrame:
    """Decode (and resample) every clip: adds ``samples array<float>`` (the mean of
    all channels), ``sampling_rate int`` and ``n_samples int``; drops the raw
    bytes.  A clip without samples has an empty array."""
    made = [T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("sampling_rate", T.IntegerType()),
            T.StructField("n_samples", T.IntegerType())]
    keep = [f for f in df.schema.fields if f.name not in (content, *[m.name for m in made])]

    def clip(data: bytes) -> tuple:
        x, form = wav.decode(data)
        x = x.mean(axis=1, keepdims=True)
        x = wav.resample(x, form.rate, target_rate or form.rate)[:, 0]
        return x.astype(np.float32), target_rate or form.rate, len(x)

    return _each_clip(df, content, keep, made, clip, on_error)


def resample_audio(df: DataFrame, content: str = "content", rate: int = TARGET_RATE, on_error: str = "fail") -> DataFrame:
    """Every clip at ``rate``, with the channels and the sample format it has.
    Clips already at the rate are passed through unchanged, so the job is
    idempotent."""
    def clip(data: bytes) -> tuple:
        x, form = wav.decode(data)
        return (data if form.rate == rate else wav.encode(wav.resample(x, form.rate, rate), replace(form, rate=rate)),)

    order = df.columns
    keep = [f for f in df.schema.fields if f.name != content]
    out = _each_clip(df, content, keep, [T.StructField(content, T.BinaryType())], clip, on_error)
    return out.select(*order, *[c for c in out.columns if c not in order])
