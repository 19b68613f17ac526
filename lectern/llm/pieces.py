"""SentencePiece encoding with source offsets, and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import map_rows, pairs
from lectern.llm.subword import PieceEncoder

_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``ids`` (the end id last), ``begins`` and
    ``ends`` (each id's span in the text's UTF-8 bytes; the end id's is empty at
    the text's end) and ``decoded`` (the library's decoding of ``ids``).

    A piece that stands for a rewritten prefix spans all of that prefix; the
    bytes of a byte-fallback character each span the whole character.  Null
    and empty texts give the end id alone and decode to the empty text.  Null
    ids and repeated rows are kept as they are; an empty table gives no rows;
    other columns are not read.
    """

    def fn(keys, datas):
        coder = _encoder(model)
        got = coder.encode(datas)
        ids = [g[0] for g in got]
        decoded = coder.sp.decode([x.tolist() for x in ids], num_threads=1)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([g[k] for g in got]), pa.int32())) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists, pa.array(decoded, pa.string())],
                                          names=["id", "ids", "begins", "ends", "decoded"])

    return map_rows(pairs(df, id_col, text_col), fn,
                    "id long, ids array<int>, begins array<int>, ends array<int>, decoded string")
