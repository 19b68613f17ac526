"""Incremental corpus scoring with Structured Streaming.

Every per-pair statistic in this package is additive, so a running corpus
WER, CER, BLEU or chrF is a streaming ``groupBy(...).agg(sum)`` over the per-pair rows: the
state is one row of sums per group, however long the stream runs.  The
per-pair step is the same stateless expression used in batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.errors import _rates, error_stats
from ..operators.mt_metrics import corpus_from_stats
from ..operators.ngram import row_statistics


def running_error_rates(pairs_stream: DataFrame, by: list[str], ref: str = "ref",
                        hyp: str = "hyp", digits: int | None = 2) -> DataFrame:
    """Streaming WER/CER per group over a stream of ``(by..., ref, hyp)`` rows
    (use ``outputMode('complete')`` or ``'update'``)."""
    valid = pairs_stream.where(F.col(ref).isNotNull() & F.col(hyp).isNotNull())
    st = error_stats(valid.select(*by, ref, hyp), {"": (ref, hyp)})
    return st.groupBy(*by).agg(*_rates(["wer", "cer"], digits), F.count(F.lit(1)).alias("n_pairs"))


def running_translation_scores(pairs_stream: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp",
                               digits: int | None = None) -> DataFrame:
    """Streaming corpus BLEU and chrF per group, with the pairs scored and those
    skipped for a null side; every row of the stream counts."""
    return corpus_from_stats(row_statistics(pairs_stream, ref, hyp, keep=by), by, digits)


def start_scoring(pairs_stream: DataFrame, by: list[str], checkpoint: str, sink, scores=running_error_rates):
    """Start the running score with a checkpoint folder (fault-tolerant state).

    ``sink`` is a ``foreachBatch`` function ``(batch_df, epoch_id)`` that gets the
    groups a batch changed; ``scores`` is one of the functions above.
    """
    agg = scores(pairs_stream, by)
    return agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
