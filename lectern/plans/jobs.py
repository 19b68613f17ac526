"""End-to-end jobs composed from the operators.

Each job is one Spark plan per output; the only materialisation points are
after model inference (checkpointed in the shared checkpoint folder, so a
lost executor never re-runs a model) and the vocabulary (a tiny table
needed before label encoding).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators import audio as AU
from ..operators import errors as ER
from ..operators import filters as FL
from ..operators import infer as IN
from ..operators import mt_metrics as MT
from ..operators import reshape as RS
from ..operators import sequence as SQ
from ..operators import vocab as VB
from ..session import materialize
from ..sinks import writers as WR
from ..sources import audio as SA
from ..sources import parallel as PA


def mt_eval(spark: SparkSession, test_path: str, make_model, out_dir: str,
            sources: list[str] | None = None, english: str = "english_text",
            make_scorer=None, prompt: str | None = None, batch_size: int = 16,
            digits: int | None = None) -> dict[str, DataFrame]:
    """Translate every source column, score per row and per column.

    ``prompt`` reproduces the prompted-LM variant (P7, double colon kept).
    Writes the wide table (K1) and the ``{column}_{metric}`` scorecard (K2).
    """
    sources = sources or PA.TEST_COLUMNS[:4]
    # written once: row_id must be the same wherever it is joined by
    wide = materialize(PA.read_parallel(spark, test_path, list(dict.fromkeys([*sources, english]))))
    long = RS.unpivot_dialects(wide, sources, pivot_lang=english, ids=["row_id"])
    model_in = "src_txt"
    if prompt is not None:
        long = long.withColumn("prompt", TX.add_prompt("src_txt", prompt))
        model_in = "prompt"
    hyp = IN.batch_infer(long, [model_in], "translation", make_model, batch_size=batch_size)
    hyp = materialize(hyp)  # inference is never recomputed
    key = ["row_id", "dialect"]
    pairs = hyp.select(*key, "src_txt", F.col("tgt_txt").alias("ref"), F.col("translation").alias("hyp"))
    stats = materialize(MT.pair_stats(pairs, key))  # serves both levels
    scored = pairs.join(MT.sentence_from_stats(stats, key, digits), key)
    metrics = ["translation", "bleu", "chrf"]
    corpus = MT.corpus_from_stats(stats, ["dialect"], digits)
    if make_scorer is not None:
        q = IN.score_pairs(scored.select(*key, F.col("src_txt").alias("src"), F.col("hyp").alias("mt"),
                                         "ref"), make_scorer, batch_size=8)
        q = materialize(q)
        scored = scored.join(q.select(*key, F.col("score").alias("comet")), key)
        corpus = corpus.join(MT.score_summary(q, "score", ["dialect"], digits)
                             .select("dialect", F.col("score_mean").alias("comet")), "dialect")
        metrics.append("comet")
    scored = scored.withColumnRenamed("hyp", "translation")
    out_wide = wide.join(RS.long_to_wide(scored, ["row_id"], "dialect", sources, metrics), "row_id")
    card = MT.scorecard(corpus, "dialect", [m for m in metrics if m != "translation"])
    card = materialize(card)
    WR.write_translations(out_wide, os.path.join(out_dir, "translations"))
    WR.write_scorecard(card, os.path.join(out_dir, "scores"))
    return {"translations": spark.read.parquet(os.path.join(out_dir, "translations")), "scorecard": card,
            "failures": IN.failure_counts(hyp, ["dialect"])}


def asr_eval(spark: SparkSession, root: str, make_model, out_dir: str, batch_size: int = 16,
             split: str | None = None, cap_n: int | None = None, logits: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Scorable clips -> decode at 16 kHz -> transcribe -> four-metric
    report and the REF/HYP file (K3).  The text filter runs before decode.

    ``split`` scores one split only and ``cap_n`` the first clips of it by path
    (L1).  ``logits`` is a vocabulary ``(token, id)`` and its pad id: the model
    then returns per frame one score per id, which are decoded by A3 and A4.
    Rows lost to failed decoding or inference are reported in ``n_failed`` (F3).
    """
    clips = SA.read_audio_folder(spark, root, with_content=True)
    if split is not None:
        clips = SA.select_split(clips, split)
    clips = FL.filter_scorable(clips, "transcription")
    if cap_n is not None:
        clips = FL.cap(clips, cap_n, ["path"])
    # a clip that can't be decoded has no samples, so it never meets the model
    audio = AU.decode_samples(clips, on_error="keep").select(
        "path", "transcription", "samples", "sampling_rate", F.col("error").alias("_decode_error"))
    scores = T.ArrayType(T.ArrayType(T.DoubleType())) if logits else T.StringType()
    hyp = IN.transcribe(audio, ["samples", "sampling_rate"], make_model, batch_size=batch_size, on_error="keep",
                        out_type=scores)
    hyp = hyp.withColumn("error", F.coalesce("_decode_error", "error")).drop("samples", "_decode_error")
    hyp, seen = IN.observed_failures(hyp)  # counted while it is written
    hyp = materialize(hyp)
    lost = seen.get["n_failed"]
    hyp = hyp.where(F.col("error").isNull())
    if logits:
        vocab, pad = logits
        hyp = hyp.withColumn("prediction", SQ.ctc_decode(SQ.argmax_frames("prediction"), VB.token_table(vocab), pad))
    pairs = hyp.select("path", F.col("transcription").alias("ref"), F.col("prediction").alias("hyp"))
    report = materialize(ER.asr_report(pairs).withColumn("n_failed", F.lit(lost)))
    WR.write_pair_report(report, pairs, os.path.join(out_dir, "predictions"), ["path"])
    return report


def prepare_speech(spark: SparkSession, root: str, out_dir: str, min_s: float = 0.0,
                   max_s: float = 20.0, chars=None, range_compat: bool = False,
                   caps: dict[str, int] | None = None) -> DataFrame:
    """E3 (speech): manifest -> caps per split -> target cleaning -> vocabulary
    over all of these clips -> labels -> strict duration filter on the header
    (before any decode) -> decoded, resampled, normalised waveforms -> Parquet by
    split.  ``caps`` keeps the first clips of a split by path (L1).  Clips that can't
    be decoded are left out; the rows of each split, counted while they are
    written, stand in ``counts`` (K5)."""
    clips = SA.read_audio_folder(spark, root)
    for name, n in (caps or {}).items():
        rest = clips.where(F.col("split") != name)
        clips = rest.unionByName(FL.cap(SA.select_split(clips, name), n, ["path"]))
    # the manifest without bytes: three steps use it, the files are read once for it
    clips = materialize(clips.withColumn("target_text", TX.clean_target("transcription", chars, range_compat)))
    vocab = materialize(VB.char_vocab(clips, "target_text"))
    WR.write_vocab(vocab, os.path.join(out_dir, "vocab"))
    kept = FL.filter_duration(clips, min_s=min_s, max_s=max_s)
    labelled = VB.encode_labels(kept, "target_text", vocab)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.wav").load(root).select("path", "content")
    audio = AU.decode_samples(labelled.select("path", "split", "labels").join(content, "path"), on_error="drop")
    prepared = SQ.with_normalized_wave(audio, "samples").drop("samples")
    # durations are re-checked on the resampled length, as the reference does
    prepared = FL.filter_duration(prepared.withColumn("n_samples", F.col("input_length")),
                                  min_s=min_s, max_s=max_s)
    prepared, seen = FL.observed_split_counts(prepared, list(SA.SPLITS))
    prepared.write.mode("overwrite").partitionBy("split").parquet(os.path.join(out_dir, "prepared"))
    counts = spark.createDataFrame(list(seen.get.items()), "split string, n_rows long")
    counts.coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, "counts"))
    return spark.read.parquet(os.path.join(out_dir, "prepared"))


def prepare_text(spark: SparkSession, train_csv: str, extra_tsv: str | None = None,
                 single_dialect: str | None = None, reverse: bool = False,
                 validation_csv: str | None = None, out_dir: str | None = None) -> DataFrame:
    """E3 (text): wide CSV -> long bitext -> union with an extra bitext ->
    punctuation folding, with language tags for the chosen mode.

    A validation table goes through the same steps without the extra bitext and
    is told apart by ``split``.  With ``out_dir`` the rows are written as Parquet
    by split and dialect and the result is a read of them.
    """
    def prepared(csv: str, extra: str | None, split: str) -> DataFrame:
        long = RS.unpivot_dialects(PA.read_parallel(spark, csv, PA.TRAIN_COLUMNS, row_id=None),
                                   RS.resolve_dialects(single_dialect), reverse=reverse)
        parts = [long] + ([PA.read_bitext(spark, extra, reverse=reverse)] if extra else [])
        out = RS.fold_columns(RS.union_bitext(*parts), ["src_txt", "tgt_txt"])
        out = RS.tag_lang(out, joint=single_dialect is None or single_dialect == "Standard", reverse=reverse)
        return out.withColumn("split", F.lit(split))

    out = prepared(train_csv, extra_tsv, "train")
    if validation_csv:
        out = out.unionByName(prepared(validation_csv, None, "validation"))
    if out_dir is None:
        return out
    folder = os.path.join(out_dir, "bitext")
    out.write.mode("overwrite").partitionBy("split", "dialect").parquet(folder)
    return spark.read.parquet(folder)
