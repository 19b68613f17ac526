"""Registered queries over files: audio folders, wide CSV tables and bitext that are
written from the driver tables first, and what is read back from the sinks.

The tables have no audio.  Each embedding becomes a short WAV clip whose rate,
channels and folder follow from its id; that is only a stand-in for files of the
format the readers expect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audio as AU
from ..operators import filters as FL
from ..operators import infer as IN
from ..operators import mt_metrics as MT
from ..operators import sequence as SQ
from ..session import checkpoint_dir
from ..sinks import writers as WR
from ..sources import audio as SA
from ..sources import parallel as PA
from ..sources.tables import table
from . import oracle as O
from . import stub_models as SM
from .catalog import _VOCAB_FULL_SQL, _KEY, _PS, _pairs, _vocab, register


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------
# Clips
def _little(n: Column, width: int) -> Column:
    """Hex digits of a number's bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])


def _clip(samples: Column, rate: Column, channels: Column, bits: int = 16) -> Column:
    """Bytes of a PCM file of 16-bit samples, with a chunk of notes before them."""
    data = F.array_join(F.transform(samples, lambda v: _little(F.pmod(v, F.lit(65536)), 2)), "")
    size = F.size(samples) * 2
    form = F.concat(_little(F.lit(1), 2), _little(channels, 2), _little(rate, 4), _little(rate * channels * 2, 4),
                    _little(channels * 2, 2), _little(F.lit(bits), 2))
    tag = {t: t.encode().hex() for t in ("RIFF", "WAVE", "fmt ", "LIST", "data")}
    body = F.concat(F.lit(tag["WAVE"] + tag["fmt "]), _little(F.lit(16), 4), form, F.lit(tag["LIST"]), _little(F.lit(5), 4), F.lit("0102030405" + "00"),
                    F.lit(tag["data"]), _little(size, 4), data)
    return F.unhex(F.concat(F.lit(tag["RIFF"]), _little((F.length(body) / 2).cast("int"), 4), body))


def _clips(spark, sf) -> DataFrame:
    """``vec_id, name, content, transcription`` of a clip per embedding; every 50th
    is damaged or missing its samples."""
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    rate = F.element_at(F.array(*map(F.lit, (8000, 16000, 44100))), (k % 3 + 1).cast("int"))
    samples = F.transform("embedding", lambda v: F.floor(v.cast("double") * 4096).cast("int"))
    samples = F.when(k % 50 == 3, F.slice(samples, 1, 0)).otherwise(samples)
    content = F.when(k % 50 == 7, F.lit(b"no clip")).otherwise(_clip(samples, rate, (k % 2 + 1).cast("int")))
    split = F.element_at(F.array(*map(F.lit, SA.SPLITS)), (k % 7 % 3 + 1).cast("int"))
    name = F.concat(split, F.lit("/batch "), F.floor(k / 50), F.lit("/clip-"), k, F.lit(".wav"))
    return e.select("vec_id", name.alias("name"), content.alias("content"), F.concat(F.lit('clip "'), k, F.lit('", said')).alias("transcription"))


_RATE = "[8000, 16000, 44100][vec_id % 3 + 1]"
_CLIPS_SQL = f"""SELECT *, CASE WHEN NOT bad THEN {_RATE} END AS rate, CASE WHEN NOT bad THEN (vec_id % 2 + 1)::INTEGER END AS channels,
  CASE WHEN NOT bad THEN len(samples) // (vec_id % 2 + 1) END AS frames,
  ['train', 'validation', 'test'][vec_id % 7 % 3 + 1] AS split FROM (
    SELECT vec_id, vec_id % 50 = 7 AS bad, CASE WHEN vec_id % 50 = 3 THEN [] ELSE list_transform(embedding, lambda v: floor(v::DOUBLE * 4096)) END AS samples
    FROM embeddings)"""


def _audio_folder(spark, sf) -> str:
    """The clips as files below ``<split>/batch n/``, with their ``metadata.csv``."""
    root, clips = _folder(spark, "audio"), _clips(spark, sf)
    WR.write_files(clips, root)
    line = F.concat(F.regexp_extract("name", "([^/]*)$", 1), F.lit(',"'), F.replace("transcription", F.lit('"'), F.lit('""')), F.lit('"\n'))
    tables = (clips.groupBy(F.regexp_replace("name", "[^/]+$", "metadata.csv").alias("name"))
              .agg(F.concat(F.lit("file_name,transcription\n"), F.array_join(F.collect_list(line), "")).cast("binary").alias("content")))
    WR.write_files(tables, root)
    return root


def _vec() -> Column:
    return F.regexp_extract("path", r"clip-(\d+)\.wav$", 1).cast("long").alias("vec_id")


@register("list_audio", f"""
SELECT vec_id, CASE WHEN bad THEN 7 ELSE 44 + 14 + 2 * len(samples) END::BIGINT AS length FROM ({_CLIPS_SQL})""")
def q_list_audio(spark, sf):
    return SA.list_audio(spark, _audio_folder(spark, sf)).select(_vec(), "length")


@register("audio_folder", f"""
SELECT vec_id, split, 'clip "' || vec_id || '", said' AS transcription, rate AS sampling_rate, channels,
  CASE WHEN NOT bad THEN 16 END AS bits, CASE WHEN NOT bad THEN 58 END::BIGINT AS data_offset, frames AS n_samples, frames / rate AS duration
FROM ({_CLIPS_SQL})""")
def q_audio_folder(spark, sf):
    return SA.read_audio_folder(spark, _audio_folder(spark, sf)).select(
        _vec(), "split", "transcription", "sampling_rate", "channels", "bits", "data_offset", "n_samples", "duration")


@register("short_test_clips", f"""
SELECT vec_id, split, frames AS n_samples FROM ({_CLIPS_SQL})
WHERE split = 'test' AND NOT bad AND frames > 0.0005 * rate AND frames < 0.004 * rate""")
def q_short_clips(spark, sf):
    clips = SA.select_split(SA.read_audio_folder(spark, _audio_folder(spark, sf)), "test")
    return FL.filter_duration(clips, min_s=0.0005, max_s=0.004).select(_vec(), "split", "n_samples")


@register("resampled_clips", f"""
SELECT vec_id, CASE WHEN bad THEN 'ValueError: no WAV file' END AS error, CASE WHEN NOT bad THEN 16000 END AS sampling_rate, channels,
  CASE WHEN NOT bad THEN 16 END AS bits, round_even(frames * 16000 / rate, 0)::BIGINT AS n_samples FROM ({_CLIPS_SQL})""")
def q_resampled(spark, sf):
    clips = SA.audio_manifest(spark, _audio_folder(spark, sf), with_content=True).select("path", "content")
    out = AU.resample_audio(clips, on_error="keep")
    h = SA.header_columns(F.col("content"))
    return out.select(_vec(), "error", *[h[c].alias(c) for c in ("sampling_rate", "channels", "bits", "n_samples")])


@register("clip_waves", f"""
WITH c AS (SELECT vec_id, rate, frames, list_transform(range(1, frames + 1),
       lambda i: (CASE WHEN channels = 1 THEN samples[i] ELSE (samples[2 * i - 1] + samples[2 * i]) / 2 END / 32768)::FLOAT::DOUBLE) AS x
     FROM ({_CLIPS_SQL}) WHERE NOT bad),
m AS (SELECT *, list_sum(x) / nullif(frames, 0) AS mean FROM c),
v AS (SELECT *, list_sum(list_transform(x, lambda s: (s - mean) * (s - mean))) / nullif(frames, 0) AS var FROM m)
SELECT vec_id, rate AS sampling_rate, list_transform(x, lambda s: round_even((s - mean) / sqrt(var + 1e-7), 6)) AS input_values,
  frames::INTEGER AS input_length FROM v""")
def q_clip_waves(spark, sf):
    root = _audio_folder(spark, sf)
    clips = SA.audio_manifest(spark, root, with_content=True).select("path", "content")
    waves = SQ.with_normalized_wave(AU.decode_samples(clips, target_rate=None, on_error="drop"), "samples")
    return waves.select(_vec(), "sampling_rate", F.transform("input_values", lambda x: F.bround(x, 6)).alias("input_values"), "input_length")


# --------------------------------------------------------------------------
# S1, S2 - wide tables and bitext through files
def _wide_texts(spark, sf) -> DataFrame:
    """Five columns of turns, in another order than they are read in and beside one
    more; every 9th field of some columns is a missing-value word."""
    c = table(spark, sf, "conversations")
    word = F.element_at(F.array(*map(F.lit, ("NA", "null", ""))), (F.col("conv_id") % 3 + 1).cast("int"))
    texts = [F.max(F.when(F.col("turn") == t, F.col("text"))).alias(n) for t, n in reversed(list(enumerate(PA.TEST_COLUMNS)))]
    wide = c.groupBy("conv_id").agg(*texts)
    return wide.withColumn("ife_text", F.when(F.col("conv_id") % 9 == 4, word).otherwise(F.col("ife_text")))


@register("read_parallel", """
WITH w AS (SELECT conv_id, """ + ", ".join(f"max(text) FILTER (turn = {t}) AS {n}" for t, n in enumerate(PA.TEST_COLUMNS)) + """
           FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS conv_id, std_text, CASE WHEN conv_id % 9 <> 4 THEN ife_text END AS ife_text, ilaje_text, ijebu_text, english_text FROM w""")
def q_read_parallel(spark, sf):
    path = _folder(spark, "wide")
    (_wide_texts(spark, sf).write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return PA.read_parallel(spark, path, ["conv_id", *PA.TEST_COLUMNS], row_id=None)


@register("read_bitext", """
SELECT 'item ' || item_id AS src_txt, CASE WHEN item_id % 6 <> 2 THEN text END AS tgt_txt FROM benchmark""")
def q_read_bitext(spark, sf):
    path = _folder(spark, "bitext")
    b = table(spark, sf, "benchmark").select(F.when(F.col("item_id") % 6 != 2, F.col("text")).alias("first"), F.concat(F.lit("item "), "item_id").alias("second"))
    (b.write.option("header", True).option("sep", "\t").option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return PA.read_bitext(spark, path)


# --------------------------------------------------------------------------
# L1 without groups, I3 over a ledger, K1, K2, K4 read back
@register("first_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 300")
def q_first_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", (-F.col("n_chars")).alias("_shorter"))
    return FL.first_rows(docs, 300, ["_shorter", "doc_id"]).drop("_shorter")


@register("infer_resumed", """
SELECT conv_id, turn, CASE WHEN text <> '' THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS translation,
  CASE WHEN text = '' THEN 'ValueError: empty input' END AS error FROM conversations""")
def q_infer_resumed(spark, sf):
    c, ledger = table(spark, sf, "conversations").select("conv_id", "turn", "text"), _folder(spark, "ledger")

    def run(rows):
        return IN.resumable_infer(rows, _KEY, ["text"], "translation", SM.reverse_words_model, ledger, parts=4, batch_size=10, wait=0.1, retries=1)

    run(c.where("conv_id % 3 = 0"))  # as if a run had been stopped there
    return run(c).drop("text")


@register("vocab_file", f"SELECT token, id FROM ({_VOCAB_FULL_SQL})")
def q_vocab_file(spark, sf):
    path = _folder(spark, "vocab")
    WR.write_vocab(_vocab(spark, sf), path)
    entries = F.explode(F.from_json("value", "map<string,int>")).alias("token", "id")
    return spark.read.option("wholetext", True).text(path).select(entries)


@register("scorecard_file", f"""
WITH w AS (SELECT turn, {O.sentence_bleu_sql(agg=True)} AS bleu, {O.sentence_chrf_sql(agg=True)} AS chrf FROM {_PS} s GROUP BY turn)
SELECT turn || '_bleu' AS key, bleu AS score FROM w UNION ALL SELECT turn || '_chrf', chrf FROM w""")
def q_scorecard_file(spark, sf):
    path = _folder(spark, "scores")
    wide = MT.corpus_scores(_pairs(spark, sf), _KEY, by=["turn"], digits=4)
    WR.write_scorecard(MT.scorecard(wide, "turn", ["bleu", "chrf"]), path)
    entries = F.explode(F.from_json("value", "map<string,double>")).alias("key", "score")
    return spark.read.option("wholetext", True).text(path).select(entries)


@register("translations_file", f"""
SELECT conv_id, turn, ref, hyp, {O.sentence_bleu_sql()} AS bleu, {O.sentence_chrf_sql()} AS chrf
FROM {_PS} s JOIN ({O.CONVERSATION_PAIRS}) p USING (conv_id, turn)""")
def q_translations_file(spark, sf):
    path, pairs = _folder(spark, "translations"), _pairs(spark, sf).select(*_KEY, "ref", "hyp")
    WR.write_translations(pairs.join(MT.sentence_scores(pairs, _KEY, digits=4), _KEY), path)
    return spark.read.parquet(path)
