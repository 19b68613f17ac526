"""Registered queries: each is a Spark plan over the driver tables plus the
DuckDB SQL that computes the same result (the correctness oracle).

Every query reads whole tables; grouping keys are real columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import align as AL
from ..operators import errors as ER
from ..session import materialize
from ..sources.tables import table
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


_KEY = ["conv_id", "turn"]


def _pairs(spark, sf):
    return AL.conversation_pairs(table(spark, sf, "conversations"))


# --------------------------------------------------------------------------
# J1 - pairs aligned by key
@register("align_pairs", f"SELECT conv_id, turn, ref, hyp FROM ({O.CONVERSATION_PAIRS})")
def q_align_pairs(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", "ref", "hyp")


# --------------------------------------------------------------------------
# M1-M3 - error rates
def _err_sql(by: list[str], kinds=("wer", "cer"), normalized=False, pairs_count=False) -> str:
    gb = ", ".join(by)
    sel_by = (gb + ", ") if by else ""
    sides = {"": ("ref", "hyp")}
    norm_cols = ""
    if normalized:
        sides["norm_"] = ("nref", "nhyp")
        norm_cols = f", {O.normalize('ref')} AS nref, {O.normalize('hyp')} AS nhyp"
    tok, stats, rates = [], [], []
    for p, (r, h) in sides.items():
        tok += [f"{O.wer_words(r)} AS {p}rw", f"{O.wer_words(h)} AS {p}hw",
                f"{O.collapse_strip(r)} AS {p}rc", f"{O.collapse_strip(h)} AS {p}hc"]
    for p in sides:
        if "wer" in kinds:
            stats += [f"{O.edit_distance(p + 'rw', p + 'hw', p + 'wd')} AS {p}wer_err", f"len({p}rw) AS {p}wer_n"]
        if "cer" in kinds:
            stats += [f"{O.edit_distance(p + 'rcl', p + 'hcl', p + 'cd')} AS {p}cer_err", f"length({p}rc) AS {p}cer_n"]
    chars = ", ".join(f"{O.chars(p + 'rc')} AS {p}rcl, {O.chars(p + 'hc')} AS {p}hcl" for p in sides)
    dist = ", ".join(f"{O.distinct_tokens(p + 'rw', p + 'hw')} AS {p}wd, "
                     f"{O.distinct_tokens(p + 'rcl', p + 'hcl')} AS {p}cd" for p in sides)
    order = [k for k in ("wer", "norm_wer", "cer", "norm_cer")
             if k.replace("norm_", "") in kinds and (normalized or not k.startswith("norm_"))]
    rates = [f"{O.rate(k + '_err', k + '_n')} AS {k}" for k in order]
    if pairs_count:
        rates.append("count(*) AS n_pairs")
    return f"""
WITH p AS ({O.CONVERSATION_PAIRS}),
n AS (SELECT {sel_by}ref, hyp{norm_cols} FROM p WHERE ref IS NOT NULL AND hyp IS NOT NULL),
t AS (SELECT {sel_by}{', '.join(tok)} FROM n),
c AS (SELECT *, {chars} FROM t),
d AS (SELECT *, {dist} FROM c),
s AS (SELECT {sel_by}{', '.join(stats)} FROM d)
SELECT {sel_by}{', '.join(rates)} FROM s {('GROUP BY ' + gb) if by else ''}
"""


@register("asr_report", _err_sql(["turn"], normalized=True, pairs_count=True))
def q_asr_report(spark, sf):
    return ER.asr_report(_pairs(spark, sf), by=["turn"], key=_KEY)


@register("wer_corpus", _err_sql([], kinds=("wer",)))
def q_wer_corpus(spark, sf):
    return ER.wer(_pairs(spark, sf), key=_KEY)


@register("cer_by_turn", _err_sql(["turn"], kinds=("cer",)))
def q_cer_by_turn(spark, sf):
    return ER.cer(_pairs(spark, sf), by=["turn"], key=_KEY)


# --------------------------------------------------------------------------
# M4-M7, M11, P8/K1 - BLEU and chrF
from ..operators import mt_metrics as MT  # noqa: E402

_PS = O.pair_stats_sql(O.CONVERSATION_PAIRS, _KEY)


@register("sentence_bleu_chrf", f"""
SELECT conv_id, turn, {O.sentence_bleu_sql()} AS bleu, {O.sentence_chrf_sql()} AS chrf
FROM {_PS} s""")
def q_sentence_scores(spark, sf):
    return MT.sentence_scores(_pairs(spark, sf), _KEY, digits=4)


@register("corpus_bleu_chrf_by_turn", f"""
SELECT turn, {O.sentence_bleu_sql(agg=True)} AS bleu, {O.sentence_chrf_sql(agg=True)} AS chrf,
       count(*) AS n_pairs, 0::BIGINT AS n_skipped
FROM {_PS} s GROUP BY turn""")
def q_corpus_scores(spark, sf):
    return MT.corpus_scores(_pairs(spark, sf), _KEY, by=["turn"], digits=4)


# null sides and a null group, made of the pairs' own columns
_SPARSE_SQL = f"""SELECT conv_id, turn, CASE WHEN turn % 4 <> 0 THEN turn END AS grp,
  CASE WHEN length(ref) % 5 <> 0 THEN ref END AS ref, CASE WHEN length(hyp) % 7 <> 0 THEN hyp END AS hyp
FROM ({O.CONVERSATION_PAIRS})"""
_SPARSE_PS = O.pair_stats_sql(f"SELECT * FROM ({_SPARSE_SQL}) WHERE ref IS NOT NULL AND hyp IS NOT NULL", _KEY)


def _sparse_pairs(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn", F.when(F.col("turn") % 4 != 0, F.col("turn")).alias("grp"),
        F.when(F.length("ref") % 5 != 0, F.col("ref")).alias("ref"), F.when(F.length("hyp") % 7 != 0, F.col("hyp")).alias("hyp"))


@register("corpus_scores_sparse", f"""
WITH a AS ({_SPARSE_SQL}),
s AS (SELECT grp, {O.sentence_bleu_sql(agg=True)} AS bleu, {O.sentence_chrf_sql(agg=True)} AS chrf
      FROM {_SPARSE_PS} s JOIN a USING (conv_id, turn) GROUP BY grp),
n AS (SELECT grp, count(*) FILTER (WHERE ref IS NOT NULL AND hyp IS NOT NULL) AS n_pairs,
             count(*) FILTER (WHERE ref IS NULL OR hyp IS NULL) AS n_skipped FROM a GROUP BY grp)
SELECT n.grp, s.bleu, s.chrf, n.n_pairs, n.n_skipped FROM n LEFT JOIN s ON n.grp IS NOT DISTINCT FROM s.grp""")
def q_corpus_scores_sparse(spark, sf):
    return MT.corpus_scores(_sparse_pairs(spark, sf), _KEY, by=["grp"], digits=4)


@register("sentence_scores_sparse", f"""
SELECT a.conv_id, a.turn, s.bleu, s.chrf FROM ({_SPARSE_SQL}) a LEFT JOIN (
  SELECT conv_id, turn, {O.sentence_bleu_sql()} AS bleu, {O.sentence_chrf_sql()} AS chrf FROM {_SPARSE_PS} s) s
USING (conv_id, turn)""")
def q_sentence_scores_sparse(spark, sf):
    return MT.sentence_scores(_sparse_pairs(spark, sf), _KEY, digits=4)


@register("corpus_bleu", f"SELECT {O.sentence_bleu_sql(agg=True)} AS bleu FROM {_PS} s")
def q_corpus_bleu(spark, sf):
    return MT.bleu(_pairs(spark, sf), _KEY, digits=4)


@register("scorecard", f"""
WITH w AS (SELECT turn, {O.sentence_bleu_sql(agg=True)} AS bleu, {O.sentence_chrf_sql(agg=True)} AS chrf
           FROM {_PS} s GROUP BY turn)
SELECT turn, metric, score, concat_ws('_', replace(CAST(turn AS VARCHAR), ' ', '_'), metric) AS key
FROM (SELECT turn, 'bleu' AS metric, bleu AS score FROM w
      UNION ALL SELECT turn, 'chrf', chrf FROM w)""")
def q_scorecard(spark, sf):
    wide = MT.corpus_scores(_pairs(spark, sf), _KEY, by=["turn"], digits=4)
    return MT.scorecard(wide, "turn", ["bleu", "chrf"])


# --------------------------------------------------------------------------
# T1-T4, P7, F1 - text functions over whole tables
from ..functions import tokenize as TK  # noqa: E402
from ..operators import filters as FL  # noqa: E402
from ..operators import reshape as RS  # noqa: E402
from ..operators import sequence as SQ  # noqa: E402
from ..operators import vocab as VB  # noqa: E402
from ..functions.regex import escape_class_chars  # noqa: E402


@register("fold_punct", f"""
SELECT doc_id, translate(text, {O.q(TX.PUNCT_FROM)}, {O.q(TX.PUNCT_TO)}) AS text FROM documents""")
def q_fold_punct(spark, sf):
    return RS.fold_columns(table(spark, sf, "documents").select("doc_id", "text"), ["text"])


_IGN = "[" + escape_class_chars("".join(TX.CHARS_TO_IGNORE)) + "]"
_IGN_COMPAT = "[" + "".join(TX.CHARS_TO_IGNORE) + "]"


@register("clean_target", f"""
SELECT conv_id, turn,
  lower(regexp_replace(text, {O.q(_IGN)}, '', 'g')) || ' ' AS target,
  lower(regexp_replace(text, {O.q(_IGN_COMPAT)}, '', 'g')) || ' ' AS target_compat
FROM conversations""")
def q_clean_target(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.clean_target("text").alias("target"),
                    TX.clean_target("text", range_compat=True).alias("target_compat"))


@register("normalize_pages", f"SELECT page_id, {O.normalize('html')} AS norm_text FROM pages")
def q_normalize_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", TX.basic_normalize("html").alias("norm_text"))


@register("filter_scorable", f"""
SELECT conv_id, turn, text FROM conversations
WHERE {O.trim('text')} <> '' AND {O.trim('text')} <> {O.q(TX.IGNORE_SEGMENT)}""")
def q_filter_scorable(spark, sf):
    return FL.filter_scorable(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "text")


# texts made blank or the sentinel, with blanks around them, by row
_MIXED_SQL = f"""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '  ' || chr(9) WHEN 1 THEN ' {TX.IGNORE_SEGMENT} '
  WHEN 2 THEN '{TX.IGNORE_SEGMENT} ' || text ELSE text END AS text FROM conversations"""


@register("filter_scorable_mixed", f"""
SELECT conv_id, turn, text FROM ({_MIXED_SQL})
WHERE {O.trim('text')} <> '' AND {O.trim('text')} <> {O.q(TX.IGNORE_SEGMENT)}""")
def q_filter_scorable_mixed(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    text = (F.when(kind == 0, F.lit("  \t")).when(kind == 1, F.lit(f" {TX.IGNORE_SEGMENT} "))
            .when(kind == 2, F.concat(F.lit(f"{TX.IGNORE_SEGMENT} "), F.col("text"))).otherwise(F.col("text")))
    mixed = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))
    return FL.filter_scorable(mixed, "text")


@register("strip_text", f"SELECT doc_id, {O.trim('text')} AS text FROM documents")
def q_strip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.unicode_trim("text").alias("text"))


@register("tokenize_13a", f"SELECT item_id, {O.tokenize_13a('text')} AS tokens FROM benchmark")
def q_tokenize_13a(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", TK.tokenize_13a("text").alias("tokens"))


@register("add_prompt", """
SELECT conv_id, turn, 'Translate to English: : ' || text AS "text prompt" FROM conversations""")
def q_add_prompt(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return RS.with_prompt(c, "text", "Translate to English: ").select("conv_id", "turn", "text prompt")


@register("char_spaced", f"""
SELECT item_id, array_to_string({O.chars('text')}, ' ') AS spaced FROM benchmark""")
def q_char_spaced(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", TX.char_spaced("text").alias("spaced"))


# --------------------------------------------------------------------------
# P1-P4, P8, U1 - reshape
_TURNS = list(range(8))  # a row of eight turns each: longer conversations have more rows
_WIDE_SQL = ("SELECT conv_id, turn // 8 AS part, " + ", ".join(
    f'max(CASE WHEN turn % 8 = {t} THEN text END) AS "t{t} text"' for t in _TURNS)
    + " FROM conversations GROUP BY conv_id, turn // 8")


def _wide(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 8).alias("part"), (F.col("turn") % 8).alias("turn"), "text")
    return RS.long_to_wide(turns, ["conv_id", "part"], "turn", _TURNS,
                           ["text"], names={t: f"t{t}" for t in _TURNS}, complete=True)


@register("wide_conversations", _WIDE_SQL)
def q_wide(spark, sf):
    return _wide(spark, sf)


_DIALECTS = [f"t{t} text" for t in _TURNS if t != 1]  # t1 is the pivot


@register("unpivot_dialects", f"""
WITH w AS ({_WIDE_SQL})
""" + " UNION ALL ".join(
    f"""SELECT conv_id, part, "{d}" AS src_txt, "t1 text" AS tgt_txt, '{d}' AS dialect,
       'yor_Latn' AS src_lang, 'eng_Latn' AS tgt_lang FROM w""" for d in _DIALECTS))
def q_unpivot(spark, sf):
    long = RS.unpivot_dialects(_wide(spark, sf), _DIALECTS, pivot_lang="t1 text", ids=["conv_id", "part"])
    return RS.tag_lang(long, joint=False)


_CODES = {"Ife Dialect": "ife_Yoru", "Ilaje Dialect": "ila_Yoru", "Ijebu Dialect": "ije_Yoru", "Standard Yoruba": "yor_Latn"}
_NAMES_SQL = f"list_value({', '.join(O.q(d) for d in RS.DIALECT_COLUMNS)})[turn % 4 + 1]"


@register("tag_lang", f"""
SELECT conv_id, turn, dialect, 'eng_Latn' AS src_lang,
  CASE dialect {' '.join(f"WHEN {O.q(d)} THEN {O.q(c)}" for d, c in _CODES.items())} END AS tgt_lang
FROM (SELECT conv_id, turn, {_NAMES_SQL} AS dialect FROM conversations)""")
def q_tag_lang(spark, sf):
    names = F.array(*[F.lit(d) for d in RS.DIALECT_COLUMNS])
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.get(names, (F.col("turn") % 4).cast("int")).alias("dialect"))
    return RS.tag_lang(c, joint=False, reverse=True)


@register("unpivot_reverse", f"""
WITH w AS ({_WIDE_SQL})
""" + " UNION ALL ".join(
    f"""SELECT conv_id, part, "t1 text" AS src_txt, "{d}" AS tgt_txt, '{d}' AS dialect FROM w"""
    for d in _DIALECTS))
def q_unpivot_reverse(spark, sf):
    return RS.unpivot_dialects(_wide(spark, sf), _DIALECTS, pivot_lang="t1 text",
                               reverse=True, ids=["conv_id", "part"])


@register("union_bitext", f"""
WITH w AS ({_WIDE_SQL}),
l AS (""" + " UNION ALL ".join(
    f"""SELECT conv_id, part, "{d}" AS src_txt, "t1 text" AS tgt_txt, '{d}' AS dialect FROM w"""
    for d in _DIALECTS) + """)
SELECT conv_id, part, src_txt, tgt_txt, dialect FROM l
UNION ALL SELECT NULL, NULL, text, CAST(item_id AS VARCHAR), NULL FROM benchmark""")
def q_union_bitext(spark, sf):
    long = RS.unpivot_dialects(_wide(spark, sf), _DIALECTS, pivot_lang="t1 text", ids=["conv_id", "part"])
    b = table(spark, sf, "benchmark")
    # positional two-column bitext: first column is the target, second the source
    bitext = b.select(F.col("item_id").cast("string"), "text").toDF("tgt_txt", "src_txt")
    return RS.union_bitext(long, bitext)


# --------------------------------------------------------------------------
# L1, K5/M13 - caps and counts
@register("cap_per_lang", """
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= 50""")
def q_cap(spark, sf):
    return FL.cap(table(spark, sf, "documents").select("doc_id", "lang"), 50, ["doc_id"], ["lang"])


@register("split_counts", """
SELECT lang, count(*) AS n_rows, least(100, count(*)) AS samples FROM documents GROUP BY lang""")
def q_split_counts(spark, sf):
    return FL.split_counts(table(spark, sf, "documents"), "lang", cap_n=100)


# --------------------------------------------------------------------------
# M9, A1, A2, A5, M10 - vocabulary and labels
_TARGET_SQL = f"SELECT conv_id, turn, lower(regexp_replace(text, {O.q(_IGN)}, '', 'g')) || ' ' AS target FROM conversations"
def _targets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", TX.clean_target("text").alias("target"))


def _vocab(spark, sf):
    # a small table reused by several steps: checkpointed once (shared folder)
    return materialize(VB.char_vocab(_targets(spark, sf), "target"))


_VOCAB_FULL_SQL = f"""
WITH c AS (SELECT DISTINCT unnest({O.chars('target')}) AS token FROM ({_TARGET_SQL})),
r AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS id FROM c),
s AS (SELECT max(CASE WHEN token = ' ' THEN 1 ELSE 0 END) AS sp FROM r),
k AS (SELECT CASE WHEN token = ' ' THEN '|' ELSE token END AS token, id FROM r, s
      WHERE NOT (token = '|' AND sp = 1)),
m AS (SELECT coalesce(max(id), -1) AS mx FROM k)
SELECT token, id FROM k
UNION ALL SELECT '[UNK]', (mx + 1)::INTEGER FROM m
UNION ALL SELECT '[PAD]', (mx + 2)::INTEGER FROM m"""


@register("char_vocab", _VOCAB_FULL_SQL)
def q_char_vocab(spark, sf):
    return _vocab(spark, sf)


_LABELS_SQL = f"""
WITH v AS ({_VOCAB_FULL_SQL}),
vm AS (SELECT map(list(token), list(id)) AS m, max(CASE WHEN token = '[UNK]' THEN id END) AS unk FROM v)
SELECT conv_id, turn,
  list_transform({O.chars('target')}, lambda ch: coalesce(vm.m[CASE WHEN ch = ' ' THEN '|' ELSE ch END], vm.unk)) AS labels
FROM ({_TARGET_SQL}) t, vm"""


def _labels(spark, sf, vocab):
    return VB.encode_labels(_targets(spark, sf), "target", vocab).select("conv_id", "turn", "labels")


@register("encode_labels", _LABELS_SQL)
def q_encode_labels(spark, sf):
    return _labels(spark, sf, _vocab(spark, sf))


_PAD_SQL = f"""
WITH l AS ({_LABELS_SQL}),
b AS (SELECT *, max(len(labels)) OVER (PARTITION BY conv_id) AS mx FROM l),
v AS ({_VOCAB_FULL_SQL}),
pv AS (SELECT id AS pad_id FROM v WHERE token = '[PAD]')
SELECT conv_id, turn,
  list_concat(labels, list_transform(range(mx - len(labels)), lambda x: -100)) AS labels_padded,
  list_concat(list_transform(range(len(labels)), lambda x: 1), list_transform(range(mx - len(labels)), lambda x: 0)) AS attention_mask,
  list_transform(list_concat(labels, list_transform(range(mx - len(labels)), lambda x: -100)),
                 lambda x: CASE WHEN x = -100 THEN pv.pad_id ELSE x END) AS labels_unmasked
FROM b, pv"""


def _padded(spark, sf):
    vocab = _vocab(spark, sf)
    pad_id = vocab.where(F.col("token") == VB.PAD_TOKEN).select("id").first().id  # one scalar
    p = SQ.pad_batch(_labels(spark, sf, vocab), "conv_id", "labels", out="labels_padded")
    return p.select("conv_id", "turn", "labels_padded", "attention_mask",
                    SQ.unmask("labels_padded", pad_id).alias("labels_unmasked"))


@register("pad_labels", _PAD_SQL)
def q_pad_labels(spark, sf):
    return _padded(spark, sf)


@register("gen_len", f"""
WITH p AS ({_PAD_SQL})
SELECT round_even(avg(len(list_filter(labels_padded, lambda x: x <> -100))), 4) AS gen_len FROM p""")
def q_gen_len(spark, sf):
    return MT.gen_len(_padded(spark, sf), "labels_padded", SQ.IGNORE_INDEX)


# --------------------------------------------------------------------------
# A3, A4, A6 - arrays from the embeddings table
_W = 8  # frame width: the embedding vector read as frames x 8 scores
_FRAMES_SQL = f"""
SELECT vec_id, list_transform(range(0, len(embedding) // {_W}),
  lambda f: list_position(embedding[f * {_W} + 1 : f * {_W} + {_W}], list_max(embedding[f * {_W} + 1 : f * {_W} + {_W}])) - 1) AS frame_ids
FROM embeddings"""


def _frame_ids(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", SQ.argmax_frames(SQ.frames("embedding", _W)).alias("frame_ids"))


@register("argmax_frames", _FRAMES_SQL)
def q_argmax(spark, sf):
    return _frame_ids(spark, sf)


_PAD_FRAME = _W - 1


@register("ctc_decode", f"""
WITH f AS ({_FRAMES_SQL}),
v AS ({_VOCAB_FULL_SQL}),
vm AS (SELECT map(list(id), list(CASE WHEN token = '|' THEN ' ' ELSE token END)) AS m FROM v),
g AS (SELECT vec_id, list_filter(list_filter(frame_ids, lambda x, i: i = 1 OR x <> frame_ids[i - 1]),
                                 lambda x: x <> {_PAD_FRAME}) AS ids FROM f)
SELECT vec_id, ids, {O.trim("array_to_string(list_transform(ids, lambda x: vm.m[x]), '')")} AS text
FROM g, vm""")
def q_ctc_decode(spark, sf):
    id_to_tok = VB.token_table(_vocab(spark, sf))
    f = _frame_ids(spark, sf)
    return f.select("vec_id", SQ.ctc_collapse("frame_ids", _PAD_FRAME).alias("ids"),
                    SQ.ctc_decode("frame_ids", id_to_tok, _PAD_FRAME).alias("text"))


@register("normalize_wave", """
WITH s AS (SELECT vec_id, embedding AS e, len(embedding) AS n,
                  list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mean FROM embeddings),
v AS (SELECT *, list_sum(list_transform(e, lambda x: (x::DOUBLE - mean) * (x::DOUBLE - mean))) / n AS var FROM s)
SELECT vec_id, list_transform(e, lambda x: round_even((x::DOUBLE - mean) / sqrt(var + 1e-7), 6)) AS input_values,
       n::INTEGER AS input_length FROM v""")
def q_normalize_wave(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    w = SQ.with_normalized_wave(e, "embedding")
    return w.select("vec_id", F.transform("input_values", lambda x: F.bround(x, 6)).alias("input_values"),
                    "input_length")


# --------------------------------------------------------------------------
# I1/F3, I5/M8 - batched model application with deterministic stand-in models
from ..operators import infer as IN  # noqa: E402
from . import stub_models as SM  # noqa: E402


@register("infer_translate", """
SELECT conv_id, turn, text,
  CASE WHEN text = '' THEN NULL ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS translation,
  CASE WHEN text = '' THEN 'ValueError: empty input' END AS error
FROM conversations""")
def q_infer_translate(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return IN.batch_infer(c, ["text"], "translation", SM.reverse_words_model, batch_size=16)


@register("infer_failed_rows", """
SELECT turn, count(*) FILTER (WHERE length(text) % 3 = 0) AS n_failed,
  count(*) FILTER (WHERE length(text) % 3 <> 0) AS n_kept FROM conversations GROUP BY turn""")
def q_infer_failed_rows(spark, sf):
    c = table(spark, sf, "conversations").select(
        "turn", F.when(F.length("text") % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))
    return IN.failure_counts(IN.batch_infer(c, ["text"], "translation", SM.reverse_words_model), by=["turn"])


@register("score_summary", f"""
WITH p AS ({O.CONVERSATION_PAIRS}),
s AS (SELECT turn, CASE WHEN greatest(length(hyp), length(ref)) = 0 THEN 1.0
             ELSE least(length(hyp), length(ref))::DOUBLE / greatest(length(hyp), length(ref)) END AS score FROM p)
SELECT turn, round_even(avg(score), 6) AS score_mean, count(score) AS n_scored FROM s GROUP BY turn""")
def q_score_summary(spark, sf):
    p = _pairs(spark, sf).select("turn", F.col("ref").alias("src"), F.col("hyp").alias("mt"), "ref")
    scored = IN.score_pairs(p, SM.length_ratio_model, batch_size=8)
    return MT.score_summary(scored, "score", by=["turn"], digits=6)


# --------------------------------------------------------------------------
# J1 (unmatched side), K3 - pair report
@register("unmatched_refs", """
SELECT u.conv_id, u.turn FROM conversations u
WHERE u.role = 'user' AND NOT EXISTS (
  SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn - 1 = u.turn)""")
def q_unmatched(spark, sf):
    c = table(spark, sf, "conversations")
    ref = c.where(F.col("role") == "user").select("conv_id", "turn")
    hyp = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return AL.unmatched(ref, hyp, ["conv_id", "turn"])


from ..sinks import writers as WR  # noqa: E402

_REPORT_SQL = f"""
WITH r AS ({_err_sql([], normalized=True)}),
p AS ({O.CONVERSATION_PAIRS}),
h AS (SELECT * FROM (VALUES (0, ''), (1, 'W'), (2, 'C'), (3, ''), (4, 'NW'), (5, 'NC'), (6, ''), (7, '')) t(j, tag))
SELECT 0 AS _part, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, h.j::INTEGER AS _j,
  CASE h.tag WHEN 'W' THEN 'WER: ' || r.wer::VARCHAR WHEN 'C' THEN 'CER: ' || r.cer::VARCHAR
             WHEN 'NW' THEN 'NORMALIZED WER: ' || r.norm_wer::VARCHAR
             WHEN 'NC' THEN 'NORMALIZED CER: ' || r.norm_cer::VARCHAR ELSE '' END AS line
FROM h, r
UNION ALL
SELECT 1, conv_id, turn, j::INTEGER - 1,
  CASE j WHEN 1 THEN 'REF: ' || ref WHEN 2 THEN 'HYP: ' || hyp ELSE '{WR.REPORT_SEPARATOR}' END
FROM p, range(1, 4) t(j)"""


@register("pair_report", _REPORT_SQL)
def q_pair_report(spark, sf):
    pairs = _pairs(spark, sf)
    rep = ER.asr_report(pairs, key=_KEY)
    return WR.report_lines(rep, pairs, ["conv_id", "turn"])


# --------------------------------------------------------------------------
# Whole-document queries: the same operators on long texts
_DOC_TARGET_SQL = (f"SELECT doc_id, lang, lower(regexp_replace(text, {O.q(_IGN)}, '', 'g')) || ' ' AS target "
                   "FROM documents")


@register("doc_char_vocab", _VOCAB_FULL_SQL.replace(f"FROM ({_TARGET_SQL})", f"FROM ({_DOC_TARGET_SQL})"))
def q_doc_char_vocab(spark, sf):
    # The union of the splits' character sets is that of all rows: one scan
    return VB.char_vocab(table(spark, sf, "documents").select(TX.clean_target("text").alias("target")), "target")


_DOC_PAIRS_SQL = (f"SELECT doc_id, lang, translate(text, {O.q(TX.PUNCT_FROM)}, {O.q(TX.PUNCT_TO)}) AS hyp, "
                  "text AS ref FROM documents")


_DOC_PS = O.pair_stats_sql(f"SELECT doc_id, hyp, ref FROM ({_DOC_PAIRS_SQL})", ["doc_id"], long=True)


@register("doc_fold_scores_by_lang", f"""
SELECT lang, {O.sentence_bleu_sql(agg=True)} AS bleu, {O.sentence_chrf_sql(agg=True)} AS chrf,
       count(*) AS n_pairs, 0::BIGINT AS n_skipped
FROM {_DOC_PS} s JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang""")
def q_doc_fold_scores(spark, sf):
    d = table(spark, sf, "documents")
    pairs = d.select("doc_id", "lang", TX.fold_punct("text").alias("hyp"), F.col("text").alias("ref"))
    return MT.corpus_scores(pairs, ["doc_id"], by=["lang"], digits=4)


# No oracle SQL: distances of whole documents are quadratic there.
@register("doc_error_rates_by_lang")
def q_doc_error_rates(spark, sf):
    d = table(spark, sf, "documents")
    pairs = d.select("doc_id", "lang", F.col("text").alias("ref"), TX.clean_target("text").alias("hyp"))
    return ER.asr_report(pairs, by=["lang"], key=["doc_id"], long_pairs=True)


from . import media  # noqa: E402,F401 - registers the queries over files
