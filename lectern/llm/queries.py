"""The registered queries of these operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, chat, exact, licenses, packing, pieces, records, simhash, suffixes, toxicity, trie, warc, whitening
from lectern.llm.common import pairs, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    doc_id = F.col("row.doc_id")
    return toxicity.score(docs, model).select(
        doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    base = F.transform("base", lambda d: d["label"])
    kept = F.transform("kept", lambda d: d["label"])

    def names(col):
        return F.array_join(F.array_sort(F.array_distinct(col)), ",")

    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"),
        names(F.concat(base, kept)).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0)).alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(pairs(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return found.select(F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.equal_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.col("digest").alias("text_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    header, kind = F.col("header"), warc.field(F.col("header"), "WARC-Type")
    # a response's payload is cut from its rebuilt record; a revisit has the response's
    payload = F.when(kind == "revisit", F.col("payload")).otherwise(warc.body_of(F.col("record"), header))
    return warc.read_archive(spark, folder).select(
        F.col("id").alias("page_id"), F.length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"),
        kind.alias("record_type"), warc.page_of(warc.field(header, "WARC-Refers-To")).alias("refers_to"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                        "sequence_id", "offset")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        # the byte span in the text that each id stands for, as begin:end
        F.sha2(F.array_join(F.zip_with("begins", "ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), " ").cast("binary"), 256)
        .alias("spans_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_family_openings(turns)).drop("node", "above")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), marks.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows)).withColumnRenamed("id", "conv_id")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_simhash, op3_licenses, op4_ann, op5_suffix_dedup, op6_token_records, op7_exact_dedup, op8_warc,
    op9_packing, op10_sentencepiece, op11_whitening, op12_prefix_trie, op13_chat)}

SQL = {
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op8_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             o AS (SELECT *, strlen(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS owner FROM t),
             k AS (SELECT *, n >= 1000 AND page_id IS DISTINCT FROM owner AS revisits FROM o)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisits THEN owner END AS refers_to
        FROM k""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
             -- CRC-32 bit by bit: each byte of the decimals, then eight shifts
             c AS (SELECT conv_id, conv_id - conv_id % 20 AS f,
                          xor(list_reduce(list_concat([4294967295::UBIGINT::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                              lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                              lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
                              4294967295) % 4 AS h
                   FROM (SELECT DISTINCT conv_id FROM t)),
             s AS (SELECT c.conv_id, t.pos AS o, r, x FROM c JOIN t ON t.conv_id = c.f AND t.pos <= c.h
                   UNION ALL SELECT c.conv_id, t.pos + 3, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
             d AS (SELECT conv_id, md5(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
                          row_number() OVER (PARTITION BY conv_id ORDER BY o) AS depth FROM s),
             p AS (SELECT conv_id, depth, w, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM d
                   UNION ALL SELECT conv_id, 0, 0, '' FROM c),
             n AS (SELECT node, any_value(depth) AS depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node),
             b AS (SELECT *, CASE WHEN depth > 0 THEN left(node, length(node) - 32) END AS above FROM n),
             k AS (SELECT above, count(*) AS n_children FROM b GROUP BY above),
             u AS (SELECT DISTINCT v.node AS v, u.node AS u FROM p v JOIN p u ON u.conv_id = v.conv_id AND u.depth >= v.depth),
             g AS (SELECT u.v AS node, count(*) FILTER (k.above IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved
                   FROM u JOIN n ON n.node = u.u LEFT JOIN k ON k.above = u.u GROUP BY u.v),
             z AS (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id),
             e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM z GROUP BY node)
        SELECT b.conv_id, b.depth, q.conv_id AS parent_conv_id, b.n_convs, coalesce(k.n_children, 0) AS n_children, g.n_leaves,
               CAST(g.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM b JOIN g ON g.node = b.node LEFT JOIN n q ON q.node = b.above LEFT JOIN k ON k.above = b.node LEFT JOIN e ON e.node = b.node""",
    "op13_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
               CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length(replace(replace(replace(r, '\', '\\'), '"', '\"'), chr(10), '\n'))
                        + length(replace(replace(replace(x, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}
