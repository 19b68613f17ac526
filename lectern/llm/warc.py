"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` stores the bytes of each distinct
payload once, under their SHA-256, and ``headers`` keeps each record's exact
header block with the digest of its payload.  Records are put together again
by a join, after the stored bytes have been hashed anew and found to be those
that the digest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, utf8
from lectern.session import checkpoint_dir

#: Payloads of so many bytes are deduplicated between records.
MIN_REVISIT = 1000
_END = "\r\n\r\n"


#: What a revisit refers to: the same payload, by its digest.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids: the page and the row's place, which tells rows of one page apart.
_RECORD_ID = r"^<urn:page:(-?\d+|none):\d+>$"


def _urn(id_: Column, seq: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(":"), seq.cast("string"), F.lit(">"))


def page_of(record_id: Column) -> Column:
    """The page id in a record id; null if there is none."""
    found = F.regexp_extract(record_id, _RECORD_ID, 1)
    return F.when(~found.isin("", "none"), found).cast("long")


def write_archive(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  min_revisit: int = MIN_REVISIT, date: Column | None = None) -> None:
    """Write one record per row of ``df`` below ``folder``.

    Of records with equal payloads of ``min_revisit`` bytes or more, the one
    with the largest id is the response and the others revisit it; all smaller
    ones are responses.  A null body is the empty payload, a null url the empty
    target; payloads of any length are stored whole.  Rows without an id are
    responses only if no row with their payload has one.  Rows that repeat the
    response's id are responses too; the payload is stored once all the same.
    ``date`` is the time of capture of a row (default: now).  An empty table makes
    an empty archive; other columns are not read.
    """
    taken = F.current_timestamp() if date is None else date
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                      F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
                      F.to_utc_timestamp(taken, F.current_timezone()).alias("date"), utf8(F.col(f"`{body_col}`")).alias("payload"))
    # What the headers need, without the payloads.  Line ends in a target would end the header.
    records = cut(pages.select(
        "id", F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"),
        F.monotonically_increasing_id().alias("seq")))
    owners = records.groupBy("digest").agg(F.max(F.struct("id", "seq")).alias("owner"))

    revisits = F.col("type") == "revisit"
    is_revisit = (F.col("n") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("owner.id"))
    lines = [F.lit("WARC/1.1"),
             F.concat(F.lit("WARC-Type: "), F.col("type")),
             F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"), F.col("seq"))),
             F.concat(F.lit("WARC-Date: "), F.col("date")),
             F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
             F.when(revisits, F.lit(f"WARC-Profile: {_SAME_PAYLOAD}")),
             F.when(revisits, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("owner.id"), F.col("owner.seq")))),
             F.concat(F.lit("Content-Length: "), F.when(revisits, F.lit("0")).otherwise(F.col("n").cast("string")))]
    headers = (records.join(owners, "digest")
               .withColumn("type", F.when(is_revisit, "revisit").otherwise("response"))
               .select("id", "digest", F.concat(F.concat_ws("\r\n", *lines), F.lit(_END)).cast("binary").alias("header")))
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/headers")

    # Equal payloads meet once, each task having kept one of its own, and any of
    # the equal bytes stays.
    body = pages.select(F.sha2("payload", 256).alias("digest"), "payload")
    (body.groupBy("digest").agg(F.first("payload").alias("payload"))
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record again: ``id``, ``header``, ``payload`` (the full payload, of
    revisits that of the response) and ``record``, the bytes of the WARC record (a
    revisit has no body).

    Fails if the store has bytes that don't match the digest they are under.
    """
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")
    stored = spark.read.parquet(f"{folder}/payloads")
    good = stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(damaged).alias("payload"))
    headers = spark.read.parquet(f"{folder}/headers")
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(good, "digest").select("id", "header", "payload", F.concat("header", body, F.lit(_END.encode())).alias("record"))


def body_of(record: Column, header: Column) -> Column:
    """The bytes of a record behind its header, as many as the header says."""
    return F.substring(record, F.length(header) + 1, field(header, "Content-Length").cast("int"))


def field(header: Column, name: str) -> Column:
    """The value of a header field; the empty text if it has none."""
    return F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def archive_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
