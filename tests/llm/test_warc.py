import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, warc

BIG = "<p>payload</p>" * 100
ROWS = [(1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
        (9, "repeated", BIG), (None, "no id", BIG), (None, "no id", "ü" * 600), (None, "again", "ü" * 600), (-7, "neg", "ß" * 700), (-8, "neg", "ß" * 700)]


def archive(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(df, folder)
    return folder


def warc_id(row):
    return re.search(rb"WARC-Record-ID: (\S+)", bytes(row["header"]))[1].decode()


def test_records_come_back(spark, tmp_path):
    folder = archive(spark, ROWS, tmp_path)
    rows = warc.read_archive(spark, folder).withColumn("type", warc.field(F.col("header"), "WARC-Type")).withColumn(
        "refers", warc.field(F.col("header"), "WARC-Refers-To")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        body = bytes(r["payload"])
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head + b"\r\n\r\n" == bytes(r["header"]) and head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head
        assert rest == (b"" if r["type"] == "revisit" else body) + b"\r\n\r\n"
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert fields["WARC-Payload-Digest"] == f"sha1:{hashlib.sha1(body).hexdigest()}" and int(fields["Content-Length"]) == len(rest) - 4
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and {"WARC-Type", "WARC-Target-URI"} <= set(fields)
        assert ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields) == (r["type"] == "revisit")
    ids = [warc_id(r) for r in rows]
    assert len(set(ids)) == len(rows)
    assert {r["refers"] for r in rows if r["type"] == "revisit"} <= {i for i, r in zip(ids, rows) if r["type"] == "response"}
    got = sorted(((r["id"], len(r["payload"]), r["type"], re.sub(r":\d+>$", ">", r["refers"])) for r in rows), key=str)
    assert [x for x in got if x[0] in (1, 2, 9)] == [(1, len(BIG), "revisit", "<urn:page:9>"), (2, len(BIG), "revisit", "<urn:page:9>"),
                                                     (9, len(BIG), "response", ""), (9, len(BIG), "response", "")]
    assert {x[2] for x in got if x[1] < 1000} == {"response"}
    assert [x[2:] for x in got if x[0] == -8] == [("revisit", "<urn:page:-7>")]
    payloads = spark.read.parquet(f"{folder}/payloads")
    assert payloads.count() == payloads.select("digest").distinct().count() == len({r[2] or "" for r in ROWS})


def test_damage_is_found(spark, tmp_path):
    folder = archive(spark, ROWS[:2], tmp_path)
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(f"{folder}/bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}/bad/headers")
    for columns in (["payload"], ["record"]):
        with pytest.raises(Exception, match="damaged payload"):
            warc.read_archive(spark, f"{folder}/bad").select(*columns).collect()


def test_empty_table(spark, tmp_path):
    assert warc.read_archive(spark, archive(spark, [], tmp_path)).collect() == []


def test_query_has_a_row_for_each_page(spark):
    got = queries.op8_warc(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_query_measures_rebuilt_records(spark):
    """Payloads go through the join into the records: sizes are taken behind it."""
    plan = queries.op8_warc(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join Inner")[0]
    assert "payload#" in above and "concat(header#" in above.replace("concat(cast(header#", "concat(header#")


def test_a_date_of_capture_and_long_payloads(spark, tmp_path):
    rows = [(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, "v", "é" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/long"
    warc.write_archive(df, folder, date=F.timestamp_seconds(F.col("page_id") + 1_000_000_000))
    got = {r["id"]: r for r in warc.read_archive(spark, folder).collect()}
    assert {k: len(r["payload"]) for k, r in got.items()} == {1: 3_000_000, 2: 3_000_000, 3: 1998}
    assert b"WARC-Date: 2001-09-09T01:46:41Z" in bytes(got[1]["header"]) and len(got[1]["record"]) < 600 < len(got[2]["record"])
