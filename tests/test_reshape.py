import pytest
from pyspark.sql import functions as F

from lectern.operators import filters as FL
from lectern.operators import reshape as RS


@pytest.fixture
def wide(spark):
    cols = RS.DIALECT_COLUMNS + ["English"]
    rows = [(1, "i1", "l1", "j1", "s1", "e1"), (2, None, "l2", "j2", "s2", "e2")]
    return spark.createDataFrame(rows, ["row_id"] + cols)


def test_unpivot_keeps_nulls_and_directions(wide):
    fwd = RS.unpivot_dialects(wide, ids=["row_id"]).collect()
    assert len(fwd) == 8
    r = [x for x in fwd if x.row_id == 2 and x.dialect == "Ife Dialect"][0]
    assert r.src_txt is None and r.tgt_txt == "e2"
    rev = RS.unpivot_dialects(wide, ["Ijebu Dialect"], reverse=True, ids=["row_id"]).collect()
    assert {(x.src_txt, x.tgt_txt) for x in rev} == {("e1", "j1"), ("e2", "j2")}


def test_resolve_and_require():
    assert RS.resolve_dialects("Standard") == ["Standard Yoruba"]
    assert RS.resolve_dialects("Ife") == ["Ife Dialect"]
    assert len(RS.resolve_dialects()) == 4


def test_require_columns_lists_available(wide):
    with pytest.raises(ValueError, match="available: row_id"):
        RS.require_columns(wide, ["nope"])


def test_tag_lang(wide):
    long = RS.unpivot_dialects(wide, ids=["row_id"])
    sep = {r.dialect: r.src_lang for r in RS.tag_lang(long, joint=False).collect()}
    assert sep == {"Ife Dialect": "ife_Yoru", "Ilaje Dialect": "ila_Yoru",
                   "Ijebu Dialect": "ije_Yoru", "Standard Yoruba": "yor_Latn"}
    joint = RS.tag_lang(long, joint=True, reverse=True).collect()
    assert {(r.src_lang, r.tgt_lang) for r in joint} == {("eng_Latn", "yor_Latn")}


def test_union_missing_dialect(spark, wide):
    long = RS.unpivot_dialects(wide, ids=["row_id"]).drop("row_id")
    extra = spark.createDataFrame([("s", "t")], "src_txt string, tgt_txt string")
    u = RS.union_bitext(long, extra)
    assert u.count() == 9 and u.where("dialect is null").count() == 1


def test_long_to_wide_and_cap(spark):
    long = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7), (2, "a", 0.1)], "r int, g string, bleu double")
    w = {x.r: x for x in RS.long_to_wide(long, ["r"], "g", ["a", "b"], ["bleu"]).collect()}
    assert w[1]["a bleu"] == 0.5 and w[2]["b bleu"] is None
    df = spark.range(100).selectExpr("id", "id % 3 AS g")
    capped = FL.cap(df, 5, ["id"], ["g"]).collect()
    assert len(capped) == 15 and max(r.id for r in capped if r.g == 0) == 12
    plan = FL.cap(df, 5, ["id"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_duration_filter_is_strict(spark):
    df = spark.createDataFrame([(320000, 16000), (319999, 16000), (0, 16000), (1, 16000)],
                               "n_samples long, sampling_rate int")
    assert sorted(r.n_samples for r in FL.filter_duration(df).collect()) == [1, 319999]


def test_a_group_without_a_column_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 9, "b")], "k int, g int, m string")
    assert RS.long_to_wide(df, ["k"], "g", [0], ["m"]).first()["0 m"] == "a"
    with pytest.raises(Exception, match="g has a value without a column: 9"):
        RS.long_to_wide(df, ["k"], "g", [0], ["m"], complete=True).collect()


def test_large_cap_without_groups(spark, monkeypatch):
    """The same rows as an ordered limit, and no task that gathers them."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g")).repartition(6)
    monkeypatch.setattr(FL, "LIMIT_ROWS", 10)
    for n in (11, 1234, 4999, 5000, 9000):
        got = FL.cap(df, n, ["g", "k"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.orderBy("g", "k").limit(n).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert FL.cap(df.limit(0), 100, ["k"]).count() == 0


def test_splits_are_counted_while_written(spark, tmp_path):
    df = spark.createDataFrame([("train",)] * 5 + [("test",)] * 2 + [(None,)], "split string")
    rows, seen = FL.observed_split_counts(df, ["train", "validation", "test"])
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"train": 5, "validation": 0, "test": 2}
