import pytest
from pyspark.sql import functions as F

from lectern.operators import infer as IN
from lectern.plans import stub_models as SM


def test_batch_infer_keep_drop_fail(spark):
    df = spark.createDataFrame([(0, "a b"), (1, ""), (2, "c d e")], "k int, text string")
    keep = {r.k: r for r in IN.batch_infer(df, ["text"], "out", SM.reverse_words_model, batch_size=2).collect()}
    assert keep[0].out == "b a" and keep[1].out is None and keep[1].error == "ValueError: empty input"
    assert keep[2].out == "e d c" and keep[2].error is None
    drop = IN.batch_infer(df, ["text"], "out", SM.reverse_words_model, on_error="drop")
    assert sorted(r.k for r in drop.collect()) == [0, 2]
    with pytest.raises(Exception):
        IN.batch_infer(df, ["text"], "out", SM.reverse_words_model, on_error="fail").collect()


def test_score_pairs_and_concurrency(spark):
    df = spark.createDataFrame([("s", "abcd", "ab"), ("s", "", "")], "src string, mt string, ref string")
    got = sorted(r.score for r in IN.score_pairs(df, SM.length_ratio_model).collect())
    assert got == [0.5, 1.0]
    out = IN.batch_infer(df, ["mt"], "o", lambda: (lambda xs: [x.upper() for x in xs]), concurrency=1)
    assert out.rdd.getNumPartitions() == 1


def _logged_model(folder, fail=None, lose=None):
    """Upper-cases; writes a file per load and the texts of each call."""
    def make():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def f(texts):
            assert all(isinstance(t, str) for t in texts), "a null at the model"
            if lose and any(t in lose for t in texts) and not os.path.exists(f"{folder}/mended"):
                raise ConnectionError("service lost")
            with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as g:
                g.write("\n".join(texts))
            if fail and any(t in fail for t in texts):
                raise ValueError("refused")
            return [t.upper() for t in texts]
        return f
    return make


def _sent(folder):
    return sorted(t for p in folder.glob("call-*") for t in p.read_text().split("\n"))


def test_a_worker_loads_its_model_once_and_never_sees_null(spark, tmp_path):
    df = spark.range(64).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("t"), "id")).alias("text")).repartition(32)
    got = {r.id: r for r in IN.batch_infer(df, ["text"], "out", _logged_model(tmp_path), batch_size=4, on_error="fail").collect()}
    assert all(got[k].out == (None if k % 5 == 0 else f"T{k}") and got[k].error is None for k in range(64))
    loads = [p.name.split("-")[1] for p in tmp_path.glob("load-*")]
    assert len(loads) == len(set(loads)) < 32 and len(_sent(tmp_path)) == 51  # a load a worker, not one a task


def test_rows_with_a_null_among_several_inputs(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), (None, 1.0, "x"), ("a", None, "x"), ("a", float("nan"), "x")], "p string, q double, r string")
    got = IN.batch_infer(df, ["p", "q"], "o", lambda: (lambda rows: [f"{p}{q}" for p, q in rows]), on_error="fail").collect()
    assert [r.o for r in got] == ["a1.0", None, None, None]


def test_waits_double(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(IN.time, "sleep", waits.append)

    def f(xs):
        calls.append(len(xs))
        if len(calls) < 4:
            raise ConnectionError("busy")
        return xs

    assert IN._apply(f, [1, 2], 2, "fail", 5, 0.5) == ([1, 2], [None, None]) and waits == [0.5, 1.0, 2.0]
    monkeypatch.setattr(IN, "LONGEST_WAIT", 3.0)
    waits.clear()
    with pytest.raises(ConnectionError):
        IN._apply(lambda xs: (_ for _ in ()).throw(ConnectionError()), [1], 1, "fail", 5, 1.0)
    assert waits == [1.0, 2.0, 3.0, 3.0, 3.0]


def test_a_stopped_run_sends_only_what_is_missing(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    log.mkdir()
    df = spark.createDataFrame([(k, f"t{k}" if k else None) for k in range(40)] + [(7, "t7")], "k int, text string")

    def run(frame, fail=("t11",), **more):
        model = _logged_model(log, lose={"t11"}, fail=fail)
        return IN.resumable_infer(frame, ["k"], ["text"], "out", model, ledger, parts=5, batch_size=2, **more)

    with pytest.raises(Exception, match="service lost"):
        run(df, fail=None, on_error="fail").collect()
    (log / "mended").touch()
    first = _sent(log)
    assert 0 < len(spark.read.parquet(ledger).collect()) < 40
    stored = {r.out for r in spark.read.parquet(ledger).collect() if r.out}
    for p in log.glob("call-*"):
        p.rename(log / f"old-{p.name}")
    got = run(df, on_error="keep").collect()
    assert len(got) == 41 and {r.k: r.out for r in got} == {k: f"T{k}" if k and k != 11 else None for k in range(40)}
    assert {r.k for r in got if r.error} == {11} and first
    assert not {t.upper() for t in _sent(log)} & stored  # what the ledger had was not sent again
    for p in log.glob("call-*"):
        p.rename(log / f"older-{p.name}")
    # a third run: only the failed row, a changed text and a new row are sent
    more = df.where("k <> 3").union(spark.createDataFrame([(3, "changed"), (99, "new")], "k int, text string"))
    again = {r.k: r.out for r in run(more, on_error="keep").collect()}
    assert again[3] == "CHANGED" and again[99] == "NEW" and set(_sent(log)) == {"t11", "changed", "new"}
    for p in log.glob("call-*"):
        p.rename(log / f"oldest-{p.name}")
    assert run(more, on_error="keep", retry_failed=False).count() == 42 and _sent(log) == []


def test_failures_are_counted_while_written(spark):
    from lectern.session import materialize

    df = spark.createDataFrame([(0, "a b"), (1, ""), (2, "c")], "k int, text string")
    rows, seen = IN.observed_failures(IN.batch_infer(df, ["text"], "out", SM.reverse_words_model))
    assert materialize(rows).count() == 3 and seen.get == {"n_failed": 1, "n_kept": 2}
