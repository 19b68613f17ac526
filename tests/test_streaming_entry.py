import os
import tempfile

from lectern.operators import mt_metrics as MT
from lectern.streaming import scoring as ST

import __spark_entry__ as E


def test_running_error_rates(spark):
    d = tempfile.mkdtemp(prefix="lectern-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    spark.createDataFrame([("a", "a b c", "a x c")], "g string, ref string, hyp string") \
        .write.mode("append").parquet(src)
    stream = spark.readStream.schema("g string, ref string, hyp string").parquet(src)
    seen = {}
    q = ST.start_scoring(stream, ["g"], os.path.join(d, "ckpt"), lambda df, _: seen.update({x.g: x for x in df.collect()}))
    q.processAllAvailable()
    spark.createDataFrame([("a", "d e", "d e")], "g string, ref string, hyp string") \
        .write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    r = seen["a"]
    assert r.n_pairs == 2 and r.wer == 20.0  # 1 error over 5 reference words


def test_running_translation_scores(spark):
    d = tempfile.mkdtemp(prefix="lectern-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    schema = "g string, ref string, hyp string"
    batches = [[("a", "the cat sat on the mat", "the cat sat on a mat"), ("b", "x y z u", None)],
               [("a", "one two three four five", "one two three four"), ("b", "x y z u", "x y z u"), ("a", "same", "same")]]
    seen = {}
    q = None
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        if q is None:
            stream = spark.readStream.schema(schema).parquet(src)
            q = ST.start_scoring(stream, ["g"], os.path.join(d, "ckpt"), lambda df, _: seen.update({x.g: x for x in df.collect()}),
                                 ST.running_translation_scores)
        q.processAllAvailable()
    q.stop()
    rows = [(k, *r) for k, r in enumerate(batches[0] + batches[1])]
    want = MT.corpus_scores(spark.createDataFrame(rows, "k int, " + schema), ["k"], ["g"]).collect()
    assert {r.g: r for r in want} == seen and seen["b"].n_skipped == 1


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["turn", "wer", "norm_wer", "cer", "norm_cer", "n_pairs"]
    assert len(rows) == len({r.turn for r in rows}) > 0 and all(r.n_pairs > 0 and r.wer >= r.norm_wer >= 0 for r in rows)
    assert set(E.oracle_sql()) < set(E.queries())
