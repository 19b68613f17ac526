"""Physical-plan properties that matter at scale."""

from lectern.operators import errors as ER
from lectern.operators import vocab as VB
from lectern.plans import catalog
from tests.conftest import SF_SMALL


def _phys(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_error_rates_stay_in_the_jvm(spark):
    pairs = spark.createDataFrame([(0, "a b c", "a c")], "k int, ref string, hyp string")
    for df in (ER.wer(pairs, ["k"]), ER.cer(pairs, ["k"])):
        p = _phys(df)
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
        assert "levenshtein" in p


def test_label_encoding_is_narrow(spark):
    texts = spark.createDataFrame([(0, "ab c "), (1, "ba ")], "k int, t string")
    p = _phys(VB.encode_labels(texts, "t", VB.char_vocab(texts, "t")))
    assert "Exchange" not in p and "Join" not in p  # a projection over the text rows


def test_doc_vocabulary_is_one_scan(spark):
    assert _phys(catalog.QUERIES["doc_char_vocab"](spark, SF_SMALL)).count("FileScan") == 1


def test_asr_report_has_no_python_and_normalises_once(spark):
    df = catalog.QUERIES["asr_report"](spark, SF_SMALL)
    p = _phys(df)
    assert "ArrowEvalPython" not in p and "MapInArrow" not in p and "MapInPandas" not in p
    # one normaliser a side, however many tokenisers read it
    assert df._jdf.queryExecution().optimizedPlan().toString().count("java_method(") == 2


def test_pairs_are_spread_over_a_set_number_of_tasks(spark):
    pairs = spark.createDataFrame([(k, 0, "a b c", "a c") for k in range(9)], "conv_id long, turn long, ref string, hyp string")
    for make in (ER.wer, ER.cer, ER.asr_report):
        assert "REPARTITION_BY_NUM" in _phys(make(pairs, key=["conv_id", "turn"], partitions=13)) and "13)" in _phys(make(pairs, key=["conv_id"], partitions=13))
        assert "RoundRobinPartitioning(13)" in _phys(make(pairs, partitions=13))
    joined = pairs.select("conv_id", "turn", "ref").hint("merge").join(pairs.select("conv_id", "turn", "hyp"), ["conv_id", "turn"])
    assert _phys(ER.wer(joined, key=["conv_id", "turn"])).count("Exchange hashpartitioning") == 2
