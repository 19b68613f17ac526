import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import sequence as SQ
from lectern.operators import vocab as VB


@pytest.fixture
def targets(spark):
    return spark.createDataFrame([("ab c ",), ("😀a ",)], "t string")


def test_char_vocab_layout(targets):
    v = {r.token: r.id for r in VB.char_vocab(targets, "t").collect()}
    chars = sorted(set("ab c " + "😀a "))
    expect = {("|" if c == " " else c): i for i, c in enumerate(chars)}
    expect["[UNK]"] = len(chars)
    expect["[PAD]"] = len(chars) + 1
    assert v == expect


def test_vocab_delimiter_clash(spark):
    v = {r.token: r.id for r in VB.char_vocab(spark.createDataFrame([("a|b c",)], "t string"), "t").collect()}
    # the data's own '|' is replaced by the space's id; specials never collide
    assert v["|"] == 0 and v["[UNK]"] == max(i for k, i in v.items() if k not in ("[UNK]", "[PAD]")) + 1


def test_encode_labels(spark, targets):
    vocab = VB.char_vocab(targets, "t")
    v = {r.token: r.id for r in vocab.collect()}
    texts = spark.createDataFrame([(0, "ab c "), (1, "zz a"), (2, None), (3, ""), (4, "\U0010ffff😀")], "k int, t string")
    got = {r.k: r.labels for r in VB.encode_labels(texts, "t", vocab).collect()}
    assert got == {0: [v[c] for c in "ab|c|"], 1: [v["[UNK]"], v["[UNK]"], v["|"], v["a"]], 2: None, 3: [],
                   4: [v["[UNK]"], v["😀"]]}


def test_labels_of_any_vocabulary(spark):
    """One path and one behaviour beyond a few hundred entries, and back."""
    every = "".join(map(chr, range(0x4E00, 0x5800))) + " ,"
    texts = spark.createDataFrame([(0, every), (1, None)], "k int, t string")
    vocab = VB.char_vocab(texts, "t")
    v = {r.token: r.id for r in vocab.collect()}
    enc = VB.encode_labels(texts, "t", vocab)
    got = {r.k: r.labels for r in enc.collect()}
    assert got == {0: [v["|" if c == " " else c] for c in every], 1: None}
    back = enc.select("k", SQ.ctc_decode("labels", VB.token_table(vocab), v["[PAD]"], group=False).alias("t"))
    assert {r.k: r.t for r in back.collect()} == {0: every, 1: None}


def test_argmax_ctc_pad_unmask(spark):
    df = spark.createDataFrame([([[0.1, 0.9, 0.9], [0.5, 0.2, 0.1], [0.5, 0.2, 0.1], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]],)],
                               "logits array<array<double>>")
    ids = df.select(SQ.argmax_frames("logits").alias("ids")).first().ids
    assert ids == [1, 0, 0, 2, 1]
    m = VB.token_table(spark.createDataFrame([("a", 0), ("|", 1), ("b", 2)], "token string, id int"))
    r = spark.createDataFrame([([0, 0, 2, 2, 3, 2, 1, 0],)], "ids array<int>").select(
        SQ.ctc_collapse("ids", 3).alias("g"), SQ.ctc_collapse("ids", 3, group=False).alias("ng"),
        SQ.ctc_decode("ids", m, 3).alias("txt")).first()
    assert r.g == [0, 2, 2, 1, 0] and r.ng == [0, 0, 2, 2, 2, 1, 0] and r.txt == "abb a"
    b = spark.createDataFrame([(1, [1, 2, 3]), (1, [4]), (2, [5])], "b int, l array<int>")
    p = {tuple(r.l[:1]): r for r in SQ.pad_batch(b, "b", "l").collect()}
    assert p[(4,)].l == [4, -100, -100] and p[(4,)].attention_mask == [1, 0, 0] and p[(5,)].l == [5]
    odd = spark.createDataFrame([(None, [1]), (None, [1, 2]), (3, None)], "b int, l array<int>")
    assert sorted(str(r.l) for r in SQ.pad_batch(odd, "b", "l").collect()) == ["None", "[1, -100]", "[1, 2]"]
    u = b.select(SQ.unmask(F.array(F.lit(-100), F.lit(7)), 9).alias("u")).first().u
    assert u == [9, 7]


def test_normalize_wave(spark):
    x = [0.5, -1.0, 2.0, 0.25]
    got = spark.createDataFrame([(x,)], "s array<float>")
    r = SQ.with_normalized_wave(got, "s").first()
    a = np.array(x, dtype=np.float64)
    exp = (a - a.mean()) / np.sqrt(a.var() + 1e-7)
    assert np.allclose(r.input_values, exp) and r.input_length == 4


def test_frames_of_short_empty_and_null_arrays(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1.0, 2.0, 3.0]), (3, [1.0, 5.0, 2.0, 3.0]), (4, [float(x) for x in range(11)])], "k int, a array<double>")
    got = {r.k: r for r in df.select("k", SQ.frames("a", 4).alias("f"), SQ.argmax_frames(SQ.frames("a", 4)).alias("ids")).collect()}
    assert got[0].f is None and got[1].f == got[2].f == [] and got[2].ids == []
    assert got[3].f == [[1.0, 5.0, 2.0, 3.0]] and got[3].ids == [1] and got[4].ids == [3, 3]


def test_normalized_wave_of_empty_and_null_clips(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [2.0])], "k int, a array<float>")
    got = {r.k: r for r in SQ.with_normalized_wave(df, "a").collect()}
    assert got[0].input_values is None and got[1].input_values == [] and got[1].input_length == 0 and got[2].input_values == [0.0]
