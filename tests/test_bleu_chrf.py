import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import mt_metrics as MT
from lectern.operators import ngram as NG
from tests.oracles import bleu_score, bleu_stats, chrf_score, chrf_stats, tok13a

PAIRS = [("the cat sat on the mat", "the cat sat on the mat"), ("", "a b c d"), ("a b c d", ""),
         ("", ""), ("a b", "a b"), ("ẹ́ gbọ́ 😀 x", "ẹ gbọ́ 😀 x"), ("Hello, world. 3.14", "Hello world 3.14 !"),
         ("the the the the", "the cat"), ("a  b\tc\nd", "a b c d")]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(PAIRS)], "k int, hyp string, ref string")


def test_stats_and_sentence_scores(pairs):
    st = {r.k: r for r in MT.pair_stats(pairs, ["k"]).select(
        "*", MT.sentence_bleu().alias("bleu"), MT.sentence_chrf().alias("chrf")).collect()}
    assert len(st) == len(PAIRS)  # pairs without n-grams keep their row
    for k, (h, r) in enumerate(PAIRS):
        hl, rl, m, tot = bleu_stats(h, r)
        row = st[k]
        assert (row.b_hyp_len, row.b_ref_len) == (hl, rl)
        assert [row[f"b_m{n}"] for n in range(1, 5)] == m
        assert [row[f"b_h{n}"] for n in range(1, 5)] == tot
        cs = chrf_stats(h, r)
        assert [(row[f"c_h{n}"], row[f"c_r{n}"], row[f"c_m{n}"]) for n in range(1, 7)] == cs
        assert row.bleu == pytest.approx(bleu_score(hl, rl, m, tot), abs=1e-9)
        assert row.chrf == pytest.approx(chrf_score(cs), abs=1e-9)
        assert 0 <= row.bleu <= 100 + 1e-9 and 0 <= row.chrf <= 100 + 1e-9
    assert st[0].bleu == pytest.approx(100.0) and st[0].chrf == pytest.approx(100.0)
    assert st[4].bleu == 0.0 and st[4].chrf > 0  # under 4 tokens: no effective order


def test_corpus_equals_sentence_for_one_pair(spark):
    df = spark.createDataFrame([(0, "the cat sat on a mat", "the cat sat on the mat")], "k int, hyp string, ref string")
    s = MT.sentence_scores(df, ["k"]).collect()[0]
    c = MT.corpus_scores(df, ["k"]).collect()[0]
    assert s.bleu == pytest.approx(c.bleu) and s.chrf == pytest.approx(c.chrf)


def test_corpus_sums_statistics(pairs):
    got = MT.corpus_scores(pairs, ["k"]).collect()[0]
    hl = rl = 0
    m, tot = [0] * 4, [0] * 4
    cs = [[0, 0, 0] for _ in range(6)]
    for h, r in PAIRS:
        a, b, mm, tt = bleu_stats(h, r)
        hl += a
        rl += b
        m = [x + y for x, y in zip(m, mm)]
        tot = [x + y for x, y in zip(tot, tt)]
        for i, s in enumerate(chrf_stats(h, r)):
            cs[i] = [x + y for x, y in zip(cs[i], s)]
    assert got.bleu == pytest.approx(bleu_score(hl, rl, m, tot), abs=1e-9)
    assert got.chrf == pytest.approx(chrf_score(cs), abs=1e-9)


def test_repeats_and_different_pairs_of_one_key(spark):
    same = ("a b c x", "a b c d")
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (1, *same), (1, *same), (2, None, "x"), (2, None, "x"), (2, "x", None)],
                               "k int, hyp string, ref string")
    st = sorted((r.k, r.n_pairs, r.n_skipped, r.b_m1) for r in MT.pair_stats(df, ["k"]).select(
        "k", "n_pairs", "n_skipped", F.coalesce("b_m1", F.lit(-1)).alias("b_m1")).collect())
    assert st == [(1, 1, 0, 4), (1, 2, 0, 3), (2, 0, 1, -1), (2, 0, 2, -1)]
    c = MT.corpus_scores(df, ["k"]).first()
    hl, rl, m, tot = (0, 0, [0] * 4, [0] * 4)
    for h, r in [("a b c d", "a b c d"), same, same]:
        x, y, mm, tt = bleu_stats(h, r)
        hl, rl, m, tot = hl + x, rl + y, [p + q for p, q in zip(m, mm)], [p + q for p, q in zip(tot, tt)]
    assert (c.n_pairs, c.n_skipped) == (3, 3) and c.bleu == pytest.approx(bleu_score(hl, rl, m, tot))
    assert MT.bleu(df, ["k"]).first().bleu == pytest.approx(c.bleu) and MT.chrf(df, ["k"]).first().chrf == pytest.approx(c.chrf)


def test_plan_tokeniser_not_duplicated(pairs):
    """H2: the tokeniser runs once per row and in the JVM; the counting is one
    Arrow function per metric and makes no rows."""
    stats = NG.pair_statistics(pairs, ["k"])
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("([^0-9])([.,])") == 2  # hyp and ref
    phys = stats._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in phys and "Generate" not in phys
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_ngram_plan_single_exchange(spark, pairs):
    """The n-grams never cross the network: one repartition of the pair rows,
    none where a join on the key has placed them, and no join of the metrics."""
    phys = NG.pair_statistics(pairs, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert phys.count("Exchange") == 1 and "REPARTITION_BY_NUM" in phys
    joined = pairs.select("k", "hyp").hint("merge").join(pairs.select("k", "ref"), "k")
    phys = MT.corpus_scores(joined, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert phys.count("Exchange hashpartitioning") == 2 and phys.count("Join") == 1


@pytest.mark.parametrize("alphabet,order", [("ab", 6), ("abc de", 4), ("".join(map(chr, range(0x4E00, 0x6200))), 6)])
def test_matches_of_random_texts(alphabet, order):
    """Few units (one packed integer), and so many that two are needed."""
    rng = random.Random(order)
    sides = [["".join(rng.choices(alphabet, k=rng.randint(0, 50))).replace(" ", "") for _ in range(600)] for _ in range(2)]
    got = NG.gram_matches(*NG._char_units(pa.array(sides[0])), *NG._char_units(pa.array(sides[1])), order)
    for h, r, m in zip(*sides, got.tolist()):
        assert [x[2] for x in chrf_stats(h, r)][:order] == m


def test_long_pair_and_texts_beside_it():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 60000)}" for _ in range(300_000)]
    hyp, ref = pa.array([words, [], ["a", "b"]]), pa.array([words[::-1], ["x"], ["a", "b"]])
    got = NG.gram_matches(*NG._word_units(hyp, ref), 4).tolist()
    want = [sum((Counter(zip(*[words[i:] for i in range(n)])) & Counter(zip(*[words[::-1][i:] for i in range(n)]))).values()) for n in range(1, 5)]
    assert got == [want, [0] * 4, [2, 1, 0, 0]]


def test_slices_nulls_and_broken_utf8():
    column = pa.array(["zz", None, "", "é😀", "x"]).slice(1)
    units, at = NG._char_units(column)
    assert at.tolist() == [0, 0, 0, 2, 3] and units.tolist() == [0xE9, 0x1F600, ord("x")]
    broken = pa.array([b"a\x80\xe2", b"bc"], pa.binary())
    units, at = NG._char_units(broken.view(pa.string()))
    assert len(units) == at[-1] and units[at[1]:].tolist() == [ord("b"), ord("c")]


def test_row_statistics_keep_every_row(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (1, "a b", "a b"), (2, None, "x")], "k int, hyp string, ref string")
    rows = NG.row_statistics(df, metrics="b").orderBy("k").collect()
    assert [(r.k, r.n_pairs, r.n_skipped, r.b_m2) for r in rows] == [(1, 1, 0, 1), (1, 1, 0, 1), (2, 0, 1, None)]


def test_long_texts_taken_apart_like_short_ones(spark, monkeypatch):
    """The borders of the Arrow function are those of the rules, and pairs of any
    length, equal or not, have the statistics of the plain counts."""
    rng = random.Random(9)
    signs = "ab1.,-5 \n\t/é“”&'　\x1f\"<"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) + rng.choice(["", "", "1..5", "a.,.5", "&amp;lt;", "-\n", "<skipped>"]) for _ in range(4000)]
    assert [[w.decode("utf-32-le") for w in ws] for ws in NG._tokens_13a(texts).to_pylist()] == [tok13a(t) for t in texts]
    rows = []
    for k in range(60):
        ref = "".join(rng.choices("abc de.“1", k=rng.choice([0, 30, 400])))
        hyp = rng.choice([ref, ref.replace("“", '"'), "".join(x for x in ref if rng.random() < 0.95) + "“x"])
        rows.append((k, hyp, ref))
    df = spark.createDataFrame([*rows, (100, None, "x" * 500), (101, "x" * 500, None), (102, None, None)], "k int, hyp string, ref string")
    for long in (0, 256, 1 << 30):
        monkeypatch.setattr(NG, "LONG_TEXT", long)
        got = NG.row_statistics(df).orderBy("k").collect()
        assert [r.n_skipped for r in got] == [0] * 60 + [1] * 3 and all(r.b_m1 is None and r.c_m1 is None for r in got[60:])
        for (_, hyp, ref), r in zip(rows, got):
            hl, rl, m, t = bleu_stats(hyp, ref)
            assert (r.b_hyp_len, r.b_ref_len, [r[f"b_m{n}"] for n in range(1, 5)], [r[f"b_h{n}"] for n in range(1, 5)]) == (hl, rl, list(m), list(t))
            assert [[r[f"c_{x}{n}"] for x in "hrm"] for n in range(1, 7)] == [list(x) for x in chrf_stats(hyp, ref)]


def test_few_positions_sorted(monkeypatch):
    """Beside a changed word only the n-grams near it are left to sort."""
    left, aligned = [], NG._aligned
    monkeypatch.setattr(NG, "_aligned", lambda *a: left.append(aligned(*a)) or left[-1])
    text = "abc defg " * 500
    for other in (text[:2000] + "X" + text[2001:], text[:2000] + "XYZ" + text[2000:]):
        hyp, ref = pa.array([other]), pa.array([text])
        assert NG._measured(hyp, ref, NG._char_lists, 6)[2][0].tolist() == [s[2] for s in chrf_stats(other, text)]
        assert left.pop().sum() < 30
