import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import edit
from lectern.functions.edit import bit_distance
from lectern.operators import errors as ER
from tests.oracles import cer_text, lev, normalize, wer_words

PAIRS = [("a b c d", "a x c d e"), ("ẹ́ gbọ́ ni", "ẹ gbọ́"), ("😀 hi", "😀 hi"), ("", "a b"),
         ("a\tb c", "a b c"), ("same words here", "same words here"), ("x", ""),
         ("Hello, World!", "hello world")]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(PAIRS)], "k int, ref string, hyp string")


def test_pair_errors_against_dp(pairs):
    rows = ER.pair_errors(pairs).orderBy("k").collect()
    for (r, h), row in zip(PAIRS, rows):
        assert row.wer_err == lev(wer_words(r), wer_words(h))
        assert row.wer_n == len(wer_words(r))
        assert row.cer_err == lev(cer_text(r), cer_text(h))
        assert row.cer_n == len(cer_text(r))
        assert row.norm_wer_err == lev(wer_words(normalize(r)), wer_words(normalize(h)))


def test_corpus_rates_micro_average(pairs):
    got = ER.asr_report(pairs).collect()[0]
    e = sum(lev(wer_words(r), wer_words(h)) for r, h in PAIRS)
    n = sum(len(wer_words(r)) for r, h in PAIRS)
    assert got.wer == round(100 * e / n, 2)
    assert got.n_pairs == len(PAIRS)


def test_empty_reference_gives_null(spark):
    df = spark.createDataFrame([("", "a")], "ref string, hyp string")
    assert ER.wer(df).collect()[0].wer is None  # quirk Q6: no reference words


def test_invariant_under_repartition(pairs):
    a = ER.asr_report(pairs).collect()
    b = ER.asr_report(pairs.repartition(3)).collect()
    assert a == b


def test_null_side_is_skipped(spark):
    df = spark.createDataFrame([("a b", None), ("a b", "a c")], "ref string, hyp string")
    r = ER.asr_report(df).collect()[0]
    assert r.n_pairs == 1 and r.wer == 50.0


def test_symmetric_numerator(pairs):
    swapped = pairs.select("k", F.col("hyp").alias("ref"), F.col("ref").alias("hyp"))
    a = {r.k: r.wer_err for r in ER.pair_errors(pairs, normalized=False).collect()}
    b = {r.k: r.wer_err for r in ER.pair_errors(swapped, normalized=False).collect()}
    assert a == b


def test_bit_distance_of_random_sequences():
    rng = random.Random(2)
    for size, symbols in ((0, 1), (1, 2), (9, 3), (70, 4), (140, 60), (300, 5)):
        for _ in range(60):
            a, b = [[rng.randint(1, symbols) for _ in range(rng.randint(0, size))] for _ in range(2)]
            if rng.random() < 0.3:  # few edits, long common ends
                b = list(a)
                for _ in range(min(len(b), 3)):
                    b[rng.randrange(len(b))] = 0
            assert bit_distance(a, b) == lev(a, b)
    assert bit_distance("", "") == 0 and bit_distance("abc", "") == 3 and bit_distance("abc", "abc") == 0


def test_long_pairs_equal_levenshtein(spark, monkeypatch):
    """Both ways give the same numbers, and the long way takes what it should."""
    rng = random.Random(3)
    words = ["ẹ́", "gbọ́", "ni", "😀", "a", "bc"] + [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 900))), " ".join(rng.choices(words, k=rng.randint(0, 900)))) for k in range(24)]
    rows += [(100, None, "a"), (101, "", ""), (102, rows[0][1], rows[0][1])]
    df = spark.createDataFrame(rows, "k int, ref string, hyp string")
    short = ER.pair_errors(df).orderBy("k").collect()
    for cells in (1, 1 << 18, 1 << 40):
        monkeypatch.setattr(edit, "LONG_CELLS", cells)
        assert ER.pair_errors(df, long_pairs=True).orderBy("k").collect() == short
    assert short[0].wer_err == lev(wer_words(rows[0][1]), wer_words(rows[0][2]))
    assert ER.asr_report(df, long_pairs=True).collect() == ER.asr_report(df).collect()


def test_twenty_thousand_words(spark):
    """A planted number of edits between words that occur once each."""
    a = [f"w{k}" for k in range(20_000)]
    b = [x for k, x in enumerate(a) if k % 100] + ["new"] * 7
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "ref string, hyp string")
    r = ER.wer(df, long_pairs=True, digits=None).first()
    assert r.wer == 100.0 * 207 / 20_000


def test_linear_memory():
    import tracemalloc

    rng = random.Random(4)
    a, b = [[rng.randrange(n) for _ in range(20_000)] for n in (20_000, 20_000)]
    tracemalloc.start()
    d = bit_distance(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 10_000 < d <= 20_000 and peak < 12 << 20  # the table would have 4e8 cells


def test_only_diagonals_near_the_best_path(monkeypatch):
    """Long texts with some edits: the rows made at once are few beside the text."""
    rng, made, masks = random.Random(6), [], edit._masks
    monkeypatch.setattr(edit, "_masks", lambda rows, columns: made.append(len(rows)) or masks(rows, columns))
    a = "".join(rng.choices("abcdefgh ", k=40_000))
    b = "".join(x for k, x in enumerate(a) if k % 50) + "zz"
    assert bit_distance(a, b) == 802
    assert len(made) > 10 and max(made) < 6_000
    for rate in (0.0, 0.01, 0.2, 1.0):  # the bands that grow end where the whole table does
        a = rng.choices(range(30), k=900)
        b = [rng.randrange(30) if rng.random() < rate else x for x in a if rng.random() >= rate / 3]
        assert bit_distance(a, b) == bit_distance("".join(chr(97 + x) for x in a), "".join(chr(97 + x) for x in b)) == lev(a, b)


def test_documents_of_blanks_and_without_a_side(spark):
    rows = [(0, " a　 b  c ", "a b\tc"), (1, "a", None), (2, None, "a"), (3, None, None), (4, " \n ", "a"), (5, "", "")]
    df = spark.createDataFrame(rows, "k int, ref string, hyp string")
    assert ER.pair_errors(df, long_pairs=True).orderBy("k").collect() == ER.pair_errors(df).orderBy("k").collect()
