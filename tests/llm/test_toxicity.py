import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import TEXTS, docs
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lectern.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_rows_are_ranked_right(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    s = np.asarray([r["score"] for r in rows])
    y = np.asarray([r["toxic"] for r in rows])
    assert ((s >= 0) & (s <= 1)).all() and got.count() == 10_000
    order = s.argsort()
    auc = np.mean([(s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()])
    assert len(order) > 300 and auc > 0.95
    assert np.mean([(r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows]) == 1
    assert np.mean((s >= 0.5) == y) > 0.97


def test_no_input_but_the_text(spark):
    """Held-out labels, languages and sources don't change a score."""
    sf = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.held_out(F.col("doc_id"))
    other = lab.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    a = {r[0]: r[1] for r in toxicity.score(d, toxicity.fit(d, lab)).select("row.doc_id", "score").collect()}
    b = {r[0]: r[1] for r in toxicity.score(moved, toxicity.fit(moved, other)).select("row.doc_id", "score").collect()}
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 1)], [(k, k % 2) for k in range(1, 18)]])
def test_odd_rows_and_few_labels(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = docs(spark)
    got = toxicity.score(df, toxicity.fit(df, lab))
    rows = got.select("row.*", F.col("score").alias("s")).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["s"] <= 1 for r in rows)
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(map(str, TEXTS))
    empty = docs(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, lab)).collect() == []


def test_hidden_words_are_found_again():
    words, hidden = toxicity.tokens("You 1d10t!! s-t.u_p1d i d i o t loooser (fine) 2024")
    assert words == ["you", "idiot", "stupid", "idiot", "loser", "fine", "2024"]
    assert hidden == [False, True, True, True, True, False, False]


def test_features_do_not_grow_with_the_text():
    lex = {"idiot": 3.0, "lowe-": 2.0}
    one, ten = toxicity.features("you idiot loweiss text here ", lex), toxicity.features("you idiot loweiss text here " * 10, lex)
    names = toxicity.FEATURES
    assert len(one) == len(names)
    for n in ("learned density", "second person", "capitals", "punctuation", "closest"):
        assert abs(one[names.index(n)] - ten[names.index(n)]) < 0.02
    assert toxicity.features("", lex)[0] == 0.0


def _plainly(text, lexicon):
    """The features word by word."""
    words, hidden = toxicity.tokens(text)
    weights = [max([lexicon.get(k, 0.0) for k in toxicity.keys(w)]) for w in words]
    marked = [k for k, w in enumerate(words) if weights[k] > 0 or w in toxicity.SEED_WORDS]
    learned = [k for k in range(len(words)) if weights[k] > 0]
    persons = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    seeds = sum(w in toxicity.SEED_WORDS for w in words)
    gaps = [min(abs(p - m) for p in persons) for m in marked] if persons else []
    n, size = max(len(words), 1), max(len(text), 1)
    found = {p: len(re.findall(p, text)) for p in (r"\b[A-Z]{2,}\b", r"[^\w\s]", r"[!?]{2,}", r"(.)\1{2,}", r"\d")}
    return [len(learned) / n, sum(weights) / n, max(weights, default=0.0), math.log1p(len(learned)), math.log1p(len({words[k] for k in learned})),
            seeds / n, math.log1p(seeds), len(persons) / n, sum(g <= toxicity.NEAR for g in gaps) / n, float(min([50, *gaps])),
            sum(map(str.isupper, text)) / max(sum(map(str.isalpha, text)), 1), found[r"\b[A-Z]{2,}\b"] / n, found[r"[^\w\s]"] / size,
            found[r"[!?]{2,}"] / n, sum(hidden) / n, float(sum(hidden[k] for k in marked)), found[r"(.)\1{2,}"] / size, found[r"\d"] / size,
            math.log1p(len(words))]


def test_texts_read_together_are_as_read_alone(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    monkeypatch.setattr(toxicity, "_TOGETHER", 300)
    rng = random.Random(8)
    parts = ["you", "Idiot", "1d10t!!", "a", "b", "c", "d", "S", "!!!", "...", "É", "Über", "x2", "  ", "   ", "\n\n\n", "\t\t\t", "loooser", "Rrr", "HELLO",
             "s-t.u_p1d", "日本", "ß", "İdiot", "ΣΑΣ", "ǅ", "12", "_", "word,", "words.", "w.,", "stupidly", "éclair;", "\x1c", " ", "\xa0"]
    texts = ["", " ", *["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 50))) for _ in range(1500)]]
    words = sorted({w for t in texts for w in toxicity.tokens(t)[0]})
    lexicon = {k: rng.random() * 4 for w in rng.sample(words, len(words) // 3) for k in toxicity.keys(w)[:rng.randint(1, 5)]}
    reader = toxicity.Reader(lexicon)
    for text, got, known in zip(texts, reader.features(texts), reader.words(texts), strict=True):
        assert got == pytest.approx(_plainly(text, lexicon), rel=1e-6, abs=1e-7), text
        assert known == set(toxicity.tokens(text)[0])


def test_every_score_of_the_query_by_plain_features(spark):
    """The query against trees and calibration applied to features made one by one."""
    sf = "/root/testdata/sf0.001"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, lab)
    rows = [(r["doc_id"], [float(x) for x in _plainly(r["text"] or "", model.lexicon)]) for r in d.collect()]
    x = spark.createDataFrame(rows, "doc_id long, f array<double>").select("doc_id", array_to_vector("f").alias("x"))
    p = model.trees.transform(x).select("doc_id", vector_to_array("probability")[1].alias("p"))
    want = {r["doc_id"]: min(max(r["prediction"], 0), 1) for r in model.calibration.transform(p).collect()}
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert len(got) == d.count() and all(got[k]["score"] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())


def test_steps_become_slopes(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k / 400, float(rng.random() < k / 400)) for k in range(401)], "p double, label double")
    line = toxicity._calibrated(rows)
    at = spark.createDataFrame([(k / 50,) for k in range(51)], "p double")
    got = [r["prediction"] for r in line.transform(at).orderBy("p").collect()]
    assert got == sorted(got) and len(set(got)) == 51 and 0 <= got[0] and got[-1] <= 1
    assert max(abs(y - k / 50) for k, y in enumerate(got)) < 0.2
