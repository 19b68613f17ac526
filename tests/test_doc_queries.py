"""Registered queries without oracle SQL, checked against brute force on the
smallest driver tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lectern.functions import text as TX
from lectern.plans import catalog
from tests.conftest import SF_SMALL
from tests.oracles import bleu_score, bleu_stats, cer_text, chrf_score, chrf_stats, normalize, wer_words


def test_doc_fold_scores_by_lang_brute_force(spark):
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    fold = str.maketrans(TX.PUNCT_FROM, TX.PUNCT_TO)
    acc = {}
    for d in docs:
        hyp, ref = d["text"].translate(fold), d["text"]
        a = acc.setdefault(d["lang"], {"hl": 0, "rl": 0, "m": [0] * 4, "t": [0] * 4,
                                       "c": [[0, 0, 0] for _ in range(6)], "n": 0})
        hl, rl, m, t = bleu_stats(hyp, ref)
        a["hl"] += hl
        a["rl"] += rl
        a["m"] = [x + y for x, y in zip(a["m"], m)]
        a["t"] = [x + y for x, y in zip(a["t"], t)]
        for i, s in enumerate(chrf_stats(hyp, ref)):
            a["c"][i] = [x + y for x, y in zip(a["c"][i], s)]
        a["n"] += 1
    got = {r.lang: r for r in catalog.QUERIES["doc_fold_scores_by_lang"](spark, SF_SMALL).collect()}
    assert set(got) == set(acc)
    for lang, a in acc.items():
        assert got[lang].n_pairs == a["n"]
        assert got[lang].bleu == pytest.approx(round(bleu_score(a["hl"], a["rl"], a["m"], a["t"]), 4), abs=1e-4)
        assert got[lang].chrf == pytest.approx(round(chrf_score(a["c"]), 4), abs=1e-4)


def _distance(a, b):
    """Levenshtein by rows of the table in numpy."""
    if not a or not b:
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    codes = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    a = np.array([codes[x] for x in a])
    at = np.arange(len(a) + 1)
    row = at.copy()
    for i, x in enumerate(b, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (a != codes[x]))))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def test_doc_error_rates_by_lang_brute_force(spark):
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    drop = str.maketrans("", "", "".join(TX.CHARS_TO_IGNORE))
    sums = {}
    for d in docs:
        ref, hyp = d["text"], d["text"].translate(drop).lower() + " "
        total = sums.setdefault(d["lang"], [0] * 9)
        for k, (r, h) in enumerate([(wer_words(ref), wer_words(hyp)), (wer_words(normalize(ref)), wer_words(normalize(hyp))),
                                    (cer_text(ref), cer_text(hyp)), (cer_text(normalize(ref)), cer_text(normalize(hyp)))]):
            total[2 * k] += _distance(r, h)
            total[2 * k + 1] += len(r)
        total[8] += 1
    got = {r.lang: tuple(r)[1:] for r in catalog.QUERIES["doc_error_rates_by_lang"](spark, SF_SMALL).collect()}
    assert got == {lang: (*[pytest.approx(100 * t[2 * k] / t[2 * k + 1], abs=0.006) for k in range(4)], t[8]) for lang, t in sums.items()}
