"""Toxicity scores: gradient-boosted trees over dense features of a text.

The features are rates, so they don't grow with the text: densities of a
lexicon learned from the labelled texts and of a short fixed one, how close
their words stand to second-person words, capitals, punctuation, and ways of
hiding a word.  Trees and the isotonic calibration come from Spark's ML library
and are fitted on disjoint parts of the labelled rows.  Labels, language, source
and id are no features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, release, utf8

#: Labelled rows that are learned from, about; chosen by a hash of the id.
MAX_LABELLED = 16_000
#: Least evidence (a log-likelihood ratio, chi-squared scale) for an entry.
LEAST_EVIDENCE = 25.0
#: Of the rows learned from, one in so many calibrates only.
CALIBRATE_ONE_IN = 5
#: A step of the calibration is no surer than this, or than 1 less this.
SURE = 1e-3
#: How far a step of the calibration rises towards the next one.
RISE = 0.05
#: Different odd raw words that a task remembers; beyond it starts anew.
REMEMBERED = 30_000

SEED_WORDS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown "
    "imbecile cretin jerk bastard bitch asshole crap shit fuck fucking hate ugly filthy vermin retard freak pig "
    "dummkopf abschaum versager wertlos idiota imbecil estupido basura imbecile ordure minable connard".split())
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "ti tus usted ustedes vosotros".split())
NEAR = 5

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_BLANK_RUN = re.compile(r"([^\S\n])\1{2,}")
_CAPITALS, _SIGNS, _SHOUTS, _DIGITS = (re.compile(p) for p in (r"\b[A-Z]{2,}\b", r"[^\w\s]", r"[!?]{2,}", r"\d"))

FEATURES = ("learned density", "learned mean", "learned most", "learned hits", "learned kinds", "seed density", "seed hits",
            "second person", "close hits", "closest", "capitals", "capital words", "punctuation", "exclamations",
            "hidden words", "hidden hits", "long runs", "digits", "words")


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Lower-cased words without signs at their ends, and whether a word was
    hidden: signs or digits inside it, letters spread by spaces, or repeated."""
    words, hidden, single = [], [], []

    def spread():
        if len(single) >= 4:
            words.append("".join(single))
            hidden.append(True)
        else:
            words.extend(single)
            hidden.extend([False] * len(single))
        single.clear()

    for raw in text.split():
        if raw.isalpha():
            if len(raw) == 1:
                single.append(raw.lower())
                continue
            core, odd = raw.lower(), False
        else:
            core = _EDGE.sub("", raw)
            if not core:
                continue
            if len(core) == 1:
                single.append(core.lower())
                continue
            odd = not core.isalpha() and any(c.isalpha() for c in core)
            core = core.lower()
            if odd:
                core = _INNER.sub("", core.translate(_LEET)) or core
        if single:
            spread()
        if core.isalpha() and len(core) > 3 and _LONG_RUN.search(core):
            core, odd = _LONG_RUN.sub(r"\1", core), True
        words.append(core)
        hidden.append(odd)
    if single:
        spread()
    return words, hidden


def keys(word: str) -> list[str]:
    """What the learned lexicon knows a word by: itself, its beginnings and end."""
    out = [word]
    if len(word) > 4:
        out += [f"{word[:4]}-", f"-{word[-4:]}"]
    if len(word) > 5:
        out += [f"{word[:5]}-", f"-{word[-5:]}"]
    return out


#: Most raw words: small letters, the first one perhaps a capital, and perhaps a sign behind.
_ORDINARY = r"^(\p{Lu}\p{Ll}+|\p{Ll}{2,})[.,;:]?$"
_SPREAD, _SKIPPED = 4, 3  # kinds of raw words: a letter alone, signs alone
#: What is known of a raw word: its kind, a number for its core, what the lexica say, and what it adds to the counts of a text.
_KIND, _CORE, _WEIGHT, _SEED, _PERSON, _HIDDEN, _FIRST_COUNT = range(7)
_WIDTH = _FIRST_COUNT + 8  # letters, capitals, capital words, signs, shouts, digits, long runs, length
#: Characters of the texts that are taken apart together, about.
_TOGETHER = 1 << 19


class Reader:
    """Features of texts under one lexicon.

    Everything a raw word adds to them depends on that word alone, so the different
    raw words of many texts are taken apart once: ordinary ones as Arrow columns,
    others one by one, and remembered.  A text is then a list of their
    numbers, and its features are sums and positions over arrays.  Only texts
    with letters spread by spaces, where several raw words are one, are put
    together anew."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        kinds = {"word": {}, "head": {}, "tail": {}}  # a core has no sign at its ends, so a key's kind shows
        for key, x in lexicon.items():
            kind = "head" if key.endswith("-") else "tail" if key.startswith("-") else "word"
            kinds[kind][key.strip("-") if kind != "word" else key] = x
        self._sets = {k: (pa.array(list(d), pa.string()), np.array([*d.values(), 0.0])) for k, d in kinds.items()}
        self._seeds, self._persons = (pa.array(sorted(w), pa.string()) for w in (SEED_WORDS, SECOND_PERSON))
        self._odd: dict[str, tuple] = {}

    def _weight(self, core: str) -> float:
        return max([self.lexicon.get(k, 0.0) for k in keys(core)]) if core else 0.0

    def _one(self, raw: str) -> tuple:
        """An odd raw word: its core and its row."""
        found = self._odd.get(raw)
        if found is None:
            words, hidden = tokens(raw)
            core, odd = (words[0], hidden[0]) if words else ("", False)
            kind = _SKIPPED if not words else _SPREAD if len(core) == 1 else 0
            found = core, (kind, 0, self._weight(core), core in SEED_WORDS, core in SECOND_PERSON, odd, sum(map(str.isalpha, raw)),
                           sum(map(str.isupper, raw)), len(_CAPITALS.findall(raw)), len(_SIGNS.findall(raw)), len(_SHOUTS.findall(raw)),
                           len(_DIGITS.findall(raw)), len(_LONG_RUN.findall(raw)), len(raw))
            if len(self._odd) >= REMEMBERED:
                self._odd.clear()
            self._odd[raw] = found
        return found

    def _looked_up(self, kind: str, column: pa.Array) -> np.ndarray:
        values, weights = self._sets[kind]
        at = pc.index_in(column, value_set=values).fill_null(len(values)).to_numpy(zero_copy_only=False)
        return weights[at]

    def _apart(self, raws: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Cores and rows of different raw words."""
        table = np.zeros((len(raws), _WIDTH), np.float32)
        # a dotted capital I is two characters in small letters; runs of a letter are shortened: both are odd
        sizes = pc.utf8_length(raws).to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(pc.utf8_rtrim(raws, characters=".,;:"))
        length = pc.utf8_length(cores).to_numpy(zero_copy_only=False)
        joined, ends = "\n".join(cores.to_pylist()), np.cumsum(length + 1)
        runs = np.searchsorted(ends, [m.start() for m in _LONG_RUN.finditer(joined)], "right")
        ordinary = np.array(pc.match_substring_regex(raws, _ORDINARY).to_numpy(zero_copy_only=False), bool)
        ordinary[runs] = False
        ordinary &= ~np.array(pc.match_substring(raws, "\u0130").to_numpy(zero_copy_only=False), bool)
        weight = self._looked_up("word", cores)
        for n in (4, 5):
            longer = length > n
            if longer.any():
                head = self._looked_up("head", pc.utf8_slice_codeunits(cores, 0, n))
                tail = self._looked_up("tail", pc.utf8_slice_codeunits(cores, -n))
                weight = np.where(longer, np.maximum(weight, np.maximum(head, tail)), weight)
        table[:, _WEIGHT] = weight
        for column, words in ((_SEED, self._seeds), (_PERSON, self._persons)):
            table[:, column] = pc.is_in(cores, value_set=words).to_numpy(zero_copy_only=False)
        capital = ~pc.equal(pc.utf8_slice_codeunits(raws, 0, 1), pc.utf8_slice_codeunits(cores, 0, 1)).to_numpy(zero_copy_only=False)
        for k, values in ((0, length), (1, capital), (3, sizes - length), (7, sizes)):
            table[:, _FIRST_COUNT + k] = values
        odd = np.flatnonzero(~ordinary)
        if len(odd):
            found = [self._one(r) for r in raws.take(pa.array(odd)).to_pylist()]
            table[odd] = [row for _, row in found]
            names = np.zeros(len(raws), bool)
            names[odd] = True
            cores = pc.replace_with_mask(cores, pa.array(names), pa.array([core for core, _ in found], pa.string()))
        cores = cores.dictionary_encode()
        table[:, _CORE] = cores.indices.to_numpy(zero_copy_only=False)
        return cores.dictionary, table

    def _read(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
        """Each text with the rows of its raw words and the names of their cores."""
        lo = 0
        while lo < len(texts):
            raws, ends, size, hi = [], [0], 0, lo
            while hi < len(texts) and size < _TOGETHER:
                raws += texts[hi].split()
                ends.append(len(raws))
                size += len(texts[hi])
                hi += 1
            encoded = pa.array(raws, pa.large_string()).cast(pa.string()).dictionary_encode()
            cores, table = self._apart(encoded.dictionary)
            known = table[encoded.indices.to_numpy(zero_copy_only=False)]
            for k in range(lo, hi):
                yield texts[k], known[ends[k - lo]:ends[k - lo + 1]], cores
            lo = hi

    @staticmethod
    def _spread(known: np.ndarray) -> bool:
        """Whether four letters or more stand alone one after another."""
        kinds = known[:, _KIND]
        if np.count_nonzero(kinds == _SPREAD) < 4:
            return False
        alone = kinds[kinds != _SKIPPED] == _SPREAD
        return bool((alone[3:] & alone[2:-1] & alone[1:-2] & alone[:-3]).any())

    def words(self, texts: list[str]) -> Iterator[set[str]]:
        """The different words of each text, as ``tokens`` has them."""
        for text, known, cores in self._read(texts):
            if self._spread(known):
                yield set(tokens(text)[0])
            else:
                used = np.unique(known[known[:, _KIND] != _SKIPPED, _CORE]).astype(np.int64)
                yield set(cores.take(pa.array(used)).to_pylist())

    def features(self, texts: list[str]) -> Iterator[list[float]]:
        for text, known, _ in self._read(texts):
            yield self._features(text, known)

    def _features(self, text: str, known: np.ndarray) -> list[float]:
        raws = len(known)
        letters, upper, capital_words, signs, shouts, digits, runs, length = known[:, _FIRST_COUNT:].sum(0, dtype=float).tolist()
        if len(text) - length - (raws - 1) >= 2:  # enough blanks for a run of them
            runs += len(_BLANK_RUN.findall(text))
        if self._spread(known):
            words, odd = tokens(text)
            core = {w: k for k, w in enumerate(dict.fromkeys(words))}
            known = np.array([(0, core[w], self._weight(w), w in SEED_WORDS, w in SECOND_PERSON, o) for w, o in zip(words, odd)], np.float32)
        else:
            known = known[known[:, _KIND] != _SKIPPED]
        weights, seeds, hidden = known[:, _WEIGHT], known[:, _SEED] > 0, known[:, _HIDDEN] > 0
        learned = weights > 0
        marked, p = np.flatnonzero(learned | seeds), np.flatnonzero(known[:, _PERSON])
        close, closest = 0, 50.0
        if len(marked) and len(p):
            at = np.searchsorted(p, marked)
            gap = np.minimum(np.abs(p[np.minimum(at, len(p) - 1)] - marked), np.abs(p[np.maximum(at - 1, 0)] - marked))
            close, closest = int((gap <= NEAR).sum()), float(min(gap.min(), 50))
        n, size = max(len(known), 1), max(len(text), 1)
        hits, seed_hits = int(learned.sum()), int(seeds.sum())
        return [hits / n, float(weights.sum(dtype=float)) / n, float(weights.max()) if hits else 0.0, math.log1p(hits),
                math.log1p(len(np.unique(known[learned, _CORE])) if hits else 0), seed_hits / n, math.log1p(seed_hits), len(p) / n, close / n, closest,
                upper / max(letters, 1), capital_words / n, signs / size, shouts / n, int(hidden.sum()) / n, float(hidden[marked].sum()),
                runs / size, digits / size, math.log1p(len(known))]


def _few(datas: Iterable[bytes]) -> Iterator[list[str]]:
    """Texts in lists that are taken apart together; memory goes back behind each."""
    texts, size = [], 0
    for d in datas:
        texts.append(d.decode("utf-8", "replace"))
        size += len(d)
        if size >= _TOGETHER:
            yield texts
            texts, size = [], 0
            pa.default_memory_pool().release_unused()
    yield texts
    release()


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    return next(Reader(lexicon).features([text]))


@dataclass
class ToxicityModel:
    """``lexicon`` (of the bounded sample of labelled rows) and the fitted parts;
    without trees, where one of the labels has no row, the fixed lexicon scores."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def held_out(id_: Column) -> Column:
    """Rows that nothing is learned from; a null id isn't one."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """``(id, label, fold, text)`` of about ``bound`` labelled rows.  Only the
    labels that were chosen are broadcast, and there are that few of them."""
    known = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("label").alias("label")))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("data"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(CALIBRATE_ONE_IN))
    return texts.join(F.broadcast(known), "id").select(
        "id", (F.col("label") > 0).cast("double").alias("label"), (fold == 0).alias("calibrates"), "data")


def _learn_lexicon(rows: DataFrame, evidence: float) -> dict[str, float]:
    """Words and word ends that stand in far more texts of label 1: their log
    odds, smoothed.  Each task counts its own texts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        reader = Reader({})

        def out():
            names = list({*seen[True], *seen[False]})
            batch = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([seen[b][k] for k in names], pa.int64()) for b in (True, False))],
                names=["key", "ones", "zeros"])
            for c in seen.values():
                c.clear()
            return batch

        for batch in batches:
            known = (w for texts in _few(d.as_py() for d in batch.column(1)) for w in reader.words(texts))
            for label, words in zip(batch.column(0).to_pylist(), known):
                seen[label > 0].update({k for w in words for k in keys(w)})
                if len(seen[True]) + len(seen[False]) > 400_000:
                    yield out()
        yield out()

    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = n.get(1.0, 0), n.get(0.0, 0)
    if not ones or not zeros:
        return {}
    counts = rows.select("label", "data").mapInArrow(count, "key string, ones long, zeros long").groupBy("key").agg(
        F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    rate = ones / (ones + zeros)
    total = F.col("a") + F.col("b")

    def part(x: Column, p: float) -> Column:
        return F.when(x > 0, x * F.log(x / (total * p))).otherwise(0.0)

    strong = counts.where((F.col("a") >= 3) & (F.col("a") / ones > 3 * (F.col("b") / zeros))).withColumn(
        "evidence", 2 * (part(F.col("a"), rate) + part(F.col("b"), 1 - rate))).where(F.col("evidence") >= evidence)
    return {r["key"]: math.log((r["a"] + 0.5) / (ones + 1)) - math.log((r["b"] + 0.5) / (zeros + 1))
            for r in strong.orderBy("key").collect()}


def _feature_column(lexicon: dict[str, float]):
    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(lexicon)
        for data in parts:
            rows = np.array([x for texts in _few(d.as_py() for d in data) for x in reader.features(texts)], float)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1) * len(FEATURES), pa.int32()), pa.array(rows.reshape(-1)))

    return run


def _calibrated(rows: DataFrame) -> IsotonicRegressionModel:
    """Isotonic regression of ``label`` on ``p`` whose steps rise a little: from a
    step's value at its begin by ``RISE`` of the way to the next one's at its end,
    so that texts of one step are still told apart."""
    steps = IsotonicRegression(featuresCol="p", labelCol="label").fit(rows)
    at, value = np.asarray(steps.boundaries), np.clip(steps.predictions, SURE, 1 - SURE)
    levels = [*np.unique(value).tolist(), 1.0]
    knots = {0.0: levels[0] * (1 - RISE)}
    for v, above in zip(levels, levels[1:]):
        begin, end = float(at[value == v].min()), float(at[value == v].max())
        knots |= {begin: v, max(end, begin + 1e-9): v + RISE * (above - v)}
    knots[1.0] = levels[-2] + RISE * (1 - levels[-2])
    line = rows.sparkSession.createDataFrame(sorted(knots.items()), "p double, label double")
    return IsotonicRegression(featuresCol="p", labelCol="label").fit(line)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED, evidence: float = LEAST_EVIDENCE,
        iterations: int = 16, depth: int = 3, seed: int = 7) -> ToxicityModel:
    """Learn from about ``max_labelled`` rows that ``labels`` marks and that are
    not held out.  Null labels are left out; an id labelled twice counts as 1 if
    either is.  Where a label has no row there are no trees."""
    rows = cut(_labelled(docs, labels, id_col, text_col, label_col, max_labelled))
    lexicon = _learn_lexicon(rows.where("not calibrates"), evidence)
    table = cut(rows.select("label", "calibrates", _feature_column(lexicon)("data").alias("x"))
                .select("label", "calibrates", array_to_vector("x").alias("x"))).coalesce(4)  # small now, and read by every tree
    n = {(r["label"], r["calibrates"]): r["count"] for r in table.groupBy("label", "calibrates").count().collect()}
    if not all(n.get((y, False)) for y in (0.0, 1.0)):
        return ToxicityModel(lexicon)
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=iterations, maxDepth=depth, seed=seed, maxBins=64,
                          stepSize=0.2, cacheNodeIds=False).fit(table.where("not calibrates"))
    if not all(n.get((y, True)) for y in (0.0, 1.0)):
        return ToxicityModel(lexicon, trees)
    raw = trees.transform(table.where("calibrates")).select("label", vector_to_array("probability")[1].alias("p"))
    return ToxicityModel(lexicon, trees, _calibrated(cut(raw)))


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``row`` (the input row, whatever its columns are named) and ``score`` for
    every row.

    Null and empty texts score as texts without words, texts of any length by all
    of their words.  Null ids, repeated rows and empty tables need nothing
    special: rows are scored one by one.
    """
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     _feature_column(model.lexicon)(utf8(F.col(f"`{text_col}`"))).alias("f"))
    if model.trees is None:
        seeds = 1 - F.exp(-40 * (F.col("f")[5] + F.col("f")[1]))
        return base.select("row", seeds.alias("score"))
    raw = (model.trees.transform(base.withColumn("x", array_to_vector("f")))
           .select("row", vector_to_array("probability")[1].alias("p")))
    if model.calibration is None:
        return raw.select("row", F.col("p").alias("score"))
    out = model.calibration.transform(raw)
    return out.select("row", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("score"))
