"""H2: n-gram sufficient statistics for BLEU (word n-grams) and chrF
(character n-grams), made within the row.

Columns per pair and metric: ``hyp_len``, ``ref_len`` and for every order n
``h{n}`` (hypothesis n-grams counted), ``r{n}`` (reference n-grams) and ``m{n}``
(clipped matches).  Every column is additive, so a corpus score is a ``sum`` per
group followed by one closed formula.

Words of short texts are made in the JVM.  One Arrow function per metric takes all
other texts of a batch apart, as arrays of code points, and counts the matches.  Equal texts match in full.  In others,
n-grams that stand at the same place from the front or from the end of both sides
match each other and are set aside, so that only those near differences are
sorted.  There, a unit becomes a small number, the units
that follow it (as many as the highest order) are packed behind it into one
integer, and one sort of these suffixes serves all orders: n-grams that are equal
stand next to each other whatever n is.  No row is made per n-gram, and nothing
is shuffled for the counting.

Rows with one key and different texts stay different pairs.  Rows repeated as a
whole share one row with their number in ``n_pairs``; a pair without one side
has ``n_pairs`` 0, null statistics and its number in ``n_skipped``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import PY_SPACE_CODEPOINTS
from ..functions.tokenize import TOK13A_ENTITIES, TOK13A_RULES, tokenize_13a

BLEU_ORDER = 4
CHRF_ORDER = 6
#: Characters of a side from which a pair's words are made in the Arrow function.
LONG_TEXT = 256
#: Units and pairs that are sorted together.
_UNITS, _PAIRS = 1 << 18, 256


def _packed(units: np.ndarray, ends: np.ndarray, take: range, bits: int) -> np.ndarray:
    """The units at offsets ``take`` behind each position side by side, the first
    one highest; zero from the end of the text on."""
    at, out = np.arange(len(units)), np.zeros(len(units), np.uint64)
    for j in take:
        inside = at + j < ends
        out = (out << np.uint64(bits)) | np.where(inside, units[np.minimum(at + j, len(units) - 1)], 0).astype(np.uint64)
    return out


def _aligned(parts: list[np.ndarray], lengths: np.ndarray, n_pairs: int, ends: np.ndarray, order: int, out: np.ndarray) -> np.ndarray:
    """Count in ``out`` the n-grams of positions that hold the same units as the
    position of the other side that is as far from the front, or from the end;
    returns the positions that are left."""
    at = np.concatenate(([0], np.cumsum(lengths)))
    hyp, ref = lengths[:n_pairs], lengths[n_pairs:]
    place = np.arange(at[n_pairs])
    owner = np.repeat(np.arange(n_pairs), hyp)
    left = np.ones(at[-1], bool)
    for shift, there in ((at[n_pairs:-1] - at[:n_pairs], place - at[owner] < ref[owner]),
                         (at[n_pairs + 1:] - at[1:n_pairs + 1], at[owner + 1] - place <= ref[owner])):
        mine = np.flatnonzero(there & left[:len(place)])
        its = mine + shift[owner[mine]]
        same = left[its]
        for x in parts:
            same &= x[mine] == x[its]
        mine, its = mine[same], its[same]
        left[mine] = left[its] = False
        room = ends[mine] - mine
        for n in range(1, order + 1):
            out[:, n - 1] += np.bincount(owner[mine[room >= n]], minlength=n_pairs)
    return left


def _chunk_matches(units: np.ndarray, lengths: np.ndarray, n_pairs: int, order: int) -> np.ndarray:
    """Clipped matches (pair, order) of the texts of ``n_pairs`` hypotheses and
    then as many references, laid one behind the other; units are 0 or more."""
    out = np.zeros((n_pairs, order), np.int64)
    if not len(units):
        return out
    seen = np.zeros(int(units.max()) + 1, np.int64)
    seen[units] = 1
    units = np.cumsum(seen)[units]  # 1 .. number of different units
    bits, pair_bits = int(seen.sum()).bit_length(), max(n_pairs - 1, 1).bit_length()
    ends = np.repeat(np.cumsum(lengths), lengths)
    text = np.repeat(np.arange(2 * n_pairs), lengths)
    pair, side = (text % n_pairs).astype(np.uint64), (text >= n_pairs).astype(np.uint64)
    one = np.uint64(1)
    if pair_bits + order * bits + 1 <= 64:
        parts, sizes = [(pair << np.uint64(order * bits)) | _packed(units, ends, range(order), bits)], [order]
    else:  # two integers hold what one can't
        half = (order + 1) // 2
        parts = [(pair << np.uint64(half * bits)) | _packed(units, ends, range(half), bits), _packed(units, ends, range(half, order), bits)]
        sizes = [half, order - half]
    left = _aligned(parts, lengths, n_pairs, ends, order, out)
    parts, side = [x[left] for x in parts], side[left]
    if not len(side):
        return out
    if len(parts) == 1:
        key = np.sort((parts[0] << one) | side)
        side, parts = (key & one).astype(np.int64), [key >> one]
    else:
        by = np.lexsort((parts[1], parts[0]))
        side, parts = side[by].astype(np.int64), [x[by] for x in parts]
    mask = np.uint64((1 << bits) - 1)
    owner = (parts[0] >> np.uint64(sizes[0] * bits)).astype(np.int64)
    for n in range(1, order + 1):
        cut = [parts[0] >> np.uint64((sizes[0] - min(n, sizes[0])) * bits)]
        if n > sizes[0]:
            cut.append(parts[1] >> np.uint64((order - n) * bits))
        whole = np.flatnonzero(cut[-1] & mask)  # the n-th unit is there
        if not len(whole):
            break
        new = np.zeros(len(whole), bool)
        new[0] = True
        for c in cut:
            c = c[whole]
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        both, ref = np.diff(np.append(begin, len(whole))), np.add.reduceat(side[whole], begin)
        out[:, n - 1] += np.bincount(owner[whole[begin]], np.minimum(ref, both - ref), n_pairs).astype(np.int64)
    return out


def gram_matches(hyp: np.ndarray, hyp_at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, order: int) -> np.ndarray:
    """Clipped n-gram matches of every pair for n up to ``order``.  Side k of pair i
    is ``side[at[i]:at[i + 1]]``."""
    n = len(hyp_at) - 1
    out, lo = np.zeros((n, order), np.int64), 0
    size = hyp_at + ref_at
    while lo < n:
        # as many pairs as fit, one at least: a pair is never cut
        hi = int(np.searchsorted(size, size[lo] + _UNITS, "right")) - 1
        hi = min(max(hi, lo + 1), lo + _PAIRS, n)
        units = np.concatenate([hyp[hyp_at[lo]:hyp_at[hi]], ref[ref_at[lo]:ref_at[hi]]])
        out[lo:hi] = _chunk_matches(units, np.concatenate([np.diff(hyp_at[lo:hi + 1]), np.diff(ref_at[lo:hi + 1])]), hi - lo, order)
        lo = hi
    return out


def _filled(column: pa.Array, empty) -> pa.Array:
    return column.fill_null(pa.scalar(empty, column.type)) if column.null_count else column


def _word_units(hyp: pa.Array, ref: pa.Array) -> list[np.ndarray]:
    """Codes of words that both sides share, and offsets."""
    sides = [_filled(c, []) for c in (hyp, ref)]
    words = [s.flatten() for s in sides]
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out, at = [], 0
    for s, w in zip(sides, words):
        offsets = s.offsets.to_numpy()
        out += [codes[at:at + len(w)], (offsets - offsets[0]).astype(np.int64)]
        at += len(w)
    return out


def _char_units(column: pa.Array) -> list[np.ndarray]:
    """Code points of all texts, and offsets."""
    column = _filled(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(points) == starts[-1]:
        return [points, starts[offsets - offsets[0]]]
    # bytes that are no UTF-8: the texts one by one
    texts = [np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le"), "<u4") for x in column.to_pylist()]
    return [np.concatenate(texts), np.cumsum([0, *map(len, texts)])]


def _statistics_type(prefix: str, order: int) -> T.StructType:
    names = [f"{prefix}hyp_len", f"{prefix}ref_len", *[f"{prefix}{k}{n}" for n in range(1, order + 1) for k in "hrm"]]
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


def _strings(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and offsets."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.cumsum([0, *map(len, texts)])


_SPACE, _DIGIT, _SIGN, _STOP, _DASH = range(1, 6)


def _kinds() -> np.ndarray:
    """What each code point is to the 13a rules; 0, also for those behind the table, is a letter."""
    out = np.zeros(max(PY_SPACE_CODEPOINTS) + 2, np.uint8)
    sign = re.compile(TOK13A_RULES[0][0])
    out[[c for c in range(128) if sign.fullmatch(chr(c))]] = _SIGN
    out[PY_SPACE_CODEPOINTS] = _SPACE
    out[ord("0"):ord("9") + 1] = _DIGIT
    out[[ord("."), ord(",")]] = _STOP
    out[ord("-")] = _DASH
    return out


_KINDS = _kinds()


def _kind(points: np.ndarray) -> np.ndarray:
    return _KINDS[np.minimum(points, len(_KINDS) - 1)]


def _tokens_13a(texts: list[str]) -> pa.LargeListArray:
    """:func:`lectern.functions.tokenize.tokenize_13a` of each text, tokens as their
    code points.  The rules as borders between characters: around a sign, around a
    dash behind a digit, and around the stops and commas of a run.  A stop stays with
    the digits around it; of several, the last one stays with a digit that follows
    when the rules, which take two characters at a time, leave it over."""
    padded = []
    for t in texts:
        t = t.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
        for src, dst in TOK13A_ENTITIES:
            t = t.replace(src, dst)
        padded.append(f" {t} ")
    points, at = _points(padded)
    kind = _kind(points)
    opens = np.zeros(len(points) + 1, bool)  # a border stands before
    digit, stop = kind == _DIGIT, kind == _STOP
    alone = (kind == _SIGN) | stop
    alone[1:] |= (kind[1:] == _DASH) & digit[:-1]
    opens[:-1] |= alone
    opens[1:] |= alone
    step = np.diff(stop.astype(np.int8))
    first, last = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1)
    before, behind, odd = digit[first - 1], digit[last + 1], (last - first) % 2 == 0
    opens[last[behind & (odd == before)] + 1] = False
    opens[first[before & behind & (first == last)]] = False
    seen = kind != _SPACE
    opens[1:-1] |= ~seen[:-1]
    begins = opens[:-1] & seen
    counts = np.concatenate(([0], np.cumsum(begins)))
    kept = points[seen]
    offsets = np.append(np.flatnonzero(begins[seen]), len(kept)) * 4
    values = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
    return pa.LargeListArray.from_arrays(pa.array(counts[at], pa.int64()), values)


def _word_lists(hyp: list[str], ref: list[str]) -> list[np.ndarray]:
    return _word_units(_tokens_13a(hyp), _tokens_13a(ref))


def _visible(texts: list[str]) -> list[np.ndarray]:
    """Code points but white space, and offsets."""
    points, at = _points(texts)
    seen = _kind(points) != _SPACE
    return [points[seen], np.concatenate(([0], np.cumsum(seen)))[at]]


def _char_lists(hyp: list[str], ref: list[str]) -> list[np.ndarray]:
    return [*_visible(hyp), *_visible(ref)]


def _measured(hyp: pa.Array, ref: pa.Array, units, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of both sides and matches of whole pairs; ``units(hyp, ref)`` takes lists of texts apart."""
    sides = [_strings(c) for c in (hyp, ref)]
    which = np.flatnonzero(np.asarray([h != r for h, r in zip(*sides)], bool))
    rl = np.diff(units([], sides[1])[3])
    hl, m = rl, np.maximum(rl[:, None] - np.arange(order), 0)  # equal texts match in full
    if len(which):
        taken = units(*[[s[k] for k in which] for s in sides])
        hl = rl.copy()
        hl[which] = np.diff(taken[1])
        m[which] = gram_matches(*taken, order)
    return hl, rl, m


def _whole(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    return ~(np.asarray(hyp.is_null()) | np.asarray(ref.is_null()))


def _statistics(found: list[tuple], prefix: str, order: int) -> pa.Array:
    """``found`` holds, for each way that pairs went, which ones did and
    their lengths and matches; the other rows are null."""
    n_rows = len(found[0][0])
    missing, hl, rl, m = np.ones(n_rows, bool), *np.zeros((2, n_rows), np.int64), np.zeros((n_rows, order), np.int64)
    for which, *values in found:
        missing &= ~which
        hl[which], rl[which], m[which] = values
    columns = [hl, rl]
    for n in range(1, order + 1):
        h, r = np.maximum(hl - n + 1, 0), np.maximum(rl - n + 1, 0)
        if prefix == "c_":  # hypothesis n-grams only count when the reference has that order
            h = np.where(r > 0, h, 0)
        columns += [h, r, m[:, n - 1]]
    names = _statistics_type(prefix, order).names
    return pa.StructArray.from_arrays([pa.array(c, pa.int64(), mask=missing) for c in columns], names=names)


def _taken(columns: tuple[pa.Array, pa.Array], which: np.ndarray) -> list[pa.Array]:
    return [c.filter(pa.array(which)) for c in columns]


def bleu_statistics(hyp, ref, order: int = BLEU_ORDER) -> Column:
    """BLEU statistics of a pair as a struct ``b_*``; null fields where a side is null."""
    @F.arrow_udf(_statistics_type("b_", order))
    def count(hyp: pa.Array, ref: pa.Array, hyp_words: pa.Array, ref_words: pa.Array) -> pa.Array:
        long, short = _whole(hyp, ref), _whole(hyp_words, ref_words)
        units = _word_units(*_taken((hyp_words, ref_words), short))
        return _statistics([(long, *_measured(*_taken((hyp, ref), long), _word_lists, order)),
                            (short, np.diff(units[1]), np.diff(units[3]), gram_matches(*units, order))], "b_", order)

    long = (F.char_length(hyp) >= LONG_TEXT) | (F.char_length(ref) >= LONG_TEXT)
    return count(F.when(long, hyp), F.when(long, ref), F.when(~long, tokenize_13a(hyp)), F.when(~long, tokenize_13a(ref)))


def chrf_statistics(hyp, ref, order: int = CHRF_ORDER) -> Column:
    """chrF statistics of a pair as a struct ``c_*``; null fields where a side is null."""
    @F.arrow_udf(_statistics_type("c_", order))
    def count(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        whole = _whole(hyp, ref)
        return _statistics([(whole, *_measured(*_taken((hyp, ref), whole), _char_lists, order))], "c_", order)

    return count(hyp, ref)


def row_statistics(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", metrics: str = "bc", keep: list[str] | None = None,
                   bleu_order: int = BLEU_ORDER, chrf_order: int = CHRF_ORDER) -> DataFrame:
    """Each row's statistics beside the columns ``keep`` (all by default), with 1
    in ``n_pairs``, or in ``n_skipped`` where a side is null.  A projection: it serves
    streams as it serves tables."""
    both = F.col(ref).isNotNull() & F.col(hyp).isNotNull()
    keep = list(pairs.columns) if keep is None else keep
    staged = []
    if "b" in metrics:
        staged.append(bleu_statistics(F.col(hyp), F.col(ref), bleu_order).alias("_b"))
    if "c" in metrics:
        staged.append(chrf_statistics(F.col(hyp), F.col(ref), chrf_order).alias("_c"))
    counts = [both.cast("long").alias("n_pairs"), (~both).cast("long").alias("n_skipped")]
    return pairs.select(*keep, *counts, *staged).select(*keep, "n_pairs", "n_skipped", *[f"_{m}.*" for m in "bc" if m in metrics])


def pair_statistics(pairs: DataFrame, key: list[str], ref: str = "ref", hyp: str = "hyp", metrics: str = "bc",
                    carry: list[str] | None = None, bleu_order: int = BLEU_ORDER, chrf_order: int = CHRF_ORDER,
                    partitions: int | None = None) -> DataFrame:
    """Statistics of BLEU (``b_*``, if ``metrics`` has a b) and chrF (``c_*``, c).

    ``carry`` names more columns to keep, functions of the pair.  The pairs are
    spread by their key (not again where a join on it placed them: Spark then drops
    the repartition), which is also where repeated rows meet.  The partition count
    is explicit (default ``spark.sql.shuffle.partitions``): pairs are small
    beside the work they make, and AQE would merge them into a handful of tasks.
    """
    by = key + [c for c in (carry or []) if c not in key]
    count = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = pairs.select(*by, F.col(ref).alias("_ref"), F.col(hyp).alias("_hyp")).repartition(count, *key)
    distinct = base.groupBy(*by, "_ref", "_hyp").agg(F.count("*").alias("_times"))
    rows = row_statistics(distinct, "_ref", "_hyp", metrics, [*by, "_times"], bleu_order, chrf_order)
    times = {c: (F.col(c) * F.col("_times")).alias(c) for c in ("n_pairs", "n_skipped")}
    return rows.select(*[times.get(c, F.col(c)) for c in rows.columns if c != "_times"])
