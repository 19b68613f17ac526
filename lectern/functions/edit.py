"""Edit distances as native expressions.

Spark's ``levenshtein`` counts code points.  For a word-level distance each
distinct word of a pair is mapped to one supplementary-plane code point
(U+10000 + index) and the two encoded strings go through ``levenshtein``:
equal words get equal code points, so the distance is the word distance.

The helpers work in staged projections.  Catalyst's CollapseProject inlines a
producer that is referenced once, even when that one reference sits inside a
lambda and is therefore evaluated per array element; every expensive
intermediate here is referenced at least twice so it is computed once per row.

Pairs of whole documents go another way (:func:`document_errors`): the word codes
above are quadratic in distinct words, and ``levenshtein`` takes a step per cell.
A bit-parallel distance takes a step per row, with a row's cells as bits, and
makes only the cells near the diagonal that a path of its length can reach.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the distance table (product of both lengths) from which only the
#: diagonals that matter are made.
LONG_CELLS = 1 << 18

# first code point used for word ids; 0x10000 + 1,048,575 = U+10FFFF
_BASE = 0xFFFF


def _encode(words: Column, vocab: Column) -> Column:
    hexes = F.transform(
        words, lambda w: F.lpad(F.hex(F.lit(_BASE) + F.array_position(vocab, w)), 8, "0")
    )
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32")


def word_edit_distance(ref_words, hyp_words) -> Column:
    """Levenshtein distance between two word-array columns (single expression;
    pass plain column references, see :func:`with_word_distance`)."""
    r = F.col(ref_words) if isinstance(ref_words, str) else ref_words
    h = F.col(hyp_words) if isinstance(hyp_words, str) else hyp_words
    vocab = F.array_distinct(F.concat(r, h))
    return F.levenshtein(_encode(r, vocab), _encode(h, vocab))


def with_word_distances(df: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``out = word distance(ref_col, hyp_col)`` for each ``(ref, hyp, out)``.

    ``ref``/``hyp`` must already be array columns of ``df``.  Two projections:
    the per-pair word list, then the encoded distance.
    """
    keep = [F.col(c) for c in df.columns]
    vocab = [F.array_distinct(F.concat(F.col(r), F.col(h))).alias(f"_v_{o}") for r, h, o in specs]
    staged = df.select(*keep, *vocab)
    dist = [F.levenshtein(_encode(F.col(r), F.col(f"_v_{o}")), _encode(F.col(h), F.col(f"_v_{o}"))).alias(o)
            for r, h, o in specs]
    return staged.select(*keep, *dist)


def char_edit_distance(ref, hyp) -> Column:
    return F.levenshtein(F.col(ref) if isinstance(ref, str) else ref,
                         F.col(hyp) if isinstance(hyp, str) else hyp)


def _codes(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as small numbers, equal ones for equal symbols."""
    if isinstance(a, str) and isinstance(b, str):
        both = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), "<u4")
        seen = np.zeros(int(both.max()) + 1 if len(both) else 1, np.int32)
        seen[both] = 1
        both = (np.cumsum(seen, dtype=np.int32) - 1)[both]
    else:
        known: dict = {}
        both = np.fromiter((known.setdefault(x, len(known)) for x in (*a, *b)), np.int32, len(a) + len(b))
    return both[:len(a)], both[len(a):]


def _few_edits(a: Sequence, b: Sequence, limit: int) -> int | None:
    """The distance if it is at most ``limit``: for each number of edits, how far
    every diagonal gets (``far[k]``: symbols of ``a``, k more than of ``b``)."""
    m, n = len(a), len(b)

    def run(x: int, y: int) -> int:
        """Symbols of ``a`` up to the next difference."""
        step = 16
        while x < m and y < n and a[x] == b[y]:
            if a[x:x + step] == b[y:y + step]:
                x, y = x + step, y + step
                step *= 2
            else:
                x, y, step = x + 1, y + 1, max(step // 2, 2)
        return min(x, m, n + x - y)

    low = -n - 2  # no diagonal this far out
    far = {0: run(0, 0)}
    for edits in range(limit + 1):
        if far.get(m - n, low) >= m:
            return edits
        new = {}
        for k in range(max(-edits - 1, -n), min(edits + 1, m) + 1):
            x = max(far.get(k - 1, low) + 1, far.get(k, low) + 1, far.get(k + 1, low))
            x = min(x, m, n + k)
            new[k] = run(x, x - k) if x >= 0 and x - k >= 0 else low
        far = new
    return None


class _Places(dict):
    """Places of each symbol; those of one are made an integer when asked for."""

    def __missing__(self, x: int) -> int:
        row = bytearray(self.size)
        for i in self.at.get(x, ()):
            row[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(row, "little")


def _masks(rows: np.ndarray, columns: np.ndarray) -> dict[int, int]:
    """For each symbol of ``columns`` an integer with a bit where ``rows`` has it.
    Memory is linear in the rows: integers of many symbols aren't kept."""
    wanted = np.unique(columns).tolist()
    if len(wanted) * 16 <= len(rows) and len(wanted) <= 256:
        return {x: int.from_bytes(np.packbits(rows == x, bitorder="little").tobytes(), "little") for x in wanted}
    if len(rows) > 4096:
        out = _Places()
        out.size, out.at = len(rows) // 8 + 1, {}
        for i, x in enumerate(rows.tolist()):
            out.at.setdefault(x, []).append(i)
        return out
    out = dict.fromkeys(wanted, 0)
    for i, x in enumerate(rows.tolist()):
        if x in out:
            out[x] |= 1 << i
    return out


def _within(a: np.ndarray, b: np.ndarray, extra: int) -> int:
    """The length of the best path that leaves the diagonals between both corners
    by at most ``extra``; ``a`` is at least as long as ``b``.  The columns go in
    blocks, each with the rows that its diagonals meet."""
    m, n = len(a), len(b)
    band = m - n + 2 * extra
    block = max(512, band)
    rises = falls = lo = hi = top = 0  # rows lo to hi, and the value above row lo
    for at in range(0, n, block):
        end = min(at + block, n)
        first, last = max(0, at - extra), min(m, end + m - n + extra)
        if gone := first - lo:
            below = (1 << gone) - 1
            top += (rises & below).bit_count() - (falls & below).bit_count()
            rises, falls, lo = rises >> gone, falls >> gone, first
        # rows met anew are reached from the one above
        rises |= (1 << last - lo) - (1 << hi - lo)
        hi = last
        full = (1 << hi - lo) - 1
        masks = _masks(a[lo:hi], b[at:end])
        for x in b[at:end].tolist():
            same = masks[x]
            level = ((((same & rises) + rises) ^ rises) | same | falls) & full
            up = (falls | full ^ (level | rises)) << 1 | 1
            down = (rises & level) << 1
            falls = up & level
            rises = (down | ~(level | up)) & full
        top += end - at
    return top + rises.bit_count() - falls.bit_count()


def bit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable symbols in linear memory.

    Common ends are left out, and the differing numbers of each symbol give the
    least distance there can be.  Where it is small, the paths of few edits are
    followed diagonal by diagonal.  Otherwise a bit-parallel table is made:
    the differences down a column are two integers, one with the bits where the
    value rises by one and one where it falls, and each symbol of the shorter
    sequence turns one column into the next by a few operations on them.  Only
    the diagonals that a path of the expected length can reach are made, more of
    them when the path found is longer than that, so the work is a step per symbol
    and as many bits as there are differences."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    ca, cb = _codes(a, b)
    n = len(cb)
    other = np.flatnonzero(ca[:n] != cb)
    lo = int(other[0]) if len(other) else n
    other = np.flatnonzero(ca[len(ca) - n + lo:] != cb[lo:])
    tail = n - lo - 1 - int(other[-1]) if len(other) else n - lo
    a, b, ca, cb = a[lo:len(a) - tail], b[lo:n - tail], ca[lo:len(ca) - tail], cb[lo:n - tail]
    m, n = len(ca), len(cb)
    if not n:
        return m
    size = int(max(ca.max(), cb.max())) + 1
    more = np.bincount(ca, minlength=size) - np.bincount(cb, minlength=size)
    least = int(more[more > 0].sum())  # a is the longer one
    few = int((n // 2) ** 0.5)
    if least <= few and (found := _few_edits(a, b, few)) is not None:
        return found
    extra = n if m * n < LONG_CELLS else (least - (m - n)) // 2 + max(least // 8, 16)
    while True:
        extra = min(extra, n)
        found = _within(ca, cb, extra)
        # a path of this length leaves the diagonals by half of what it is longer
        if (found - (m - n)) // 2 <= extra or extra == n:
            return found
        extra = min(4 * extra, (found - (m - n)) // 2)


_BLANKS = re.compile(r"\s\s+")


def _collapsed(column: pa.Array) -> list[str | None]:
    """:func:`lectern.functions.tokenize.collapse_strip` of each text."""
    return [None if x is None else _BLANKS.sub(" ", x.decode("utf-8", "replace")).strip() for x in column.cast(pa.binary()).to_pylist()]


_ERRORS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("wer_err", "wer_n", "cer_err", "cer_n")])


def document_errors(ref, hyp, words: bool = True, characters: bool = True) -> Column:
    """A struct of the distances and reference lengths in words (``wer_err``,
    ``wer_n``) and characters (``cer_err``, ``cer_n``) of two texts of any length.
    A distance is null where a side is, a length where the reference is."""

    @F.arrow_udf(_ERRORS)
    def count(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        out: list[list[int | None]] = [[], [], [], []]
        for r, h in zip(_collapsed(ref), _collapsed(hyp)):
            found: list[int | None] = [None] * 4
            if r is not None:
                listed = [w for w in r.split(" ") if w]
                found[1], found[3] = len(listed), len(r)
                if h is not None and words:
                    found[0] = bit_distance(listed, [w for w in h.split(" ") if w])
                if h is not None and characters:
                    found[2] = bit_distance(r, h)
            for c, v in zip(out, found):
                c.append(v)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in out], names=_ERRORS.names)

    return count(ref, hyp)
