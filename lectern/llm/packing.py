"""Sum-of-squares online packing of token sequences into windows.

Every document is cut into whole windows and a rest.  A rest of s tokens goes on
top of an open window of the level h that makes the sum of the squared numbers
of open windows at each level smallest: moving one window from level h to h + s
changes it by 2 (N[h+s] - N[h]) + 2, a new window (h = 0) by 2 N[s] + 1, and one
that gets full by 1 - 2 N[h].  The numbers N are a level array of one entry per
level.  Each input partition packs by itself, without a shuffle.

When a partition ends, or when it holds ``max_open`` open windows, the emptiest
windows are cut up to fill the others exactly, so at most one window of a
partition stays partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lectern.llm.common import pairs, slices
from lectern.llm.subword import LibraryEncoder

WINDOW = 1024
END_ID = 0
#: Open windows that a task holds, each with at most ``WINDOW`` ids in memory.
MAX_OPEN = 4096
_SCHEMA = ("id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long")
_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64())])


class Packer:
    """The level array and the open windows of one task.

    A piece is (id, start, ids as uint32 bytes, doc_tokens).  Windows that are
    done go to ``done`` as lists of pieces.
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.done: list[list[tuple]] = []

    def level_for(self, size: int) -> int:
        """The level that makes the sum of squares smallest; ties go to the fullest."""
        top = self.window - size
        here = self.count[: top + 1]
        change = 2 * (self.count[size:] - here) + 2
        change[top] = 1 - 2 * here[top]  # gets full
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        change[0] = 2 * self.count[size] + 1
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> None:
        level = self.level_for(size)
        if level:
            bin_ = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            bin_ = []
        bin_.append(piece)
        self._put(bin_, level + size)
        if self.n_open > self.max_open:
            self.close()

    def _put(self, bin_: list, level: int) -> None:
        if level == self.window:
            self.done.append(bin_)
        else:
            self.open[level].append(bin_)
            self.count[level] += 1
            self.n_open += 1

    def add(self, id_, ids: bytes) -> None:
        """A document's ids, its end id included."""
        total, step = len(ids) // 4, self.window * 4
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.done.append([(id_, at // 4, ids[at:at + step], total)])
        if whole < len(ids):
            self.place((id_, whole // 4, ids[whole:], total), (len(ids) - whole) // 4)

    def close(self) -> None:
        """Fill the fullest open windows with cuts of the emptiest ones."""
        bins = [(h, b) for h in range(self.window) for b in self.open[h]]
        self.open, self.n_open = [[] for _ in range(self.window)], 0
        self.count[:] = 0
        lo, hi = 0, len(bins) - 1
        pool: list[tuple] = []
        while lo <= hi:
            if lo == hi and not pool:
                break
            level, target = bins[hi]
            hi -= 1
            while level < self.window and (pool or lo <= hi):
                if not pool:
                    pool = bins[lo][1]
                    lo += 1
                id_, start, ids, total = pool.pop()
                take = min(len(ids) // 4, self.window - level)
                target.append((id_, start, ids[: take * 4], total))
                if take * 4 < len(ids):
                    pool.append((id_, start + take, ids[take * 4:], total))
                level += take
            if level == self.window:
                self.done.append(target)
            else:
                bins[hi + 1] = (level, target)
                hi += 1
                if lo >= hi and not pool:
                    break
        rest = [p for _, b in bins[lo:hi + 1] for p in b] + pool
        level, bin_ = 0, []
        for id_, start, ids, total in rest:
            while ids:
                take = min(len(ids) // 4, self.window - level)
                bin_.append((id_, start, ids[: take * 4], total))
                ids, start, level = ids[take * 4:], start + take, level + take
                if level == self.window:
                    self.done.append(bin_)
                    level, bin_ = 0, []
        if bin_:
            self._put(bin_, level)


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path, spaces_dropped=False)
    return _encoders[path]


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids`` (uint32 bytes),
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``padded_to``, the length
    that the sequence is padded to (its own, if that is a power of two).

    ``sequence_id`` holds the task's number in its upper bits.  Null and empty
    texts are the end id alone.  Rows that repeat an id or have none are packed
    like others.  An empty table gives no rows; other columns are not read.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = _encoder(tokenizer), Packer(window, max_open)
        sequence = TaskContext.get().partitionId() << 36

        def out(done: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(8)]
            for pieces in done:
                fill = sum(len(p[2]) for p in pieces) // 4
                to, at = fill if fill & (fill - 1) == 0 else window, 0
                for id_, start, ids, total in pieces:
                    n = len(ids) // 4
                    for c, v in zip(cols, (id_, start, n, ids, total, sequence, at, to)):
                        c.append(v)
                    at += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        for keys, datas in slices(batches):
            for id_, ids in zip(keys, coder.encode(datas)):
                packer.add(id_, ids + end)
                if len(packer.done) > 4096:
                    full, packer.done = packer.done, []
                    yield out(full)
        coder.forget()
        packer.close()
        yield out(packer.done + [b for bins in packer.open for b in bins])

    return pairs(df, id_col, text_col).mapInArrow(run, _SCHEMA)


