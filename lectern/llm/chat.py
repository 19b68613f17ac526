"""Chat formatting by columnar byte assembly.

The turns of a batch are laid out at once: the lengths of all headers, contents
and ends are added up to offsets, and every byte is scattered to its place in one
preallocated buffer, which becomes the Arrow column of formatted texts without a
copy.  The loss mask falls out of the same offsets.

A turn reads ``<turn role="ROLE">``, a line feed, the text, a line feed,
``</turn>`` and a line feed.  Backslashes in a text are doubled, and a backslash
goes before each ``<turn`` and ``</turn``, so an end of turn never stands in a
text and taking one backslash from each pair gives the text back.  In a role,
backslashes, double quotes and line feeds are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut
from lectern.llm.turns import sort_by_range, turn_columns, turn_order

HEAD, HEAD_END, END = '<turn role="', '">\n', "\n</turn>\n"
_END = END.encode()
#: A conversation over so many bytes comes in several pieces.
PIECE_BYTES = 4 << 20
#: Contents over so many bytes are copied as slices, not by scatter indices.
_SLICE = 1 << 16


def escape_text(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in ("<turn", "</turn"):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def header(role: Column) -> Column:
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(HEAD), out, F.lit(HEAD_END))


def unescape_text(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", data, flags=re.S) if b"\\" in data else data


def _unescape_role(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], data, flags=re.S) if b"\\" in data else data


def parse(data: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted piece."""
    out = []
    for turn in data.split(_END)[:-1]:
        head, _, body = turn.partition(b"\n")
        out.append((_unescape_role(head[len(HEAD):-2]), unescape_text(body)))
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data and the n + 1 offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def _scatter(out: np.ndarray, dest: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment k of ``data`` to ``out[dest[k]:]``, for all k."""
    lengths = np.diff(offsets)
    for k in np.flatnonzero(lengths > _SLICE):
        out[dest[k]:dest[k] + lengths[k]] = data[offsets[k]:offsets[k + 1]]
    small = np.where(lengths > _SLICE, 0, lengths)
    ends = np.cumsum(small)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - small, small)
    out[np.repeat(dest, small) + within] = data[np.repeat(offsets[:-1], small) + within]


def assemble(head: pa.Array, body: pa.Array, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted pieces of the turns ``head, body``; piece k begins at turn
    ``begins[k]``.  Returns the string column and, in its bytes, where each turn's
    content begins and ends."""
    head_data, head_at = _bytes(head)
    body_data, body_at = _bytes(body)
    lengths = np.stack([np.diff(head_at), np.diff(body_at), np.full(len(head), len(_END))], 1)
    ends = np.cumsum(lengths.ravel()).reshape(-1, 3)
    starts = ends - lengths
    out = np.empty(ends[-1, 2] if len(ends) else 0, np.uint8)
    _scatter(out, starts[:, 0], head_data, head_at)
    _scatter(out, starts[:, 1], body_data, body_at)
    out[starts[:, 2][:, None] + np.arange(len(_END))] = np.frombuffer(_END, np.uint8)
    offsets = np.append(starts[begins, 0], len(out)).astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return text, starts[:, 1], ends[:, 1]


_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()),
                     ("loss_begins", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def _pieces(piece_bytes: int):
    def lay(rows: pa.Table, number: int, opens: bool, closes: bool) -> pa.RecordBatch:
        """Pieces of whole runs of rows; ``opens`` and ``closes``: the first and the
        last may go on before and after."""
        ids = rows.column("id")
        key, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
        text, lo, hi = assemble(rows.column("head"), rows.column("body"), begins)
        n = len(begins)
        counts = np.diff(np.append(begins, len(rows)))
        base = np.repeat(np.frombuffer(text.buffers()[1], np.int32)[:-1], counts)
        masked = rows.column("loss").to_numpy(zero_copy_only=False)
        spans = pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(masked.astype(np.int64), begins)))), pa.int32())
        whole = np.ones(n, bool)
        whole[0] &= not opens
        whole[-1] &= not closes
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(begins)), pa.array((rows.column("part")[0].as_py() << 32) + number + np.arange(n)), pa.array(whole),
             pa.array(counts, pa.int64()), text,
             *[pa.ListArray.from_arrays(spans, pa.array((x - base)[masked], pa.int64())) for x in (lo, hi)]], schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, own, last, number, opens = [], 0, 0, (), 0, True

        def flush(closes: bool):
            nonlocal held, held_bytes, number, opens
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_bytes = [], 0
            out = lay(rows, number, opens, closes)
            number, opens = number + out.num_rows, closes
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_pylist()
            sizes = _sizes(batch)
            lo = 0
            for k, (id_, size) in enumerate(zip(ids, sizes)):
                # conversations stay together unless one alone is over the limit
                goes_on = last == (id_,)
                if held_bytes >= piece_bytes and (not goes_on or own >= piece_bytes):
                    if k > lo:
                        held.append(batch.slice(lo, k - lo))
                    lo = k
                    yield flush(closes=goes_on)
                    own = 0
                own = size + (own if goes_on else 0)
                held_bytes, last = held_bytes + size, (id_,)
            held.append(batch.slice(lo))
        if held:
            yield flush(closes=True)

    def _sizes(batch: pa.RecordBatch) -> list[int]:
        return (np.diff(_bytes(batch.column("head"))[1]) + np.diff(_bytes(batch.column("body"))[1]) + len(_END)).tolist()

    return run


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_roles: tuple[str, ...] = ("assistant",), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Formatted conversations: ``id, piece, whole, n_turns, text, loss_begins,
    loss_ends``.

    A conversation is one row, or several where it has over ``piece_bytes`` or
    passes the border of a partition; its pieces follow each other by ``piece``, and only rows that are
    ``whole`` are sure to be a conversation of their own.  ``text`` is made of
    whole turns; the spans are the bytes of it that carry loss: the contents of
    turns whose role is in ``loss_roles``, as escaped.

    Turns stand by number, null first, rows of one number by role, leading
    characters and hash of the text; repeated rows are turns of their own.  Null
    roles and texts are empty; rows without an id are one conversation.  A text
    of any length stays whole in its turn.  An empty table gives no rows; other
    columns are not read.
    """
    rows = sort_by_range(turn_columns(df, id_col, turn_col, role_col, text_col), *turn_order())
    laid = rows.select("id", "part", header(F.col("role")).cast("binary").alias("head"), escape_text(F.col("text")).cast("binary").alias("body"),
                       F.col("role").isin(*loss_roles).alias("loss"))
    return laid.mapInArrow(_pieces(piece_bytes), "id long, piece long, whole boolean, n_turns long, text string, "
                                                 "loss_begins array<long>, loss_ends array<long>")


_DIGESTS = pa.schema([("id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    """What one conversation's pieces, read in order, say."""

    def __init__(self, id_: int | None):
        self.id, self.n, self.chars, self.loss_chars = id_, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, data: bytes, begins: list[int], ends: list[int]) -> None:
        for role, text in parse(data):
            self.n += 1
            self.turns.update(role + b"\n" + text + b"\n")
        for lo, hi in zip(begins, ends):
            text = unescape_text(data[lo:hi])
            self.loss.update(text)
            self.loss_chars += len(text.decode())
        self.chars += len(data.decode())

    def row(self) -> tuple:
        return self.id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of pieces of one id; pieces are read one at a time."""
    open_ = None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _DIGESTS.types)], schema=_DIGESTS)

    for batch in batches:
        done = []
        texts = batch.column("text").cast(pa.large_binary())
        for k, id_ in enumerate(batch.column("id").to_pylist()):
            if open_ is not None and open_.id != id_:
                done.append(open_.row())
                open_ = None
            open_ = open_ or _Reader(id_)
            open_.add(texts[k].as_py(), batch.column("loss_begins")[k].as_py(), batch.column("loss_ends")[k].as_py())
        if done:
            yield out(done)
    if open_ is not None:
        yield out([open_.row()])


_MIXED = "id long, piece long, text string, loss_begins array<long>, loss_ends array<long>, n_turns long, turns_sha256 string, " \
         "loss_chars long, loss_sha256 string, formatted_chars long"


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole pieces; the others as they are."""
    names = [c.split()[0] for c in _MIXED.split(", ")]
    for batch in batches:
        whole = batch.column("whole")
        rest = batch.filter(pa.array(~whole.to_numpy(zero_copy_only=False)))
        for part in (rest, *_read([batch.filter(whole)])):
            if part.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) if c in part.schema.names and (part is not rest or c != "n_turns") else pa.nulls(part.num_rows, kind)
                     for c, kind in zip(names, _MIXED_TYPES)], names=names)


_MIXED_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *_DIGESTS.types[1:]]


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say, read from their texts and loss spans:
    ``id, n_turns, turns_sha256`` (role, line feed, text, line feed of each turn),
    ``loss_chars, loss_sha256`` (all text under the loss mask, unescaped) and
    ``formatted_chars``.

    Whole pieces are read where they are.  Those of conversations that were cut go
    to one task for each conversation, which reads them one after the other
    and holds one at a time: a digest over a sequence has to see it in order.
    """
    seen = cut(formatted.mapInArrow(_read_whole, _MIXED))
    columns = _DIGESTS.names
    parts = seen.where("text is not null").select("id", "piece", "text", "loss_begins", "loss_ends")
    joined = parts.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(
        _read, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return seen.where("text is null").select(*columns).unionByName(joined.select(*columns))
