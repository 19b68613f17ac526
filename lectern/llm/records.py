"""Token ids in files of length-delimited binary records.

A shard is one file of framed records and one offset index.  A frame is

    length of the record        uint64
    masked checksum of it       uint32
    record                      whether it has an id (1 byte), the id (int64),
                                the bytes of a token id (1 byte: 2 or 4), and
                                the token ids in that width
    masked checksum of it       uint32

all little-endian.  A masked checksum is the CRC-32 rotated right by 15 bits
plus a constant, so that a checksum of data that holds checksums stays useful.
The index is a file of uint64 pairs (offset, length) of the frames; with it a
reader takes any record of a shard, in any order, by one range read.

Files get a name of their own for each task attempt, and only those that the
manifest lists count: a task that runs twice, or a lost executor, leaves an
unlisted file and never a wrong one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, pairs, shuffle_partitions, slices
from lectern.llm.subword import LibraryEncoder
from lectern.session import checkpoint_dir

MASK_DELTA = 0xA282EAD8
END_ID = 1
#: Leading bytes of a text that split rows of one id between shards.
LEAD = 24
_MANIFEST = "shard int, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    head = struct.pack("<Q", len(record))
    return head + struct.pack("<I", masked(head)) + record + struct.pack("<I", masked(record))


def unframe(data: bytes) -> bytes:
    """The record in a frame; raises if a length or a checksum is wrong."""
    head, (length, head_sum) = data[:8], struct.unpack_from("<QI", data)
    record, (tail,) = data[12:-4], struct.unpack("<I", data[-4:])
    if head_sum != masked(head) or length != len(record) or tail != masked(record):
        raise ValueError("damaged record")
    return record


def pack_record(id_: int | None, ids: bytes) -> bytes:
    """``ids`` as uint32; they are stored in two bytes each where all fit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = len(wide) == 0 or int(wide.max()) < 1 << 16
    return struct.pack("<?qB", id_ is not None, id_ or 0, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)


def unpack_record(record: bytes) -> tuple[int | None, bytes]:
    has, id_, width = struct.unpack_from("<?qB", record)
    ids = record[10:]
    return id_ if has else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def write_shards(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode every whole text and write it in ascending id order; returns the
    manifest, one row per shard in order.

    Null texts count as empty and give the end id alone, texts of any length are
    one record.  Rows without an id come first; rows that repeat an id stand
    together, by their leading bytes, and may go on in the next shard.  An empty
    table gives an empty manifest; other columns are not read.
    """
    n = shards or shuffle_partitions(df.sparkSession)
    # a repeated id is spread by its rows' leading bytes, and by their places where these are alike
    rows = (pairs(df, id_col, text_col).withColumn("seq", F.monotonically_increasing_id())
            .repartitionByRange(n, "id", F.substring("data", 1, LEAD), "seq").sortWithinPartitions("id", "data", "seq").drop("seq"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        coder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        store = out = None
        offsets, at, tokens = [], 0, 0
        end = struct.pack("<I", end_id)
        for keys, datas in slices(batches):
            if out is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{path}.rec", buffer_size=1 << 20)
            for id_, ids in zip(keys, coder.encode(datas)):
                # the flag tells a missing id from any real one
                data = frame(pack_record(id_, ids + end))
                out.write(data)
                offsets.append((at, len(data)))
                at += len(data)
                tokens += len(ids) // 4 + 1
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}.idx") as index:
                index.write(np.asarray(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "records": len(offsets), "tokens": tokens, "bytes": at}],
                                             schema=_MANIFEST_ARROW)

    return cut(rows.mapInArrow(write, _MANIFEST))


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()),
                             ("tokens", pa.int64()), ("bytes", pa.int64())])
_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    """One for each worker process; it remembers chunks from task to task."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path, spaces_dropped=True)
    return _encoders[path]


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """``(shard, before, id, ids)`` for every record of the listed shards: the
    number of ids before it in its shard, and its token ids as little-endian
    uint32 bytes.  Records are found through the offset index and checked against
    their lengths and checksums."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                before = 0
                with store.open_input_file(f"{path}.rec") as f:
                    for at in range(0, len(index), 512):
                        part = index[at:at + 512]
                        base = int(part[0, 0])
                        raw = f.read_at(int(part[-1].sum()) - base, base)
                        recs = [unpack_record(unframe(raw[o - base:o - base + n])) for o, n in part.tolist()]
                        ends = before + np.cumsum([len(ids) // 4 for _, ids in recs])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard] * len(recs), pa.int32()), pa.array(np.concatenate(([before], ends[:-1])), pa.int64()),
                             pa.array([k for k, _ in recs], pa.int64()), pa.array([ids for _, ids in recs], pa.binary())],
                            names=["shard", "before", "id", "ids"])
                        before = int(ends[-1])

    paths = manifest.select("shard", "path")
    return paths.repartition(shuffle_partitions(manifest.sparkSession), "shard").mapInArrow(
        read, "shard int, before long, id long, ids binary")


def encode_to_files(df: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards and read them back: ``id``, ``ids`` (bytes) and
    ``start``, the number of ids in all records before."""
    folder = folder or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/records-{uuid.uuid4().hex}"
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    manifest = write_shards(df, uri, tokenizer, **options)
    # one row a file
    base = manifest.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    return (read_shards(manifest, uri)
            .join(F.broadcast(base), "shard")
            .select("id", (F.col("base") + F.col("before")).alias("start"), "ids"))
