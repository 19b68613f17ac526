"""Audio folders through Spark's ``binaryFile`` source.

The manifest (rate, channels, bit depth, sample count, duration) is read by
walking the chunks of each WAV file, wherever ``fmt `` and ``data`` stand.
Listing selects ``path``/``length`` only, so Spark does not read file contents
for it; the tasks then read the chunks' headers by ranges of each file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wav

SPLITS = ("train", "validation", "test")


def _binary(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root))


def list_audio(spark: SparkSession, root: str) -> DataFrame:
    """Every ``.wav`` below ``root`` (case-sensitive suffix)."""
    return _binary(spark, root).select("path", "length")


_HEADER = "struct<sampling_rate:int,channels:int,bits:int,data_offset:bigint,n_samples:bigint,duration:double>"


#: Bytes that one read of a file asks for: most files' headers at once.
RANGE = 512
#: Files that a task asks for at a time (a store answers slowly, but many at once).
READERS = 16


def _described(found: tuple | None) -> tuple | None:
    if found is None:
        return None
    form, at, size = found
    n = size // form.frame if form.frame else None
    return form.rate, form.channels, form.bits, at, n, n / form.rate if n is not None and form.rate else None


def walk_riff(content: bytes) -> tuple | None:
    """Rate, channels, bits, data offset, samples per channel and seconds of a WAV
    file, found chunk by chunk; None if it has no ``fmt `` or ``data`` chunk."""
    return _described(wav.walk(lambda at, n: content[at:at + n], len(content)))


def ranged(read_at: Callable[[int, int], bytes], size: int = RANGE) -> Callable[[int, int], bytes]:
    """``read(at, n)`` over ``read_at(at, n)`` that asks for ``size`` bytes at a time
    and answers from those it has."""
    start, held = 0, b""

    def read(at: int, n: int) -> bytes:
        nonlocal start, held
        if not start <= at <= at + n <= start + len(held):
            start, held = at, read_at(at, max(size, n))
        return held[at - start:at - start + n]

    return read


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path as ``binaryFile`` gives it (not URL-encoded)."""
    local = re.match("^file:/+", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), "/" + path[local.end():] if local else path
    scheme, _, rest = path.partition("://")
    host, _, inner = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}://{host}/")
    return system, f"{base.rstrip('/')}/{inner}"


def read_header(path: str, length: int) -> tuple | None:
    """``walk_riff`` of a file, of which only the chunks' headers are read."""
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        return _described(wav.walk(ranged(lambda at, n: f.read_at(max(min(n, length - at), 0), at)), length))


def header_columns(content: Column) -> dict[str, Column]:
    @F.udf(_HEADER, useArrow=True)
    def header(data):
        return walk_riff(bytes(data)) if data is not None else None

    h = header(content)
    return {k: h[k] for k in ("sampling_rate", "channels", "bits", "data_offset", "n_samples", "duration")}


_MANIFEST = [("sampling_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("data_offset", pa.int64()),
             ("n_samples", pa.int64()), ("duration", pa.float64())]


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with ThreadPoolExecutor(READERS) as pool:
        for batch in batches:
            paths, lengths = (batch.column(k).to_pylist() for k in (0, 1))
            found = list(pool.map(read_header, paths, lengths))
            columns = [pa.array([f and f[k] for f in found], kind) for k, (_, kind) in enumerate(_MANIFEST)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns],
                                             names=["path", "length", *[c for c, _ in _MANIFEST]])


def audio_manifest(spark: SparkSession, root: str, with_content: bool = False, ranges: bool = True) -> DataFrame:
    """``path, length, sampling_rate, channels, bits, data_offset,
    n_samples, duration`` per WAV file, and its bytes when asked for.

    Without the bytes a task reads ranges of each file, some hundred bytes of
    it however long it is.  ``ranges=False`` is for stores that only Spark can
    open: whole files are read then.
    """
    if ranges and not with_content:
        return list_audio(spark, root).mapInArrow(_read_headers, "path string, length long, sampling_rate int, channels int, bits int, "
                                                                 "data_offset long, n_samples long, duration double")
    df = _binary(spark, root)
    kept = ["path", "length"] + (["content"] if with_content else [])
    return df.select(*kept, *[c.alias(k) for k, c in header_columns(F.col("content")).items()])


def _folder(path: Column) -> Column:
    """Parent folder of a file URI; ``file:///x`` and ``file:/x`` compare equal."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "file:/"), "/[^/]*$", "")


def _decoded(uri: Column) -> Column:
    """``_metadata.file_path`` is URL-encoded, the ``path`` of binaryFile isn't."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def _below(path: Column, root: str) -> Column:
    """The path relative to ``root``, with a leading slash."""
    plain = F.regexp_replace(path, "^[a-zA-Z0-9+.-]+:/*", "/")
    top = re.sub("^[a-zA-Z0-9+.-]+:/*", "/", root).rstrip("/")
    at = F.locate(top + "/", plain)
    return F.when(at > 0, plain.substr(at + len(top), F.length(plain))).otherwise(plain)


def split_of(path: Column) -> Column:
    """The split named by the first such segment of a path relative to the
    audio folder; a folder without splits is train."""
    s = F.regexp_extract(path, "/(train|validation|test)/", 1)
    return F.when(s == "", F.lit("train")).otherwise(s)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """``metadata.csv`` files (``file_name, transcription``) below ``root``."""
    schema = T.StructType([T.StructField("file_name", T.StringType()),
                           T.StructField("transcription", T.StringType())])
    md = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("recursiveFileLookup", True)
          .option("pathGlobFilter", "metadata.csv").csv(root))
    return md.withColumn("_dir", _folder(_decoded(F.col("_metadata.file_path"))))


def read_audio_folder(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """S3: audio rows with transcription and split.

    Files and metadata are matched on ``(folder, file name)`` (J2).  The audio
    bytes, where asked for, come from the scan that read the headers and go
    through the join; leave them out to join one small row per clip.
    """
    man = audio_manifest(spark, root, with_content)
    man = (man.withColumn("_dir", _folder(F.col("path")))
           .withColumn("file_name", F.regexp_extract("path", "([^/]*)$", 1)))
    md = read_metadata(spark, root)
    out = man.join(md, ["_dir", "file_name"], "left").withColumn("split", split_of(_below(F.col("path"), root)))
    return out.drop("_dir")


def select_split(df: DataFrame, name: str) -> DataFrame:
    """Rows of one split."""
    return df.where(F.col("split") == name)
