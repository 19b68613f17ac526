"""Files that the registered queries write and read: the library's sinks."""

import os

import pytest

from lectern.plans import catalog
from lectern.sinks import writers as WR
from tests.conftest import SF_SMALL


def test_write_files(spark, tmp_path):
    rows = [("a/b c.bin", bytearray(b"one")), ("a/ẹ%20.bin", bytearray(b"")), ("top.bin", bytearray(b"x" * 100_000)), ("none.bin", None), (None, bytearray(b"z"))]
    df = spark.createDataFrame([(n, c, 1) for n, c in rows], "name string, content binary, other int")
    for _ in range(2):  # a second run leaves the same files
        WR.write_files(df, str(tmp_path / "out dir"))
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out dir"): open(os.path.join(d, f), "rb").read()
             for d, _, files in os.walk(tmp_path / "out dir") for f in files}
    assert found == {n: bytes(c) for n, c in rows[:3]}


@pytest.mark.parametrize("name", ["audio_folder", "resampled_clips", "infer_resumed"])
def test_queries_over_files_have_all_rows(spark, name):
    source = "conversations" if name == "infer_resumed" else "embeddings"
    got = catalog.QUERIES[name](spark, SF_SMALL)
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/{source}.parquet").count()
