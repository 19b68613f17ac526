"""Null sides and groups, and WAV files with odd chunks and folders."""

import struct

import pytest

from lectern.functions import text
from lectern.operators import errors, mt_metrics
from lectern.sources import audio

PAIRS = [(1, "a b c d x", "a b c d e", "g"), (2, "a b c d e", None, "g"), (3, None, "a b c d e", None), (4, "a b c d e", "a b c d e", None)]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame(PAIRS, "k long, ref string, hyp string, g string")


def test_null_sides_have_no_error_rate(pairs):
    report = errors.asr_report(pairs).first()
    assert errors.wer(pairs).first()["wer"] == report["wer"] == 10.0
    assert errors.cer(pairs).first()["cer"] == report["cer"]


def test_null_sides_and_groups_of_bleu_and_chrf(pairs):
    got = {r["g"]: r for r in mt_metrics.corpus_scores(pairs, ["k"], ["g"]).collect()}
    assert set(got) == {"g", None} and got[None]["bleu"] == pytest.approx(100.0) and got[None]["n_pairs"] == got["g"]["n_pairs"] == 1
    rows = {r["k"]: r for r in mt_metrics.sentence_scores(pairs, ["k"]).collect()}
    assert rows[2]["bleu"] is None and rows[3]["chrf"] is None and rows[4]["chrf"] == pytest.approx(100.0) and len(rows) == 4


def test_an_empty_list_deletes_nothing(spark):
    df = spark.createDataFrame([("a, b!",)], "t string")
    assert df.selectExpr(f"regexp_replace(t, '{text.ignore_class([])}', '') as t").first()["t"] == "a, b!"


def wav(seconds, *before):
    data = b"\0\0" * int(16000 * seconds)
    chunks = b"".join(t + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for t, b in before)
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + chunks + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def test_chunks_are_walked_not_searched(spark, tmp_path):
    root = tmp_path / "test" / "with space+ẹ"
    (root / "train").mkdir(parents=True)
    (root / "train" / "junk.wav").write_bytes(wav(1, (b"JUNK", b"x" * 5000)))
    (root / "train" / "list.wav").write_bytes(wav(1, (b"LIST", b"a comment with metadata in it")))
    (root / "train" / "bad.wav").write_bytes(b"no header")
    (root / "train" / "metadata.csv").write_text("file_name,transcription\njunk.wav,one\nlist.wav,two\n")
    got = {r["file_name"]: r for r in audio.read_audio_folder(spark, str(root)).collect()}
    assert {k: (r["n_samples"], r["duration"], r["transcription"]) for k, r in got.items()} == {
        "junk.wav": (16000, 1.0, "one"), "list.wav": (16000, 1.0, "two"), "bad.wav": (None, None, None)}
    assert {r["split"] for r in got.values()} == {"train"}
