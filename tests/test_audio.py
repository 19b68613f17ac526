import os
import tempfile
import wave as pcm

import numpy as np
import pytest

from lectern.functions import wav
from lectern.operators import audio as AU
from lectern.operators import filters as FL
from lectern.operators import sequence as SQ
from lectern.sources import audio as SA


def _wav(path, rate, seconds, channels=1, extra_chunk=False):
    n = int(rate * seconds)
    x = (np.sin(np.arange(n) / 10.0) * 10000).astype("<i2")
    if channels == 2:
        x = np.repeat(x, 2)
    with pcm.open(path, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    if extra_chunk:  # insert a LIST chunk before 'data'
        b = open(path, "rb").read()
        i = b.index(b"data")
        lst = b"LIST" + (4).to_bytes(4, "little") + b"INFO"
        b = b[:i] + lst + b[i:]
        b = b[:4] + (len(b) - 8).to_bytes(4, "little") + b[8:]
        open(path, "wb").write(b)
    return n


@pytest.fixture(scope="module")
def folder():
    root = tempfile.mkdtemp(prefix="lectern-audio-")
    for split in ("train", "test"):
        os.makedirs(os.path.join(root, split))
    _wav(os.path.join(root, "train", "a.wav"), 16000, 1.0)
    _wav(os.path.join(root, "train", "b.wav"), 8000, 20.0)
    _wav(os.path.join(root, "test", "c.wav"), 44100, 0.5, channels=2, extra_chunk=True)
    open(os.path.join(root, "train", "notes.WAV"), "w").write("x")
    for split, rows in (("train", [("a.wav", "hello world"), ("b.wav", "long one")]),
                        ("test", [("c.wav", "stereo clip")])):
        with open(os.path.join(root, split, "metadata.csv"), "w") as f:
            f.write("file_name,transcription\n" + "".join(f"{a},{b}\n" for a, b in rows))
    return root


def test_manifest_and_listing(spark, folder):
    assert SA.list_audio(spark, folder).count() == 3  # case-sensitive .wav suffix
    m = {os.path.basename(r.path): r for r in SA.audio_manifest(spark, folder).collect()}
    assert (m["a.wav"].sampling_rate, m["a.wav"].channels, m["a.wav"].bits, m["a.wav"].n_samples) == (16000, 1, 16, 16000)
    assert m["c.wav"].channels == 2 and m["c.wav"].n_samples == 22050  # extra chunk handled
    assert m["b.wav"].duration == pytest.approx(20.0)


def test_folder_split_and_duration_filter(spark, folder):
    df = SA.read_audio_folder(spark, folder)
    rows = {r.file_name: r for r in df.collect()}
    assert rows["c.wav"].split == "test" and rows["a.wav"].transcription == "hello world"
    kept = FL.filter_duration(df)  # 20 s exactly is dropped (strict)
    assert sorted(r.file_name for r in kept.collect()) == ["a.wav", "c.wav"]
    assert SA.select_split(df, "train").count() == 2


def test_decode_and_resample(spark, folder):
    df = SA.read_audio_folder(spark, folder, with_content=True)
    dec = {r.file_name: r for r in AU.decode_samples(df).collect()}
    assert dec["c.wav"].sampling_rate == 16000 and dec["c.wav"].n_samples == 8000
    assert dec["a.wav"].n_samples == 16000
    res = AU.resample_audio(df.select("path", "content"))
    again = SA.header_columns
    out = res.select("path", *[c.alias(k) for k, c in again(res["content"]).items()]).collect()
    assert {r.sampling_rate for r in out} == {16000}


def _clip(channels=1, bits=16, rate=44100, seconds=0.5, tones=(1000,), tag=wav.PCM):
    t = np.arange(int(rate * seconds)) / rate
    x = sum(0.4 * np.sin(2 * np.pi * f * t) for f in tones)
    return np.stack([x * (1 - 0.5 * c) for c in range(channels)], 1), wav.WavFormat(tag, channels, rate, bits)


def _level(x, rate, tone):
    """Amplitude of a tone in the middle of a clip."""
    x = x[len(x) // 4:len(x) // 4 * 3]
    t = np.arange(len(x)) / rate
    w = np.hanning(len(x))
    return 2 * abs((x * w * np.exp(-2j * np.pi * tone * t)).sum()) / w.sum()


@pytest.mark.parametrize("channels", [1, 2, 5])
@pytest.mark.parametrize("tag,bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_every_format_comes_back(channels, tag, bits):
    x, form = _clip(channels, bits, tag=tag)
    data = wav.encode(x, form)
    got, read = wav.decode(data)
    assert read == form and np.abs(got - x).max() <= (2.0 ** -min(bits - 1, 23) if tag == 1 else 1e-7)
    assert wav.encode(got, read) == data


def test_extensible_and_padded_chunks():
    x, form = _clip(2, 24)
    data = wav.encode(x, form)
    fmt = data[20:36]
    ext = wav.EXTENSIBLE.to_bytes(2, "little") + fmt[2:] + (22).to_bytes(2, "little") + b"\x18\0\3\0\0\0" + (1).to_bytes(2, "little") + b"\0" * 14
    long = data[:12] + b"odd " + (3).to_bytes(4, "little") + b"abc\0" + b"fmt " + len(ext).to_bytes(4, "little") + ext + data[36:]
    got, read = wav.decode(long)
    assert read == form and (got == wav.decode(data)[0]).all()


@pytest.mark.parametrize("rate,target", [(44100, 16000), (48000, 16000), (8000, 16000), (22050, 16000), (16000, 11025)])
def test_resampling_is_band_limited(rate, target):
    limit = min(rate, target) / 2
    low, high = 0.3 * limit, rate * 0.49
    x, _ = _clip(2, rate=rate, tones=(low, *([high] if high > limit else [])))
    y = wav.resample(x, rate, target)
    assert y.shape == (round(len(x) * target / rate), 2)
    assert _level(y[:, 0], target, low) == pytest.approx(0.4, abs=0.002) and _level(y[:, 1], target, low) == pytest.approx(0.2, abs=0.002)
    # the tone above the new limit is gone, also where it would fold down to
    rest = y[:, 0] - 0.4 * np.sin(2 * np.pi * low * np.arange(len(y)) / target)
    assert np.abs(rest[len(y) // 4:len(y) // 4 * 3]).max() < 0.003


def test_silence_and_short_clips():
    for n in (0, 1, 2, 7):
        y = wav.resample(np.zeros((n, 3)), 48000, 16000)
        assert y.shape[1] == 3 and len(y) == round(n / 3) and not y.any()


def test_resampled_clips_keep_channels_and_width(spark):
    clips = [(1, wav.encode(*_clip(2, 24))), (2, wav.encode(*_clip(1, 8, 8000))), (3, wav.encode(*_clip(3, 32, 16000, tag=wav.FLOAT))),
             (4, None), (5, b"RIFFxxxxWAVEjunk"), (6, wav.encode(np.zeros((0, 2)), wav.WavFormat(1, 2, 44100, 16)))]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b), "x") for k, b in clips], "k int, content binary, error string")
    got = {r.k: r for r in AU.resample_audio(df, on_error="keep").collect()}
    forms = {k: wav.decode(bytes(r.content))[1] for k, r in got.items() if r.content is not None}
    assert {k: (f.rate, f.channels, f.bits, f.tag) for k, f in forms.items()} == {
        1: (16000, 2, 24, 1), 2: (16000, 1, 8, 1), 3: (16000, 3, 32, 3), 6: (16000, 2, 16, 1)}
    assert bytes(got[3].content) == clips[2][1]  # at the rate: passed through
    assert got[4].error == "ValueError: no bytes" and got[5].error == "ValueError: no WAV file" and got[1].error is None
    assert sorted(r.k for r in AU.resample_audio(df, on_error="drop").collect()) == [1, 2, 3, 6]
    with pytest.raises(Exception, match="no bytes|no WAV file"):
        AU.resample_audio(df).collect()
    again = AU.resample_audio(AU.resample_audio(df, on_error="drop").select("k", "content")).collect()
    assert {r.k: bytes(r.content) for r in again} == {k: bytes(r.content) for k, r in got.items() if r.content is not None}


def test_decoding_keeps_bad_clips_apart_and_empty_ones_empty(spark):
    df = spark.createDataFrame([(1, bytearray(wav.encode(*_clip(2, 16, 16000)))), (2, None), (3, bytearray(b"x")),
                                (4, bytearray(wav.encode(np.zeros((0, 1)), wav.WavFormat(1, 1, 8000, 16))))], "k int, content binary")
    got = {r.k: r for r in AU.decode_samples(df, on_error="keep").collect()}
    assert got[1].n_samples == 8000 and got[1].error is None and got[4].samples == [] and got[4].n_samples == 0
    assert got[2].samples is None and got[3].error.startswith("ValueError")
    waves = {r.k: r for r in SQ.with_normalized_wave(AU.decode_samples(df, on_error="drop"), "samples").collect()}
    assert waves[4].input_values == [] and waves[4].input_length == 0 and abs(sum(waves[1].input_values)) < 1e-6


def test_manifest_reads_headers_only(tmp_path, monkeypatch):
    """However long the file, a few ranges of it are read."""
    x, form = _clip(1, 16, 16000, seconds=30)
    data = wav.encode(x, form)
    junk = b"JUNK" + (3_000_001).to_bytes(4, "little") + b"\0" * 3_000_002
    path = tmp_path / "a b+ẹ%20.wav"
    path.write_bytes(data[:12] + junk + data[12:36] + junk + data[36:])
    asked = []
    real = SA.ranged
    monkeypatch.setattr(SA, "ranged", lambda f: real(lambda at, n: (asked.append(n), f(at, n))[1]))
    found = SA.read_header(f"file:{path}", path.stat().st_size)
    assert found == (16000, 1, 16, 12 + 2 * len(junk) + 24 + 8, 480000, 30.0)
    assert sum(asked) <= 4 * SA.RANGE and path.stat().st_size > 6_000_000
    assert SA.walk_riff(path.read_bytes()) == found


def test_manifest_of_ranges_equals_that_of_contents(spark, folder):
    ranges, contents = (sorted(map(tuple, SA.audio_manifest(spark, folder, ranges=r).collect())) for r in (True, False))
    assert ranges == contents and len(ranges) == 3
    plan = SA.audio_manifest(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
