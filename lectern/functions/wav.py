"""WAV files byte by byte: chunks, samples and rate conversion of one clip.

Helpers for the tasks of :mod:`lectern.sources.audio` and
:mod:`lectern.operators.audio`; Spark deals the clips.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np

#: Fixed values of the format: integer samples, float samples, and the tag that
#: sends the reader to the sub-format behind it.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the sinc on each side, and the window that ends it.
CROSSINGS, KAISER = 24, 9.0
#: The part of the band below the lower of both limits that stays whole.
PASS = 0.92


@dataclass(frozen=True)
class WavFormat:
    tag: int
    channels: int
    rate: int
    bits: int

    @property
    def frame(self) -> int:
        return self.channels * (self.bits // 8)


def walk(read: Callable[[int, int], bytes], length: int) -> tuple[WavFormat, int, int] | None:
    """Format, offset and size in bytes of the samples of a WAV file of ``length``
    bytes, found chunk by chunk; None if it isn't one or has no ``fmt `` or
    ``data``.  ``read(at, n)`` is asked for the chunks' headers only."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= length:
        top = read(at, 8)
        tag, size = top[:4], int.from_bytes(top[4:8], "little")
        if tag == b"fmt " and at + 24 <= length:
            body = read(at + 8, min(size, 26))
            kind, channels, rate, bits = (int.from_bytes(body[o:o + n], "little") for o, n in ((0, 2), (2, 2), (4, 4), (14, 2)))
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = int.from_bytes(body[24:26], "little")
            form = WavFormat(kind, channels, rate, bits)
        elif tag == b"data" and form:
            return form, at + 8, min(size, length - at - 8)  # streams leave the size open
        at += 8 + size + size % 2
    return None


def decode(data: bytes) -> tuple[np.ndarray, WavFormat]:
    """Samples as (frames, channels) in [-1, 1) and the format.  Bytes that are no
    WAV file, or samples of another kind than integers of 8 to 32 and floats of
    32 or 64 bits, are a ValueError."""
    found = walk(lambda at, n: data[at:at + n], len(data))
    if found is None:
        raise ValueError("no WAV file")
    form, at, size = found
    if not form.channels or not form.rate or form.bits not in {PCM: (8, 16, 24, 32), FLOAT: (32, 64)}.get(form.tag, ()):
        raise ValueError(f"unsupported WAV format {form}")
    raw = data[at:at + size // form.frame * form.frame]
    if form.tag == FLOAT:
        x = np.frombuffer(raw, f"<f{form.bits // 8}").astype(np.float64)
    elif form.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif form.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        whole = np.zeros((len(b), 4), np.uint8)
        whole[:, 1:] = b
        x = (whole.view("<i4")[:, 0] >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{form.bits // 8}") / float(1 << (form.bits - 1))
    return x.reshape(-1, form.channels), form


def encode(x: np.ndarray, form: WavFormat) -> bytes:
    """A WAV file of the samples (frames, channels) in ``form``."""
    if form.tag == FLOAT:
        raw = x.astype(f"<f{form.bits // 8}").tobytes()
    else:
        top = 1 << (form.bits - 1)
        v = np.clip(np.round(x * top), -top, top - 1).astype("<i4")
        if form.bits == 8:
            raw = (v + 128).astype(np.uint8).tobytes()
        elif form.bits == 24:
            raw = v.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
        else:
            raw = v.astype(f"<i{form.bits // 8}").tobytes()
    head = b"".join(n.to_bytes(w, "little") for n, w in (
        (form.tag, 2), (form.channels, 2), (form.rate, 4), (form.rate * form.frame, 4), (form.frame, 2), (form.bits, 2)))
    pad = b"\0" * (len(raw) % 2)
    body = b"WAVEfmt " + (16).to_bytes(4, "little") + head + b"data" + len(raw).to_bytes(4, "little") + raw + pad
    return b"RIFF" + len(body).to_bytes(4, "little") + body


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """Filter taps (phase, tap) of a conversion by up / down: a Kaiser-windowed
    sinc that ends below half of the lower rate."""
    band = PASS * min(1.0, up / down)
    reach = int(np.ceil(CROSSINGS / band))
    at = np.arange(-reach + 1, reach + 1) - np.arange(up)[:, None] / up  # in input samples
    window = np.i0(KAISER * np.sqrt(np.clip(1 - (at / reach) ** 2, 0, None)))
    taps = np.sinc(band * at) * window
    return taps / taps.sum(1, keepdims=True)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples (frames, channels) at another rate, band-limited: output n stands
    at input n * rate / target, and what lies above the new limit is filtered
    out.  Silence is taken before and after the clip."""
    if rate == target or not len(x):
        return x
    g = gcd(rate, target)
    up, down = target // g, rate // g
    taps = _phases(up, down)
    reach = taps.shape[1] // 2
    padded = np.pad(x, ((reach - 1, reach), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach, axis=0)  # (frames, channels, taps)
    n = int(round(len(x) * up / down))
    out = np.empty((n, x.shape[1]))
    for lo in range(0, n, 1 << 14):
        place = np.arange(lo, min(lo + (1 << 14), n)) * down
        out[lo:lo + len(place)] = np.einsum("nct,nt->nc", windows[np.minimum(place // up, len(x) - 1)], taps[place % up])
    return out
