"""Deterministic stand-in models for the inference operators.

They let the batching, error handling and scoring paths run end to end on the
driver tables without weights, GPUs or network access.  Real models are
injected the same way (a zero-argument factory returning ``f(list) -> list``).
"""

from __future__ import annotations


def reverse_words_model():
    """'Translation' stub: words in reverse order; empty input is an error."""
    def f(texts):
        out = []
        for t in texts:
            if t is None or t == "":
                raise ValueError("empty input")
            out.append(" ".join(reversed(t.split(" "))))
        return out
    return f


def length_ratio_model():
    """Quality-score stub over ``(src, mt, ref)``: shorter / longer length of
    hypothesis and reference (1.0 when both are empty)."""
    def f(rows):
        out = []
        for _src, mt, ref in rows:
            a, b = len(mt or ""), len(ref or "")
            out.append(1.0 if max(a, b) == 0 else min(a, b) / max(a, b))
        return out
    return f


def clip_length_asr_model(long_text: str = "hello world", short_text: str = "x",
                          min_samples: int = 10000):
    """ASR stub over ``(samples, rate)`` rows: a fixed text chosen by clip length."""
    def f(rows):
        return [long_text if len(s) > min_samples else short_text for s, _r in rows]
    return f
