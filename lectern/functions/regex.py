"""Character classes shared by the Spark expressions and the SQL oracles.

Python's ``str.split()``, ``str.strip()`` and ``re``'s ``\\s`` treat every
character with ``str.isspace()`` as whitespace; Java's and RE2's ``\\s`` only
know ASCII.  The class is therefore derived from Python itself and spelled
with ``\\x{...}`` escapes, which Java regexes and RE2 both accept.
"""

from __future__ import annotations

import sys


def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in codepoints:
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _class_body(codepoints: list[int]) -> str:
    parts = []
    for lo, hi in _ranges(codepoints):
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


PY_SPACE_CODEPOINTS = [cp for cp in range(sys.maxunicode + 1) if chr(cp).isspace()]
#: regex character class matching exactly the characters Python calls whitespace
WS = "[" + _class_body(PY_SPACE_CODEPOINTS) + "]"


def escape_class_chars(chars: str) -> str:
    """Escape every character for use inside ``[...]`` (Java and RE2)."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)
