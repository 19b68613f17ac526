"""Text scalar functions.

All run in the JVM: built-in Spark expressions, and for NFKC the ICU library
that Spark brings along for its collations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WS, escape_class_chars

# Fixed values that must equal the reference's behaviour.
# Curly punctuation folded before tokenisation: “ ” ’ ‘ – become " " ' ' -
PUNCT_FROM = "“”’‘–"
PUNCT_TO = "\"\"''-"
# Transcript sentinel that is never scored.
IGNORE_SEGMENT = "ignore time segment in scoring"
# Characters the speech fine-tuning script strips from targets, in its order:
# , ? . ! - ; : " “ % ‘ ” �
CHARS_TO_IGNORE = [",", "?", ".", "!", "-", ";", ":", "\"", "“", "%", "‘", "”", "�"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_punct(c) -> Column:
    """Map curly quotes and the en dash to their ASCII forms."""
    return F.translate(_col(c), PUNCT_FROM, PUNCT_TO)


def unicode_trim(c) -> Column:
    """T4: Python ``str.strip()`` (all Unicode whitespace, not just spaces)."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def unicode_rtrim(c) -> Column:
    return F.regexp_replace(_col(c), f"{WS}+$", "")


def is_scorable(c) -> Column:
    """F1 predicate: stripped raw text is neither empty nor the sentinel."""
    s = unicode_trim(c)
    return (s != F.lit("")) & (s != F.lit(IGNORE_SEGMENT))


def ignore_class(chars=None, range_compat: bool = False) -> str:
    """Regex class for T2.

    ``range_compat=True`` joins the characters unescaped, exactly as the
    reference's script does, so ``!-;`` becomes a range (quirk Q1).
    """
    chars = CHARS_TO_IGNORE if chars is None else list(chars)
    if not chars:
        return "(?!)"  # an empty list deletes nothing
    if range_compat:
        return "[" + "".join(chars) + "]"
    return "[" + escape_class_chars("".join(chars)) + "]"


def clean_target(c, chars=None, range_compat: bool = False) -> Column:
    """Delete ignored characters, lower-case, append one space."""
    cls = ignore_class(chars, range_compat)
    return F.concat(F.lower(F.regexp_replace(_col(c), cls, "")), F.lit(" "))


def add_prompt(c, prompt: str) -> Column:
    """``f"{prompt}: " + x``; null in gives null out (quirk Q4 kept)."""
    return F.concat(F.lit(prompt + ": "), _col(c))


def char_spaced(c) -> Column:
    """``" ".join(text)`` - one space between every code point."""
    return F.array_join(F.filter(F.split(_col(c), ""), lambda x: x != F.lit("")), " ")


def nfkc(c, raw=None) -> Column:
    """Unicode NFKC of ``c``, null where ``raw`` (``c`` itself or what it was made of)
    is null.  ``c`` is referred to once, so a long chain behind it runs once."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(_col(c), F.lit("")), F.lit(True))
    return F.when(_col(c if raw is None else raw).isNotNull(), composed)


def basic_normalize(c, keep_marks: bool = False) -> Column:
    """The basic (language-independent) transcript normaliser.

    lower; drop ``<...>``/``[...]`` spans; drop ``(...)`` spans; NFKC; every
    mark, symbol and punctuation character becomes a space; lower again;
    whitespace runs become one space.  No strip.  ``keep_marks`` leaves
    combining marks in place (quirk Q2 divergence, off by default).
    """
    s = F.lower(_col(c))
    s = F.regexp_replace(s, r"[<\[][^>\]]*[>\]]", "")
    s = F.regexp_replace(s, r"\(([^)]+?)\)", "")
    s = nfkc(s, raw=c)
    cls = r"[\p{S}\p{P}]" if keep_marks else r"[\p{M}\p{S}\p{P}]"
    s = F.regexp_replace(s, cls, " ")
    s = F.lower(s)
    return F.regexp_replace(s, f"{WS}+", " ")
