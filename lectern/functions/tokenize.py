"""Tokenisers as array-valued Spark expressions.

* :func:`wer_words` / :func:`cer_text` - the default transforms of the WER/CER
  metrics: whitespace runs of two or more collapse to one space, then strip;
  words are split on the single space only (a lone tab does not split).
* :func:`tokenize_13a` - the standard ``13a`` BLEU tokeniser.
* :func:`chrf_chars` - characters with all whitespace removed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WS
from .text import _col, unicode_rtrim, unicode_trim

# Fixed values of the 13a tokeniser (applied in this order, left to right).
# 1. pad every ASCII symbol in { to ~, [ to `, space to &, ( to +, : to @, and /
# 2. split period/comma unless preceded by a digit
# 3. split period/comma unless followed by a digit
# 4. split a dash preceded by a digit
TOK13A_RULES = [
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
# Entity unescapes, in order; only these four.
TOK13A_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def split_ws(c) -> Column:
    """Python ``str.split()``: split on whitespace runs, drop empties."""
    return F.filter(F.split(_col(c), f"{WS}+"), lambda x: x != F.lit(""))


def collapse_strip(c) -> Column:
    """Two-or-more whitespace characters become one space, then strip."""
    return unicode_trim(F.regexp_replace(_col(c), f"{WS}{WS}+", " "))


def wer_words(c) -> Column:
    return F.filter(F.split(collapse_strip(c), " "), lambda x: x != F.lit(""))


def cer_text(c) -> Column:
    return collapse_strip(c)


def chars(c) -> Column:
    """Code points of a string (``split(s, '')`` yields one empty element for
    the empty string; it is removed)."""
    return F.filter(F.split(_col(c), ""), lambda x: x != F.lit(""))


def tokenize_13a_string(c) -> Column:
    s = unicode_rtrim(c)
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for src, dst in TOK13A_ENTITIES:
        s = F.replace(s, F.lit(src), F.lit(dst))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pattern, repl in TOK13A_RULES:
        s = F.regexp_replace(s, pattern, repl)
    return s


def tokenize_13a(c) -> Column:
    """T5: BLEU tokens of a segment (after the segment's trailing strip)."""
    return split_ws(tokenize_13a_string(c))


def chrf_string(c) -> Column:
    """The segment with every whitespace character removed."""
    return F.regexp_replace(_col(c), f"{WS}+", "")
