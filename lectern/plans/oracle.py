"""DuckDB SQL fragments for the correctness oracle in ``__spark_entry__``.

These mirror the Spark expressions' *semantics* with DuckDB built-ins so the
driver can compare both engines on the same parquet tables.  DuckDB's
``levenshtein`` counts bytes, so edit distances map each distinct token of a
pair to one ASCII byte when a pair has at most 127 distinct tokens and fall
back to an exact dynamic programme over lists otherwise.
"""

from __future__ import annotations

from ..functions.regex import WS

WSR = WS  # RE2 accepts the same \x{...} class


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WSR + '+|' + WSR + '+$')}, '', 'g')"


def collapse_strip(x: str) -> str:
    return trim(f"regexp_replace({x}, {q(WSR + WSR + '+')}, ' ', 'g')")


def wer_words(x: str) -> str:
    return f"list_filter(string_split({collapse_strip(x)}, ' '), lambda t: t <> '')"


def chars(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda t: t <> '')"


def normalize(x: str) -> str:
    """Basic normaliser; NFC stands in for NFKC (equal on the driver tables)."""
    s = f"lower({x})"
    s = f"regexp_replace({s}, {q(r'[<\[][^>\]]*[>\]]')}, '', 'g')"
    s = f"regexp_replace({s}, {q(r'\(([^)]+?)\)')}, '', 'g')"
    s = f"nfc_normalize({s})"
    s = f"regexp_replace({s}, {q(r'[\p{M}\p{S}\p{P}]')}, ' ', 'g')"
    s = f"lower({s})"
    return f"regexp_replace({s}, {q(WSR + '+')}, ' ', 'g')"


def distinct_tokens(r: str, h: str) -> str:
    return f"list_distinct(list_concat({r}, {h}))"


def edit_distance(r: str, h: str, d: str) -> str:
    """Exact Levenshtein distance of token lists ``r`` and ``h``; ``d`` is a
    column holding :func:`distinct_tokens` of the two (computed beforehand:
    DuckDB would re-evaluate it per element inside the lambda)."""
    enc = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(list_position({d}, t)::INTEGER)), '')"
    dp = (f"list_reduce({h}, lambda prev, w: list_reduce(range(1, len({r}) + 1), "
          f"lambda cur, j: list_append(cur, least(prev[j + 1] + 1, cur[j] + 1, "
          f"prev[j] + CASE WHEN {r}[j] = w THEN 0 ELSE 1 END)), [prev[1] + 1]), "
          f"range(0, len({r}) + 1))[len({r}) + 1]")
    return (f"(CASE WHEN len({d}) <= 127 THEN levenshtein({enc(r)}, {enc(h)}) "
            f"ELSE {dp} END)")


def rate(err: str, n: str, digits: int = 2) -> str:
    return f"CASE WHEN sum({n}) > 0 THEN round_even(100.0 * sum({err}) / sum({n}), {digits}) END"


CONVERSATION_PAIRS = """
SELECT u.conv_id, u.turn, u.text AS ref, a.text AS hyp
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn
WHERE u.role = 'user' AND a.role = 'assistant'
"""


# ---------------------------------------------------------------------------
# BLEU / chrF
TOK13A_SQL = [
    (r"([{-~\[-` -&(-+:-@/])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def tokenize_13a(x: str) -> str:
    s = f"regexp_replace({x}, {q(WSR + '+$')}, '', 'g')"
    for a, b in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'),
                 ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        s = f"replace({s}, {q(a)}, {q(b)})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in TOK13A_SQL:
        s = f"regexp_replace({s}, {q(pat)}, {q(rep)}, 'g')"
    return f"list_filter(regexp_split_to_array({s}, {q(WSR + '+')}), lambda t: t <> '')"


def chrf_chars(x: str) -> str:
    return chars(f"regexp_replace({x}, {q(WSR + '+')}, '', 'g')")


def ngram_stats_sql(src: str, key: list[str], units_h: str, units_r: str, order: int,
                    sep: str, chrf: bool, prefix: str, long: bool = False) -> str:
    """SQL producing ``key, {prefix}hyp_len, {prefix}ref_len, {prefix}h1.., r.., m..``
    from relation ``src`` whose ``units_h``/``units_r`` are token lists.  ``long``:
    units become rows and n-grams are put together by ``lead``, which whole
    documents need (a list slice for each n-gram takes tens of minutes there)."""
    k = ", ".join(key)
    on = " AND ".join(f"a.{c} = b.{c}" for c in key)
    grams = lambda side: (
        f"SELECT {k}, n, unnest(list_transform(range(1, len({side}) - n + 2), "
        f"lambda i: array_to_string({side}[i:i + n - 1], {q(sep)}))) AS gram "
        f"FROM u, range(1, {order + 1}) r(n)")
    msum = ", ".join(f"sum(CASE WHEN n = {n} THEN m END) AS m{n}" for n in range(1, order + 1))
    cols = []
    for n in range(1, order + 1):
        r = f"greatest(len(ur) - {n} + 1, 0)"
        h = f"greatest(len(uh) - {n} + 1, 0)"
        if chrf:
            h = f"CASE WHEN {r} > 0 THEN {h} ELSE 0 END"
        cols += [f"{h}::BIGINT AS {prefix}h{n}", f"{r}::BIGINT AS {prefix}r{n}",
                 f"coalesce(ms.m{n}, 0)::BIGINT AS {prefix}m{n}"]
    on2 = " AND ".join(f"u.{c} = ms.{c}" for c in key)
    if long:
        leads = ", ".join(f"lead(x, {j}) OVER w AS x{j}" for j in range(1, order))
        gram = lambda n: f" || {q(sep)} || ".join(["x", *[f"x{j}" for j in range(1, n)]])
        whole = lambda n: f"WHERE x{n - 1} IS NOT NULL" if n > 1 else ""
        counted = " UNION ALL ".join(
            f"SELECT {k}, {n} AS n, least(count(*) FILTER (s = 0), count(*) FILTER (s = 1)) AS m FROM g {whole(n)} GROUP BY {k}, {gram(n)}"
            for n in range(1, order + 1))
        return f"""(
WITH u AS (SELECT {k}, {units_h} AS uh, {units_r} AS ur FROM {src}),
x AS (SELECT {k}, 0 AS s, unnest(uh) AS x, generate_subscripts(uh, 1) AS i FROM u
      UNION ALL SELECT {k}, 1, unnest(ur), generate_subscripts(ur, 1) FROM u),
g AS (SELECT {k}, s, x, {leads} FROM x WINDOW w AS (PARTITION BY {k}, s ORDER BY i)),
mm AS (SELECT {k}, n, sum(m) AS m FROM ({counted}) GROUP BY ALL),
ms AS (SELECT {k}, {msum} FROM mm GROUP BY ALL)
SELECT {', '.join('u.' + c for c in key)}, len(uh)::BIGINT AS {prefix}hyp_len,
       len(ur)::BIGINT AS {prefix}ref_len, {', '.join(cols)}
FROM u LEFT JOIN ms ON {on2})"""
    return f"""(
WITH u AS (SELECT {k}, {units_h} AS uh, {units_r} AS ur FROM {src}),
hg AS ({grams('uh')}),
rg AS ({grams('ur')}),
hc AS (SELECT {k}, n, gram, count(*) AS c FROM hg GROUP BY ALL),
rc AS (SELECT {k}, n, gram, count(*) AS c FROM rg GROUP BY ALL),
mm AS (SELECT {', '.join('a.' + c for c in key)}, a.n, sum(least(a.c, b.c)) AS m
       FROM hc a JOIN rc b ON {on} AND a.n = b.n AND a.gram = b.gram GROUP BY ALL),
ms AS (SELECT {k}, {msum} FROM mm GROUP BY ALL)
SELECT {', '.join('u.' + c for c in key)}, len(uh)::BIGINT AS {prefix}hyp_len,
       len(ur)::BIGINT AS {prefix}ref_len, {', '.join(cols)}
FROM u LEFT JOIN ms ON {on2})"""


def bleu_sql(hl: str, rl: str, h: list[str], m: list[str], digits: int | None = 4) -> str:
    zeros, logs = [], []
    for n in range(len(h)):
        zeros.append(f"(CASE WHEN {m[n]} = 0 THEN 1 ELSE 0 END)")
        z = " + ".join(zeros)
        p = (f"(CASE WHEN {m[n]} = 0 THEN 100.0::DOUBLE / (pow(2.0, {z}) * {h[n]}::DOUBLE) "
             f"ELSE 100.0::DOUBLE * {m[n]}::DOUBLE / {h[n]}::DOUBLE END)")
        logs.append(f"ln({p})")
    bp = (f"(CASE WHEN {hl} < {rl} THEN (CASE WHEN {hl} > 0 THEN exp(1.0::DOUBLE - {rl}::DOUBLE / {hl}::DOUBLE) "
          f"ELSE 0.0::DOUBLE END) ELSE 1.0::DOUBLE END)")
    allz = " AND ".join(f"{x} = 0" for x in m)
    s = (f"(CASE WHEN {allz} THEN 0.0::DOUBLE WHEN {h[-1]} = 0 THEN 0.0::DOUBLE "
         f"ELSE {bp} * exp(({' + '.join(logs)}) / {float(len(h))}) END)")
    return f"round_even({s}, {digits})" if digits is not None else s


def chrf_sql(h: list[str], r: list[str], m: list[str], digits: int | None = 4) -> str:
    both = [f"({hn} > 0 AND {rn} > 0)" for hn, rn in zip(h, r)]
    prec = " + ".join(f"(CASE WHEN {b} THEN {mn}::DOUBLE / {hn}::DOUBLE ELSE 0.0 END)"
                      for b, hn, mn in zip(both, h, m))
    rec = " + ".join(f"(CASE WHEN {b} THEN {mn}::DOUBLE / {rn}::DOUBLE ELSE 0.0 END)"
                     for b, rn, mn in zip(both, r, m))
    eff = " + ".join(f"(CASE WHEN {b} THEN 1 ELSE 0 END)" for b in both)
    P = f"(CASE WHEN ({eff}) > 0 THEN ({prec}) / ({eff})::DOUBLE ELSE 0.0 END)"
    R = f"(CASE WHEN ({eff}) > 0 THEN ({rec}) / ({eff})::DOUBLE ELSE 0.0 END)"
    s = f"(CASE WHEN {P} + {R} > 0 THEN 100.0 * ((5.0 * {P} * {R}) / (4.0 * {P} + {R})) ELSE 0.0 END)"
    return f"round_even({s}, {digits})" if digits is not None else s


def pair_stats_sql(pairs_sql: str, key: list[str], long: bool = False) -> str:
    """BLEU (b_*) and chrF (c_*) statistics per pair of ``pairs_sql``."""
    k = ", ".join(key)
    b = ngram_stats_sql("pp", key, tokenize_13a("hyp"), tokenize_13a("ref"), 4, " ", False, "b_", long)
    c = ngram_stats_sql("pp", key, chrf_chars("hyp"), chrf_chars("ref"), 6, "", True, "c_", long)
    return f"""(WITH pp AS ({pairs_sql}),
bs AS {b},
cs AS {c}
SELECT * FROM bs JOIN cs USING ({k}))"""


def agg_names(prefix: str, kind: str, order: int, agg: bool) -> list[str]:
    return [f"sum({prefix}{kind}{n})" if agg else f"{prefix}{kind}{n}" for n in range(1, order + 1)]


def sentence_bleu_sql(digits=4, agg=False) -> str:
    w = (lambda c: f"sum({c})") if agg else (lambda c: c)
    return bleu_sql(w("b_hyp_len"), w("b_ref_len"), agg_names("b_", "h", 4, agg),
                    agg_names("b_", "m", 4, agg), digits)


def sentence_chrf_sql(digits=4, agg=False) -> str:
    return chrf_sql(agg_names("c_", "h", 6, agg), agg_names("c_", "r", 6, agg),
                    agg_names("c_", "m", 6, agg), digits)
