"""Plain-Python reference implementations used as test oracles.

Written from the published algorithms (edit distance DP, n-gram counting,
the basic transcript normaliser, the 13a tokeniser); no Spark involved.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter


def lev(a, b) -> int:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def wer_words(s: str) -> list[str]:
    s = re.sub(r"\s\s+", " ", s).strip()
    return [w for w in s.split(" ") if w]


def cer_text(s: str) -> str:
    return re.sub(r"\s\s+", " ", s).strip()


def normalize(s: str) -> str:
    s = s.lower()
    s = re.sub(r"[<\[][^>\]]*[>\]]", "", s)
    s = re.sub(r"\(([^)]+?)\)", "", s)
    s = "".join(" " if unicodedata.category(c)[0] in "MSP" else c
                for c in unicodedata.normalize("NFKC", s))
    s = s.lower()
    return re.sub(r"\s+", " ", s)


def tok13a(line: str) -> list[str]:
    line = line.rstrip()
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = (line.replace("&quot;", '"').replace("&amp;", "&")
                .replace("&lt;", "<").replace("&gt;", ">"))
    line = f" {line} "
    for pat, rep in [(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                     (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]:
        line = re.sub(pat, rep, line)
    return line.split()


def _grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def bleu_stats(hyp: str, ref: str):
    ht, rt = tok13a(hyp), tok13a(ref)
    m, tot = [], []
    for n in range(1, 5):
        hc, rc = _grams(ht, n), _grams(rt, n)
        m.append(sum(min(c, rc.get(g, 0)) for g, c in hc.items()))
        tot.append(sum(hc.values()))
    return len(ht), len(rt), m, tot


def bleu_score(hl, rl, m, tot) -> float:
    bp = (math.exp(1 - rl / hl) if hl > 0 else 0.0) if hl < rl else 1.0
    if not any(m):
        return 0.0
    prec = [0.0] * 4
    k = 1.0
    for n in range(1, 5):
        if tot[n - 1] == 0:
            break
        if m[n - 1] == 0:
            k *= 2
            prec[n - 1] = 100.0 / (k * tot[n - 1])
        else:
            prec[n - 1] = 100.0 * m[n - 1] / tot[n - 1]
    return bp * math.exp(sum(-9999999999 if p == 0 else math.log(p) for p in prec) / 4)


def chrf_stats(hyp: str, ref: str):
    h, r = "".join(hyp.split()), "".join(ref.split())
    out = []
    for n in range(1, 7):
        hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
        rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
        rn = sum(rc.values())
        out.append((sum(hc.values()) if rn > 0 else 0, rn,
                    sum(min(c, rc[g]) for g, c in hc.items() if g in rc)))
    return out


def chrf_score(stats) -> float:
    ap = ar = 0.0
    eff = 0
    for nh, nr, nm in stats:
        if nh > 0 and nr > 0:
            ap += nm / nh
            ar += nm / nr
            eff += 1
    if eff:
        ap /= eff
        ar /= eff
    else:
        ap = ar = 0.0
    return 100 * (5 * ap * ar / (4 * ap + ar)) if ap + ar else 0.0
