import re

import pytest
from helpers import TEXTS, docs, table_rows

from lectern.llm import licenses, queries

RULES = [(r, re.compile(r["regex"])) for r in licenses.rules()]
NOTICES = [
    (100, "This work is licensed under the GNU General Public License, version 3, or later."),
    (101, "CC BY cc-by CC BY-NC-SA 4.0 cc by. all rights reserved all RIGHTS, reserved"),
    (102, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License. Copyright (c) 2020 by x"),
    (103, "SPDX-License-Identifier: BSD-3-Clause; see the license. Mozilla Public License 2.0"),
    (104, "Ünïcode license ccby c c by general-public\u00a0license general public license"),
    (105, "licensed under the terms of the mit license " * 300),
]


def brute(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+".decode("latin-1"), re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = " " + " ".join(words) + " " if words else " "
    base = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split())
    found = []
    for rule, regex in RULES:
        if rule["keyword"] in words:
            for m in regex.finditer(norm):
                start = norm.count(" ", 0, m.start())
                found.append((start, start + m[0].count(" "), rule["tier"], rule["id"], rule["label"], rule["score"]))

    def held(d):
        return any(o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and o != d and
                   ((o[0], o[1]) != (d[0], d[1]) or (o[2], o[3]) < (d[2], d[3])) for o in found)

    return len(words), base, sorted(d for d in found if not held(d))


def check(df, rows):
    got = sorted(((r["id"], r["n_words"], [(d["start"], d["label"]) for d in r["base"]], sorted(tuple(d) for d in r["kept"]))
                  for r in licenses.scan(df).collect()), key=str)
    want = sorted(((i, n, b, k) for i, t in rows for n, b, k in [brute(t)]), key=str)
    for g, w in zip(got, want):
        assert (g[0], g[1], sorted(g[2]), g[3]) == (w[0], w[1], w[2], w[3])
    assert len(got) == len(want)


@pytest.mark.parametrize("rows", [[(i, t[:5000] if t else t) for i, t in TEXTS] + NOTICES, []])
def test_odd_rows(spark, rows):
    check(docs(spark, rows), rows)


def test_whole_table(spark):
    check(*table_rows(spark, "sf0.01"))


def shortest(parsed):
    """The texts that a pattern matches with every repetition as short as it can be."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            new = [chr(arg)]
        elif name == "BRANCH":
            new = [x for part in arg[1] for x in shortest(part)]
        elif name == "SUBPATTERN":
            new = shortest(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            new = [x * arg[0] for x in shortest(arg[2])] if arg[0] else [""]
        elif name == "IN":
            new = ["0" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1])]
        else:
            assert name == "ANY", name
            new = ["x"]
        out = [x + y for x in out for y in new]
    return out


def test_rules_need_their_keyword():
    import re._parser as parser

    rules = licenses.rules()
    assert len(rules) > 400
    for rule in rules:
        for text in shortest(parser.parse(rule["pattern"])):
            assert rule["keyword"] in text.split(), (rule, text)


def test_labels_of_the_query(spark, tmp_path):
    docs(spark, NOTICES).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op3_licenses(spark, str(tmp_path)).collect()}
    assert got[100]["base_labels"] == "gpl" and got[100]["labels"] == "gpl" and got[100]["first_word"] == 7
    assert got[101]["n_base"] == 6 and (got[101]["first_word"], got[101]["base_labels"]) == (0, "cc-by,reserved")
    assert "cc-by-nc-sa" in got[101]["labels"] and "mit" in got[102]["labels"] and "bsd-3-clause" in got[103]["labels"]
    assert got[104]["n_base"] == 1 and 0 <= got[104]["score"] <= 1


def test_no_python_in_the_plan(spark):
    df, _ = table_rows(spark)
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


DECLARED = [
    ("License: MIT", "mit"), ("License: Apache-2.0", "apache"), ("It is MIT-licensed.", "mit"), ("GPLv3", "gpl"), ("GNU LGPLv2.1+", "lgpl"),
    ("the licence is BSD-3-Clause", "bsd-3-clause"), ("Copyright © 2020 x", "copyright"), ("Copyright ©2020 x", "copyright"), ("© 2019", "copyright"),
    ("Neither the name of " + "a very long holder's name " * 9 + "nor the names of its contributors may be used to endorse or promote", "bsd-3-clause"),
    ("THIS FONT SOFTWARE is licensed under the SIL Open Font License", "ofl"), ("Apache2", "apache"),
]


def test_declarations_in_their_common_forms(spark):
    rows = [(k, t) for k, (t, _) in enumerate(DECLARED)] + [(99, "the mit gpl bsd of a license to be read")]
    check(docs(spark, rows), rows)
    got = {k: {d[4] for d in brute(t)[2]} for k, t in rows}
    for k, (text, label) in enumerate(DECLARED):
        assert label in got[k], (text, got[k])
    assert not got[99]


def test_wordings_are_found_by_their_own_rule(spark):
    import re._parser as parser

    own = {(label, p): r["id"] for r, _ in RULES for label, _, _, _, p in licenses.WORDINGS if (r["label"], r["pattern"]) == (label, p)}
    assert len(own) == len(licenses.WORDINGS)
    rows, want = [], []
    for label, _, _, _, pattern in licenses.WORDINGS:
        for text in shortest(parser.parse(pattern)):
            rows.append((len(rows), f"before it, {text.capitalize()}; behind it"))
            want.append((own[label, pattern], label))
    check(docs(spark, rows), rows)
    for (_, text), (rule, label) in zip(rows, want):
        assert (rule, label) in {(d[3], d[4]) for d in brute(text)[2]}, (text, label)
        rest = [regex for r, regex in RULES if r["id"] != rule and r["tier"] == 0]
        assert not any(regex.search(" " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " ") for regex in rest), text
