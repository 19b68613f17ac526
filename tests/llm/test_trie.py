import hashlib
import random
import re
import zlib

import pytest

from lectern.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, ord string, words string, node string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = convs.get(first, [])[:h] + own[h:]
    return out


def brute(rows):
    paths = rebuilt(rows)
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids.get(node, []))
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted(tuple(r) for r in trie.prefix_trie(trie.with_family_openings(trie.numbered_turns(df))).select(*COLUMNS).collect())


def dialogue(rng, texts, most):
    return [(t, "user" if t % 2 == 0 else "assistant", rng.choice(texts)) for t in range(rng.randint(0, most))]


ODD = [(0, 0, "user", "hi  there"), (0, 1, None, None), (0, None, "system", "first of all"), (1, 3, "user", "x y z"), (1, 3, "user", "x y z"),
       (2, 0, None, ""), (2, 1, "", ""), (7, 0, "user", None), (25, 0, "user", "no family head"), (26, 5, "a", "b\u00a0c d\u2003e"), (None, 0, "user", "no id"),
       (-3, 0, "user", "negative"), (-20, 0, "user", "negative head"), (-3, 1, "a", "q"), (40, 0, "u", "same"), (41, 0, "u", "same"), (42, 9, "u", "same"),
       (60, 0, "ab", "c"), (61, 0, "a", "bc"), (3, 0, "user", "word " * 30000)]


@pytest.mark.parametrize("rows", [ODD, [], [(None, 1, "user", "x")], [(1, None, None, None)]])
def test_odd_rows(spark, rows):
    assert nodes(frame(spark, rows)) == brute(rows)


def test_few_texts_over_small_chunks(spark, monkeypatch):
    """Deep sharing, equal conversations, chunk and block borders everywhere."""
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "BLOCK", 3)
    rng = random.Random(5)
    rows = [(c, *turn) for c in range(300) for turn in dialogue(rng, ["a b", "c", ""], 11)]
    # a chain of 40 turns that several share to different depths
    rows += [(c, t, "user", f"t{t}") for c in range(400, 420) for t in range(40 - c % 7)]
    assert nodes(frame(spark, rows).repartition(5)) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(6)
    rows = [(500, t, "user", f"turn {t}") for t in range(3000)] + [(501, t, "user", f"turn {t}") for t in range(2000)]
    rows += [(c, *turn) for c in range(200) for turn in dialogue(rng, ["a", "b c"], 6)]
    # both are rebuilt on conversation 500
    assert nodes(frame(spark, rows).repartition(6)) == brute(rows)


def test_one_first_turn_and_one_conversation_for_a_third(spark):
    rows = [(c, t, "user", f"same {t}" if c % 3 == 0 else ("same 0" if t == 0 else f"{c} {t}")) for c in range(3000) for t in range(4)]
    assert nodes(frame(spark, rows).repartition(9)) == brute(rows)


def test_query_is_whole(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    got = queries.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows)
    assert set(got.columns) == set(COLUMNS)
