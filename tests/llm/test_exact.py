import hashlib
import re

import pytest
from helpers import TEXTS, docs, table_rows

from lectern.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(rb"[\x20\x09-\x0d]+", b" ", (t or "").encode()), []).append(i)
    return sorted(((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(n).hexdigest())
                   for n, ids in groups.items() for i in ids), key=str), len(groups)


def check(df, rows, **options):
    want, groups = brute(rows)
    got = exact.equal_groups(df, **options).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("rows", [TEXTS, [], [(None, None), (None, "")]])
def test_odd_rows(spark, rows):
    check(docs(spark, rows), rows)


def test_whole_table(spark):
    check(*table_rows(spark))


def test_group_over_many_partitions(spark):
    rows = [(k, "one text" if k % 3 else f"text {k % 50}") for k in range(2000)]
    check(docs(spark, rows), rows, partitions=9)
    one = [(k, "same") for k in range(500)]
    check(docs(spark, one), one, partitions=9)
