import random

import numpy as np
import pytest
import xxhash
from helpers import TEXTS, components, docs, table_rows

from lectern.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = components(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[label[f]] = min(low.get(label[f], i), i)
    return sorted(((i, f, low.get(label[f])) for (i, _), f in zip(rows, fps)), key=str)


def got(df, **options):
    return sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_groups(df, **options).collect()), key=str)


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_odd_rows(spark, rows):
    assert got(docs(spark, rows)) == brute_groups(rows)


def test_whole_table(spark):
    df, rows = table_rows(spark)
    assert got(df) == brute_groups(rows)


def test_one_row_of_each_group_is_kept(spark):
    one_each = [r for r in TEXTS if r[0] not in (None, 12)]  # ids that name one component
    rows = simhash.near_groups(docs(spark, one_each)).collect()
    kept = {(r["component"], r["raw"]) for r in rows if r["kept"]}
    assert len(kept) == len({c for c, _ in kept}) == len({r["component"] for r in rows})
    assert all(r["id"] == r["component"] for r in rows if r["kept"])


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for free in ((1 << 64) - 1, rng.getrandbits(64), (1 << 20) - 1):
        masks = simhash.covering_masks(free)
        places = [i for i in range(64) if free >> i & 1]
        for _ in range(3000):
            diff = sum(1 << i for i in rng.sample(places, 3))
            assert any(not m & diff for m in masks)


@pytest.mark.parametrize("large", [2, 512])
def test_links_of_dense_and_large_buckets(spark, large):
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
    label = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, large=large).collect()]
    assert all((a ^ b).bit_count() <= 9 for a, b in edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen = {}
    for f in sorted(fps):
        todo = [f] if f not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = f
                todo += near.get(x, [])
    assert seen == label


def test_forest_names_the_smallest_of_each_part():
    a, b = simhash._forest(np.asarray([0, 1, 3, 1 << 40, 7 << 50], np.int64), 3)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 3), (0, 1 << 40), (0, 7 << 50)]
