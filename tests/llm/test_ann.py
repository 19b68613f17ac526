import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, shard int, vector string"


def brute(ids, vecs, asks, k):
    x = np.asarray(vecs, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in asks:
        s = x @ x[ids.index(a)]
        out[a] = sorted(((-s[j], i) for j, i in enumerate(ids) if i != a))[:k]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for a, best in want.items():
        rows = sorted(got.get(a, []))
        assert [x[0] for x in rows] == list(range(1, len(best) + 1))
        assert all(p[2] > q[2] or p[2] == q[2] and p[1] < q[1] for p, q in zip(rows, rows[1:]))
        hits += len({x[1] for x in rows} & {i for _, i in best})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("shard_rows", [8192, 300])
def test_recall_over_the_table(spark, shard_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    want = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["vec_id"] for r in rows if r["vec_id"] % 50 == 0], 5)
    assert recall(ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard_rows).collect(), want) >= 0.9


def test_ties_copies_and_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(20)] + [(100, [3.0, 2.0, 1.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [nan, 1.0, 1.0]),
            (104, [inf, 1.0, 1.0]), (105, [None, 1.0, 1.0]), (106, []), (None, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (150, [1.0, 2.0]), (151, [-1e30, 1e30, 1e30]),
            (0, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([(i, v, None, 1, 2, "x") for i, v in rows], SCHEMA)
    found = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, df.where("vec_id % 50 = 0 or vec_id > 100")).collect()]
    assert [x[2] for x in sorted(found) if x[0] == 0] == [1, 2, 3, 4, 5]  # id 0 counts with its smaller vector
    assert [x[2] for x in sorted(found) if x[0] == 100] == [0, 1, 2, 3, 4]
    assert {x[0] for x in found} == {0, 100, 151}
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    few = df.where("vec_id in (1, 2, 100)")
    assert ann.nearest(few, few).count() == 6


def test_scores_are_the_cosine_of_the_stored_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vec = {r["vec_id"]: np.asarray(r["embedding"], np.float64) for r in df.collect()}
    for r in queries.op4_ann(spark, "/root/testdata/sf0.01").collect():
        a, b = vec[r["query_id"]], vec[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_pruning_keeps_diverse_edges():
    x = np.asarray([[1, 0], [0.999, 0.04], [0.998, 0.06], [0, 1]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.robust_prune(x, np.asarray([0]), np.asarray([[1, 2, 3, 1, -1, 0]], np.int32), 3, 1.2).tolist() == [[1, 3, -1]]
    got = ann.robust_prune(x, np.asarray([0]), np.asarray([[1, 2, 3, 1, -1, 0]], np.int32), 3, 1.0).tolist()[0]
    assert got[0] == 1 and 0 not in got and 2 not in got


def shard(seed, n=8192, dim=64):
    return np.random.default_rng(seed).normal(size=(n, dim))


def found_in_shard(x, asks, k=5):
    """Recall of the ``k`` nearest, the query's own row left out; scores that tie count as found."""
    x = x.astype(np.float32)
    unit = ann._unit(x)
    lead = ann.leaders(unit)
    groups = ann.Groups(x, lead)
    graph, start = ann.build_graph(unit[groups.heads])
    starts = ann.entries(len(groups.heads), start)[:ann.ENTRIES]
    beam, _, _ = ann.beam_search(unit[groups.heads], graph, starts, unit[asks], ann.BEAM_QUERY, len(groups.heads))
    w = x.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    hits = 0
    for a, (rows, _) in zip(asks, groups.best(x[asks], beam, k + 1)):
        s = w @ w[a]
        rows = rows[rows != a][:k]
        assert len(set(rows.tolist())) == k
        s[a] = -np.inf
        hits += (s[rows] >= np.sort(s)[-k] - 1e-15).sum()
    return hits / (k * len(asks))


def clustered(noise, n=8192, dim=64):
    """A third of the rows as scaled copies of one vector, with noise."""
    x, rng = shard(1, n, dim), np.random.default_rng(2)
    third = rng.permutation(n)[: n // 3]
    x[third] = (x[0] + noise * rng.normal(size=(len(third), dim))) * rng.choice([0.5, 1, 2, 3, 7], (len(third), 1))
    return x, third


@pytest.mark.parametrize("noise", [0, 1e-6, 3e-4, 1e-3, 1e-2])
def test_nearest_among_noisy_and_scaled_copies(noise):
    x, third = clustered(noise)
    assert found_in_shard(x, third[:100]) >= 0.99


@pytest.mark.parametrize("noise", [0.1, 0.3, 1.0])
def test_a_wide_cluster_does_not_hide_the_others(noise):
    """A third of a full shard lies in one cluster; the rows outside find theirs."""
    x, third = clustered(noise)
    others = np.setdiff1d(np.arange(len(x)), third)[:200]
    assert found_in_shard(x, others) >= 0.9 and found_in_shard(x, third[:100]) >= 0.9


def test_several_full_shards(spark):
    x, third = clustered(0.3, 20_000)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    asks = [int(k) for k in np.setdiff1d(np.arange(len(x)), third)[:150]]
    got = ann.nearest(df, df.where(F.col("vec_id").isin(asks))).collect()
    assert recall(got, brute(list(range(len(x))), x.astype(np.float32), asks, 5)) >= 0.9


def test_shards_travel_once(spark):
    """Queries go to the shards, however many blocks there are."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = sorted(map(tuple, ann.nearest(df, df, shard_rows=200).collect()))
    real, ann.QUERY_BLOCK = ann.QUERY_BLOCK, 7
    try:
        found = ann.nearest(df, df, shard_rows=200)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want and "Union" in plan and "Join" not in plan
    finally:
        ann.QUERY_BLOCK = real


def test_copies_in_the_query(spark):
    x, third = clustered(3e-4, 3000)
    df = spark.createDataFrame([(k, [float(c) for c in v], None, 1, 2, "x") for k, v in enumerate(x)], SCHEMA)
    stored = x.astype(np.float32).astype(np.float64)
    asks = [int(k) for k in third[:40]]
    assert recall(ann.nearest(df, df.where(F.col("vec_id").isin(asks))).collect(), brute(list(range(3000)), stored, asks, 5)) >= 0.99


def test_doubles_keep_their_width(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0 + 1e-10, 2.0]), (2, [1e300, -1e300]), (3, [1e-300, 2e-300]), (4, [1e300, 2.5e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, df).collect()
    got = {r["query_id"]: {} for r in found}
    for r in found:
        got[r["query_id"]][r["vec_id"]] = r["score"]
    assert {q: set(v) for q, v in got.items()} == {q: set(range(5)) - {q} for q in range(5)}
    assert abs(got[3][2] + 1 / np.sqrt(10)) < 1e-12 and abs(got[3][0] - 1) < 1e-12
    # rows of doubles and of floats meet
    mixed = ann.nearest(df, df.selectExpr("vec_id", "cast(embedding as array<float>) as embedding").where("vec_id = 0")).collect()
    assert [r["vec_id"] for r in sorted(mixed, key=lambda r: r["rank"])][-1] == 2 and len(mixed) == 4
