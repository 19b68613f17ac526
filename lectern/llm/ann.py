"""Approximate nearest neighbours over robust-pruned directed graphs.

Distinct vectors are dealt by a hash to shards of about ``SHARD_ROWS``; each
shard holds one directed graph.  A vector is inserted by a greedy search on the
graph so far, whose path proposes its neighbours; relaxed pruning keeps a
neighbour only if none kept before is closer to it by the factor ``alpha``, which
leaves long edges in place.  A query runs a beam search in every shard, and the
nearest of all shards are merged.  All of a shard's work is done for many points
at once.

Of vectors that lie closer together than a graph with a bounded beam can tell
apart (scaled copies, copies with small noise) only a leader is in the graph.
Wherever a query meets a leader whose group may hold one of its nearest, it is
compared with the whole group in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, shuffle_partitions

K = 5
SHARD_ROWS = 8192
DEGREE = 28
BEAM_BUILD = 56
BEAM_QUERY = 112
ALPHA = 1.2
#: Queries that travel together to a shard.
QUERY_BLOCK = 1024
#: Points that a search begins at.
ENTRIES = 96
#: Points that are inserted together at most.
INSERT = 512
#: 1 - cosine up to which a vector belongs to a leader's group.
GROUP = 1e-3


def entries(n: int, start: int) -> np.ndarray:
    """Points that searches of a graph of ``n`` points begin at, the first ones that
    were inserted: the central point, and others from all over, so that no search
    has to find its way out of one wide cluster."""
    order = np.random.default_rng(n).permutation(n)
    return np.concatenate(([start], order[order != start]))


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Beam search for all rows of ``q`` at once among the first ``n`` points, from
    ``starts`` on.

    Returns the beams' ids (-1: none) and distances in order, and for each step
    the ids that were expanded (-1: none).  Distances are 1 - cosine; rows of
    ``x`` and ``q`` have length 1."""
    b = len(q)
    ids = np.full((b, width), -1, np.int32)
    dist = np.full((b, width), np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    first = 1 - q @ x[starts].T
    order = np.argsort(first, 1, kind="stable")[:, :width]
    m = order.shape[1]
    ids[:, :m], dist[:, :m], open_[:, :m] = starts[order], np.take_along_axis(first, order, 1), True
    seen = np.zeros((b, n), bool)
    seen[:, starts] = True
    trail, rows = [], np.arange(b)
    while True:
        d = np.where(open_, dist, np.inf)
        j = d.argmin(1)
        act = np.flatnonzero(np.isfinite(d[rows, j]))
        if not len(act):
            return ids, dist, trail
        j = j[act]
        cur = ids[act, j]
        open_[act, j] = False
        step = np.full(b, -1, np.int32)
        step[act] = cur
        trail.append(step)
        nb = graph[cur]
        bad = (nb < 0) | seen[act[:, None], np.maximum(nb, 0)]
        seen[act[:, None], np.maximum(nb, 0)] = True
        nd = 1 - np.einsum("ard,ad->ar", x[np.maximum(nb, 0)], q[act])
        nd[bad] = np.inf
        all_ids = np.concatenate((ids[act], np.where(bad, -1, nb)), 1)
        all_d = np.concatenate((dist[act], nd), 1)
        all_open = np.concatenate((open_[act], ~bad), 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :width]
        ids[act] = np.take_along_axis(all_ids, order, 1)
        dist[act] = np.take_along_axis(all_d, order, 1)
        open_[act] = np.take_along_axis(all_open, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1: none), nearest
    first; a candidate goes when one kept before is closer to it by ``alpha``."""
    cand = np.sort(cand, 1)
    alive = cand >= 0
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    alive &= cand != points[:, None]
    at = np.maximum(cand, 0)
    vec = x[at]
    dist = np.where(alive, 1 - np.einsum("pcd,pd->pc", vec, x[points]), np.inf)
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for r in range(degree):
        d = np.where(alive, dist, np.inf)
        j = d.argmin(1)
        ok = np.isfinite(d[rows, j])
        if not ok.any():
            break
        out[ok, r] = cand[rows, j][ok]
        alive[rows, j] = False
        to = 1 - np.einsum("pcd,pd->pc", vec, vec[rows, j])
        alive &= ~(ok[:, None] & (alpha * to <= dist))
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BEAM_BUILD, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph as an array of out-neighbours (-1: none) and its entry point."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    mean = x.mean(0)
    start = int(np.argmax(x @ mean))
    order = entries(n, start)
    at, size = 1, 1
    while at < len(order):
        batch = order[at:at + size].astype(np.int32)
        _, _, trail = beam_search(x, graph, order[:min(at, ENTRIES)], x[batch], width, n)
        at, size = at + len(batch), min(size * 2, INSERT)
        beam = np.stack(trail, 1)
        for lo in range(0, len(batch), 256):
            part = slice(lo, lo + 256)
            graph[batch[part]] = robust_prune(x, batch[part], beam[part], degree, alpha)
        _link_back(x, graph, batch, degree, alpha)
    return graph, start


def _link_back(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back from the new points' neighbours; a full list is pruned anew."""
    to = graph[batch]
    frm = np.repeat(batch, degree)[to.ravel() >= 0]
    to = to.ravel()[to.ravel() >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    count = np.diff(np.r_[first, len(to)])
    nodes = to[first]
    rank = np.arange(len(to)) - np.repeat(first, count)
    used = (graph[nodes] >= 0).sum(1)
    fits = used + count <= degree
    e = np.repeat(fits, count)
    graph[to[e], (np.repeat(used, count) + rank)[e]] = frm[e]
    for lo in range(0, len(over := np.flatnonzero(~fits)), 256):
        part = over[lo:lo + 256]
        cand = np.full((len(part), degree + int(count[part].max())), -1, np.int32)
        cand[:, :degree] = graph[nodes[part]]
        for k, p in enumerate(part):
            cand[k, degree:degree + count[p]] = frm[first[p]:first[p] + count[p]]
        graph[nodes[part]] = robust_prune(x, nodes[part], cand, degree, alpha)


def _unit(v: np.ndarray) -> np.ndarray:
    w = v.astype(np.float64)
    w /= np.abs(w).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return (w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32)


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of ``q`` with the rows of its slice of ``c``, in double precision."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    q = q / np.abs(q).max(-1, keepdims=True)
    c = c / np.abs(c).max(-1, keepdims=True)
    return np.einsum("bd,bkd->bk", q, c) / (np.linalg.norm(q, axis=-1)[:, None] * np.linalg.norm(c, axis=-1))


def leaders(unit: np.ndarray, within: float = GROUP, block: int = 1024) -> np.ndarray:
    """For each row the row that leads its group: the first leader within
    ``within`` of it, or itself."""
    lead = np.arange(len(unit))
    heads = np.empty(0, np.int64)
    for lo in range(0, len(unit), block):
        at = np.arange(lo, min(lo + block, len(unit)))
        for h in range(0, len(heads), block):
            near = 1 - unit[at] @ unit[heads[h:h + block]].T <= within
            hit = near.any(1)
            lead[at[hit]] = heads[h + near[hit].argmax(1)]
            at = at[~hit]
        near = 1 - unit[at] @ unit[at].T <= within
        free, new = np.ones(len(at), bool), []
        for j in range(len(at)):
            if free[j]:
                new.append(at[j])
                mine = free & near[j]
                lead[at[mine]] = at[j]
                lead[at[j]] = at[j]
                free &= ~mine
                free[j] = False
        heads = np.concatenate((heads, np.asarray(new, np.int64)))
    return lead


class Groups:
    """A shard's vectors behind the graph points that lead them."""

    def __init__(self, vec: np.ndarray, lead: np.ndarray):
        self.vec = vec
        self.heads = np.flatnonzero(lead == np.arange(len(lead)))
        point = np.searchsorted(self.heads, lead)
        self.order = np.argsort(point, kind="stable")
        self.ends = np.cumsum(np.bincount(point, minlength=len(self.heads)))
        self.size = np.diff(np.r_[0, self.ends])
        # the furthest that a member is from its leader, as a distance of unit vectors
        w = _unit(vec).astype(np.float64)
        self.reach = np.zeros(len(self.heads))
        np.maximum.at(self.reach, point, np.linalg.norm(w - w[lead], axis=1) + 1e-6)

    def best(self, q: np.ndarray, beam: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` nearest vectors of the groups whose leaders are in its beam,
        as (rows, cosines), ties to the smaller row."""
        at = np.maximum(beam, 0)
        exact = np.where(beam >= 0, cosine(q, self.vec[self.heads[at]]), -np.inf)
        rows, scores = [[self.heads[b[b >= 0]]] for b in beam], [[e[b >= 0]] for e, b in zip(exact, beam)]
        # no member is nearer than its leader by more than the group's reach, and
        # the k-th leader found is as near as the k-th vector at least
        far = np.sqrt(np.maximum(2 - 2 * np.maximum(exact, -1), 0))
        kth = np.sort(np.where(beam >= 0, far, np.inf), 1)[:, min(k, beam.shape[1]) - 1]
        open_ = (beam >= 0) & (self.size[at] > 1) & (far - self.reach[at] <= kth[:, None] + 1e-6)
        who, col = np.nonzero(open_)
        point = beam[who, col]
        by = np.argsort(point, kind="stable")
        who, point = who[by], point[by]
        first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]]) if len(point) else []
        for lo, hi in zip(first, [*first[1:], len(point)]):
            g = point[lo]
            members = self.order[self.ends[g] - self.size[g]:self.ends[g]]
            members = members[members != self.heads[g]]
            asking = who[lo:hi]
            for b, found in zip(asking, _cosines(q[asking], self.vec[members])):
                # ties at the cut all stay
                keep = found >= np.partition(found, -k)[-k] if len(found) > k else slice(None)
                rows[b].append(members[keep])
                scores[b].append(found[keep])
        out = []
        for r, s in zip(rows, scores):
            r, s = np.concatenate(r), np.concatenate(s)
            top = np.lexsort((r, -s))[:k]
            out.append((r[top], s[top]))
        return out


def _cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of every row of ``q`` with every row of ``c``, as ``cosine`` has them."""
    return np.concatenate([cosine(q, np.broadcast_to(c[lo:lo + 256], (len(q), *c[lo:lo + 256].shape)))
                           for lo in range(0, len(c), 256)], 1)


_INDEX = "dim int, shard int, n long, start long, ids binary, counts binary, vectors binary, lead binary, graph binary"


def build_index(vectors: DataFrame, shards: int, degree: int = DEGREE, width: int = BEAM_BUILD, alpha: float = ALPHA) -> DataFrame:
    """``vectors(ids array<long>, vector array<float> or array<double>)`` -> one row per shard with
    its vectors, the ids that have each of them, and the graph."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vec = np.stack(table.column("vector").to_numpy(zero_copy_only=False))
        ids = table.column("ids").to_pylist()
        order = np.argsort([i[0] for i in ids], kind="stable")  # the graph doesn't depend on how rows arrive
        vec, ids = np.ascontiguousarray(vec[order]), [ids[k] for k in order]
        unit = _unit(vec)
        lead = leaders(unit)
        graph, start = build_graph(unit[lead == np.arange(len(lead))], degree, width, alpha)
        row = {"dim": vec.shape[1], "shard": table.column("shard")[0].as_py(), "n": len(vec), "start": start,
               "ids": np.asarray([i for x in ids for i in x], "<i8").tobytes(),
               "counts": np.asarray([len(x) for x in ids], "<i4").tobytes(),
               "vectors": vec.tobytes(), "lead": lead.astype("<i4").tobytes(), "graph": graph.astype("<i4").tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()),
            ("counts", pa.binary()), ("vectors", pa.binary()), ("lead", pa.binary()), ("graph", pa.binary())]))

    keyed = vectors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "ids", "vector")
    return cut(keyed.repartition(max(shards, 1), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, _INDEX))


def _stored(data: bytes, n: int, dim: int) -> np.ndarray:
    """Vectors in the width that they came in, float or double."""
    return np.frombuffer(data, f"<f{len(data) // (n * dim)}").reshape(n, dim)


class _Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict, degree: int):
        vec = _stored(row["vectors"], row["n"], row["dim"])
        self.graph = np.frombuffer(row["graph"], "<i4").reshape(-1, degree)
        self.groups = Groups(vec, np.frombuffer(row["lead"], "<i4"))
        self.counts = np.frombuffer(row["counts"], "<i4")
        self.ids, self.ends = np.frombuffer(row["ids"], "<i8"), np.cumsum(self.counts)
        self.unit = _unit(vec[self.groups.heads])
        self.starts = entries(len(self.unit), row["start"])[:ENTRIES]

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, width: int) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(q), 256):
            part = q[lo:lo + 256]
            beam, _, _ = beam_search(self.unit, self.graph, self.starts, _unit(part), width, len(self.unit))
            out_q, out_v, out_s = [], [], []
            # k + 1 vectors hold the k nearest rows even if one is the query's own
            for b, top in enumerate(self.groups.best(part, beam, k + 1)):
                for c, score in zip(*top):
                    for i in self.ids[self.ends[c] - self.counts[c]:self.ends[c]]:
                        if i != q_ids[lo + b]:
                            out_q.append(q_ids[lo + b])
                            out_v.append(i)
                            out_s.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
                                             names=["query_id", "vec_id", "score"])


def _search(k: int, width: int, degree: int):
    """Rows of shards, each followed by the blocks of queries that ask it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, where = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                at = row["dim"], row["shard"], row["deal"]
                if row["block"] < 0:
                    shard, where = _Shard(row, degree), at
                elif at == where:  # queries of a length that no shard has find nothing
                    q_ids = np.frombuffer(row["q_ids"], "<i8")
                    yield from shard.nearest(q_ids, _stored(row["q_vectors"], len(q_ids), row["dim"]), k, width)

    return run


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part, one per id: no null id, and a
    vector that is neither null nor empty nor zero, of finite components.  Floats
    stay floats, numbers of other types become doubles."""
    vector = df.select(F.col(f"`{vector_col}`").alias("vector"))
    kind = "array<float>" if vector.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("id").agg(
        F.min("vector").alias("vector"))


def nearest(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM_QUERY, alpha: float = ALPHA) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for each row of ``queries``, which
    has the same columns: ``query_id, rank, vec_id, score``, ties to the smaller
    id.  The row with the query's own id is no candidate.

    Rows without an id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part.  An id that several rows have counts
    once, with its smallest vector.  Vectors of different lengths are never
    near each other.  A query without candidates gives no row; empty tables
    give no rows; other columns are not read.
    """
    rows = cut(usable(df, id_col, vector_col))
    ask = cut(usable(queries, id_col, vector_col))
    # Rows with one vector become one point; of their ids the k + 1 smallest
    # are all that k results and the query's own can need.
    place = Window.partitionBy("vector").orderBy("id")
    points = cut(rows.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
                 .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, math.ceil(points.count() / shard_rows))
    index = build_index(points, shards, degree, max(BEAM_BUILD, degree), alpha)

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        vec = np.stack(table.column("vector").to_numpy(zero_copy_only=False))
        return pa.table({"dim": pa.array([vec.shape[1]], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                         "q_ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "q_vectors": pa.array([vec.tobytes()], pa.binary())})

    blocks = max(1, math.ceil(ask.count() / QUERY_BLOCK))
    # Queries go to the shards.  A shard is there once, or, where there are fewer
    # shards than tasks, as often as it takes to have something for every task.
    deals = min(blocks, math.ceil(shuffle_partitions(df.sparkSession) / shards))
    asked = (ask.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")
             .groupBy("dim", "block").applyInArrow(block, "dim int, block int, q_ids binary, q_vectors binary")
             .withColumn("deal", F.col("block") % deals).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    held = index.withColumn("block", F.lit(-1)).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    place = ["dim", "shard", "deal"]
    found = (held.unionByName(asked, allowMissingColumns=True).repartition(shards * deals, *place).sortWithinPartitions(*place, "block")
             .mapInArrow(_search(k, max(beam, k + 1), degree), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
