"""Prefix trie of conversations.

Every turn of a conversation gets the 128-bit name of the sequence that ends with
it (sums of hashes of turn and depth), so a conversation is a path of node names.
Paths are cut into blocks of ``BLOCK`` turns, which bounds every row, and sorted.
Sorted neighbours are joined by edges as deep as their common prefix; a union-find
takes a chunk's edges in descending depth, and each merge makes the branching node
where its parts meet.  Turns between two branchings are chains of nodes with the
members of the lower end.

A chunk knows all of a node's members unless the node lies on the path of its
first or last row.  Those open nodes, at most two for each depth of a block, are
what is left of the chunk's forest when it is contracted; they are merged by name
across all chunks, wherever partitions end.

What a node says of its subtree follows from sums over its members alone, so
nothing has to climb the trie level by level.  A member *owns* the nodes of which
it is the smallest member: these are the end of its path.  With x(c) the words of c
in nodes that others own, the words that sharing saves in a subtree are the sum of
x over its members, less x of the smallest and less (members - 1) times the words
above the node.  Leaves are counted with their owners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut
from lectern.llm.turns import running, sort_by_range, turn_columns, turn_order

#: Turns of a conversation in one row.
BLOCK = 64
#: Rows that make one forest.
CHUNK = 4096
#: Conversations whose block of so many ids begins with the turns of its first.
FAMILY = 20
_WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, pos`` (from 1)``, turn_key`` (16 bytes that name role and text)``, words``
    of every row with an id, in the order of ``turns.turn_order``."""
    rows = turn_columns(df.where(F.col(f"`{id_col}`").isNotNull()), id_col, turn_col, role_col, text_col)
    # written once: sampling the order would take every text apart twice
    narrow = cut(rows.select(
        "id", "turn", "role", F.substring("text", 1, 24).alias("lead"), F.xxhash64("text").alias("hash"), "seq",
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("turn_key"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("pos")))
    order = ["id", "turn", "role", "lead", "hash", "seq"]
    placed = cut(sort_by_range(narrow, *order).select("id", "turn_key", "words", "pos", "part"))
    return running(placed, "id", ["pos"]).select("id", "pos", "turn_key", "words")


def with_family_openings(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """Conversations that begin like the first of their family: ``id, ord, turn_key,
    words``, with one row of ``ord`` 0 and no turn for each conversation.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all
    if there are fewer, none if it isn't there) in place of its own first h, with
    h = crc32 of c's decimals modulo 4."""
    h = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    first = F.col("id") - F.col("id") % family
    convs = turns.where("pos = 1").select("id", h.alias("h"), first.alias("first"))
    opening = turns.where((F.col("id") % family == 0) & (F.col("pos") <= 3)).select(F.col("id").alias("first"), "pos", "turn_key", "words")
    taken = convs.join(opening, "first").where("pos <= h").select("id", F.col("pos").alias("ord"), "turn_key", "words")
    own = turns.where(F.col("pos") > h).select("id", (F.col("pos") + 3).alias("ord"), "turn_key", "words")
    empty = convs.select("id", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("words"))
    return empty.unionByName(taken).unionByName(own)


def _paths(sequences: DataFrame) -> DataFrame:
    """``id, depth, node, above, words, words_before`` of every turn, and of depth 0
    for every sequence: names of the node and of the one above it, and the words
    of all turns before."""
    # the order within a sequence is that of ``ord``; rows of ord 0 hold no turn
    rows = sequences.withColumn("depth", F.col("turn_key").isNotNull().cast("long"))
    placed = cut(sort_by_range(rows, "id", "ord"))
    deep = running(placed, "id", ["depth"])
    turn = F.col("turn_key").isNotNull()
    named = deep.select("id", "depth", "part", "words", F.col("words").alias("total"),
                        *[F.when(turn, F.xxhash64(F.lit(k), "depth", "turn_key")).otherwise(F.lit(0).cast("long")).alias(f"p{k}") for k in (1, 2)])
    sums = running(named, "id", ["p1", "p2", "total"])

    def name(suffix: str = ""):
        return F.unhex(F.concat(*[F.lpad(F.hex(f"p{k}{suffix}"), 16, "0") for k in (1, 2)]))

    return sums.select("id", "depth", name().alias("node"), name("_before").alias("above"), "words", F.col("total_before").alias("words_before"))


def _blocks(paths: DataFrame) -> DataFrame:
    """One row for each sequence and block of ``BLOCK`` depths (depth 0 belongs to
    the first): ``id, block, above, nodes, words, words_before``."""
    block = F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / BLOCK).cast("long")
    turn = F.struct("depth", "node", "above", "words", "words_before")
    rows = paths.groupBy("id", block.alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    above = F.when(F.col("block") == 0, F.lit(b"")).otherwise(F.col("t")[0]["above"])
    return rows.select("id", "block", above.alias("above"), F.col("t")["node"].alias("nodes"), F.col("t")["words"].alias("words"),
                       F.col("t")["words_before"].alias("words_before"))


class Forest:
    """Union-find over the edges between neighbouring rows of a sorted chunk.

    Row k is a path of ``sizes[k]`` nodes; ``common[k]`` of them are those of row
    k - 1 too.  After ``grow`` tree t spans the rows ``lo[t]..hi[t]``; its node is
    the ``top[t]``-th of their paths, and the nodes below ``top`` down to the one
    after ``top`` of ``up[t]`` (-1: none) have the same rows."""

    def __init__(self, sizes: list[int], common: list[int], low: list, own: list[int], shared: list[int], leaves: list[int]):
        n = len(sizes)
        self.n, self.common = n, common
        self.top, self.lo, self.hi = list(sizes), list(range(n)), list(range(n))
        self.low, self.own, self.shared, self.leaves = list(low), list(own), list(shared), list(leaves)
        self.kids, self.up, self.same = [0] * n, [-1] * n, list(range(n))
        self._root = list(range(n))  # over rows
        self._tree = list(range(n))  # a root row's tree

    def _find(self, k: int) -> int:
        root = self._root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def is_open(self, t: int) -> bool:
        return self.lo[t] == 0 or self.hi[t] == self.n - 1

    def _put_below(self, t: int, node: int) -> None:
        self.up[t] = node
        # a child that other chunks know too is counted once they are merged
        self.kids[node] += not self.is_open(t)

    def grow(self) -> None:
        edges = sorted((k for k in range(1, self.n) if self.common[k]), key=lambda k: -self.common[k])
        for k in edges:
            depth, a, b = self.common[k], self._find(k - 1), self._find(k)
            left, right = self._tree[a], self._tree[b]
            if self.top[left] == depth:
                node = left
            elif self.top[right] == depth:
                node = right
            else:
                node = len(self.top)
                self.same.append(node)
                for column, value in ((self.top, depth), (self.lo, 0), (self.hi, 0), (self.low, None), (self.own, 0), (self.shared, 0),
                                      (self.leaves, 0), (self.kids, 0), (self.up, -1)):
                    column.append(value)
            sums = [column[left] + column[right] for column in (self.shared, self.leaves)]
            low = min((self.low[left], self.own[left]), (self.low[right], self.own[right]))
            lo, hi = self.lo[left], self.hi[right]
            for t in (left, right):
                if t != node:
                    if self.top[t] > depth:
                        self._put_below(t, node)
                    else:  # two trees with the same node
                        self.same[t] = node
                        self.kids[node] += self.kids[t]
            self.lo[node], self.hi[node], (self.low[node], self.own[node]) = lo, hi, low
            self.shared[node], self.leaves[node] = sums
            self._root[b] = a
            self._tree[a] = node

    def above(self, t: int) -> int:
        t = self.up[t]
        while t >= 0 and self.same[t] != t:
            t = self.same[t]
        return t


_PARTS = pa.schema([("chunk", pa.int64()), ("open", pa.bool_()), ("link", pa.string()), ("node", pa.binary()), ("above", pa.binary()),
                    ("depth", pa.int64()), ("words", pa.int64()), ("words_before", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()),
                    ("low_shared", pa.int64()), ("shared", pa.int64()), ("n_leaves", pa.int64()), ("n_children", pa.int64()),
                    ("parent_conv_id", pa.int64())])
_PARTS_SQL = ("chunk long, open boolean, link string, node binary, above binary, depth long, words long, words_before long, n_convs long, "
              "conv_id long, low_shared long, shared long, n_leaves long, n_children long, parent_conv_id long")


def _forest(rows: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    """All nodes of a sorted chunk, those of open trees in part."""
    nodes = rows.column("nodes")
    starts = nodes.offsets.to_numpy()
    sizes = np.diff(starts)
    names = nodes.values  # those of the whole batch, which a slice's offsets count in
    at = np.frombuffer(names.buffers()[2] or b"", "V16")[names.offset:]
    width = int(sizes.max())
    table = np.zeros((len(sizes), width), "V16")
    real = np.arange(width) < sizes[:, None]
    table[real] = at[starts[0]:starts[-1]]
    equal = (table[1:] == table[:-1]) & real[1:] & real[:-1]
    common = [0, *np.where(equal.all(1), width, equal.argmin(1)).tolist()]

    forest = Forest(sizes.tolist(), common, *(rows.column(c).to_pylist() for c in ("id", "x", "x", "leaf")))
    forest.grow()
    trees = [t for t in range(len(forest.top)) if forest.same[t] == t]
    ups = np.array([forest.above(t) for t in trees])
    top = np.array([forest.top[t] for t in trees])
    bottom = np.where(ups < 0, 0, np.array(forest.top)[ups])
    is_open = np.array([forest.is_open(t) for t in trees])
    up_open = np.array([u >= 0 and forest.is_open(u) for u in ups.tolist()])
    low = np.array([forest.low[t] for t in trees])
    size = top - bottom
    which = np.repeat(np.arange(len(trees)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + bottom[which]  # place in the block's path
    lo = np.array([forest.lo[t] for t in trees])[which]
    entry = starts[lo] + k
    block = rows.column("block").to_numpy()[lo]
    first_above = rows.column("above").take(pa.array(lo))
    above = at[np.maximum(entry - 1, 0)].tobytes()
    above = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(entry), [None, pa.py_buffer(above)]).cast(pa.binary())
    begins = k == 0
    above = pa.compute.if_else(pa.array(begins), first_above, above)
    opens = is_open[which]
    at_bottom = k == bottom[which]
    link = np.select([begins & (block == 0), begins, opens, at_bottom & up_open[which]], ["root", "block", "open", "open"], "known")
    parent = np.where(at_bottom, low[np.searchsorted(trees, np.maximum(ups, 0))][which], low[which])
    # the child of a node within a chain: counted later where others know it too
    kids = np.where(k == top[which] - 1, np.array([forest.kids[t] for t in trees])[which], ~opens)

    def of(values):
        return pa.array(np.array(values, np.int64)[which])

    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(k), chunk)), pa.array(opens), pa.array(link.astype(object), pa.string()), names.take(pa.array(entry)), above,
        pa.array(block * BLOCK + k + (block > 0)), *[rows.column(c).values.take(pa.array(entry)) for c in ("words", "words_before")],
        of([forest.hi[t] - forest.lo[t] + 1 for t in trees]), of(low), of([forest.own[t] for t in trees]), of([forest.shared[t] for t in trees]),
        of([forest.leaves[t] for t in trees]), pa.array(kids.astype(np.int64)),
        pa.array(parent, pa.int64(), mask=link != "known")], schema=_PARTS)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            yield _forest(batch.slice(lo, CHUNK), chunk)
            chunk += 1


def _grow(blocks: DataFrame) -> DataFrame:
    """``blocks(id, block, above, nodes, words, words_before, x, leaf)`` -> one row a
    node."""
    order = ["block", "above", "nodes", "id"]
    parts = cut(sort_by_range(blocks, *order).drop("part").mapInArrow(_forests, _PARTS_SQL))
    opened = parts.where("open")
    merged = cut(opened.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("above", "depth", "words", "words_before")], F.first("link").alias("link"),
        F.min(F.struct("conv_id", "low_shared")).alias("low"),
        *[F.sum(c).alias(c) for c in ("n_convs", "shared", "n_leaves", "n_children")]).select("*", "low.*").drop("low"))

    # Open nodes below an open node count as its children now, each once.
    below = merged.where("link = 'open'").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("more"))
    parents = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = (merged.join(below, "node", "left").join(parents, "above", "left")
             .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
             .withColumn("parent_conv_id", F.when(F.col("link") == "open", F.col("parent_conv_id"))))

    columns = ["node", "above", "link", "depth", "words", "words_before", "n_convs", "conv_id", "low_shared", "shared", "n_leaves", "n_children",
               "parent_conv_id"]
    closed = parts.where("not open")
    # A closed node below an open one asks for its chunk's copy of it, so that a
    # node with very many children is met chunk by chunk.
    local = opened.select("chunk", F.col("node").alias("above")).join(parents, "above")
    hung = closed.where("link = 'open'").drop("parent_conv_id").join(local, ["chunk", "above"])
    nodes = (closed.where("link <> 'open'").select(*columns).unionByName(hung.select(*columns)).unionByName(whole.select(*columns)))

    # The first nodes of later blocks hang on the last nodes of the blocks before.
    heads = nodes.where("link = 'block'")
    ends = nodes.where((F.col("depth") > 0) & (F.col("depth") % BLOCK == 0))
    more = heads.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("more"))
    ends_whole = ends.join(more, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    owners = ends.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    heads_whole = heads.drop("parent_conv_id").join(owners, "above")
    rest = nodes.where((F.col("link") != "block") & ((F.col("depth") == 0) | (F.col("depth") % BLOCK != 0)))
    return rest.select(*columns).unionByName(ends_whole.select(*columns)).unionByName(heads_whole.select(*columns))


def _end_digests(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the decimal ids of the sequences that end at
    a node, ascending, joined by commas.  The ids of one node pass through one task
    in order, and only the digest's state is held."""
    import hashlib

    ends = paths.groupBy("id").agg(F.max(F.struct("depth", "node"))["node"].alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for node, id_ in zip(batch.column("node").to_pylist(), batch.column("id").to_pylist()):
                if node != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256(str(id_).encode())
                else:
                    state.update(b",%d" % id_)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.binary()), (1, pa.string()))],
                                                 names=["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of ``sequences(id, ord, turn_key, words)``: one row for each distinct
    beginning, from the empty one (depth 0): ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs`` (members)``, n_children, n_leaves, saved_tokens,
    ends_sha256, node`` and ``above`` (names of the node and its parent).

    A sequence is the rows of an id by ``ord`` that have a ``turn_key``; an id whose
    rows have none is a member of the root alone.  ``saved_tokens`` sums (members
    - 1) times ``words`` over the subtree, the node included.  Equal sequences
    are members of the same nodes, however many; sequences may be of any length.
    Ids and ords aren't null, and an id's ords differ.  No rows give no rows;
    other columns are not read.
    """
    paths = cut(_paths(sequences.select("id", "ord", "turn_key", "words")))
    blocks = cut(_blocks(paths))
    zero = F.lit(0).cast("long")
    first = _grow(blocks.withColumn("x", zero).withColumn("leaf", zero))
    owned = first.groupBy(F.col("conv_id").alias("id")).agg(F.sum("words").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    all_words = paths.groupBy("id").agg(F.sum("words").alias("all"), F.max("depth").alias("size"))
    # A very long sequence has many blocks; its one row here is dealt with them.
    span = 1024
    facts = (all_words.join(owned, "id", "left")
             .select("id", (F.col("all") - F.coalesce("owned", zero)).alias("x"), F.coalesce("leaf", zero).alias("leaf"),
                     F.explode(F.sequence(zero, F.floor(F.col("size") / (BLOCK * span)).cast("long"))).alias("deal")))
    known = blocks.withColumn("deal", F.floor(F.col("block") / span).cast("long")).join(facts, ["id", "deal"]).drop("deal")
    saved = F.col("shared") - F.col("low_shared") - (F.col("n_convs") - 1) * F.col("words_before")
    return (_grow(known).join(_end_digests(paths), "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "node", F.when(F.col("depth") > 0, F.col("above")).alias("above")))
