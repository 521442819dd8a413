"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors of a label are one node, its copies counted; nodes are numbered.
2. Each label of more than ``SHARD`` nodes gets centroids (spherical k-means on a
   bounded sample), unless vectors are so scattered that the sample's shards would
   overlap to more copies than blocks of the whole label make. A node's home is its
   nearest centroid; it also joins every centroid within its home angle plus the
   link angle. Of two nodes within the link angle, one then is in the other's home
   shard, whatever the data.
3. A shard's members are dealt to blocks of at most about ``BLOCK``. Each block
   finds its nodes' NEAR nearest, and keeps those that pruning for diversity
   leaves (a neighbour goes if a kept one is nearer to it by the factor ALPHA),
   in both directions, DEGREE at most, and besides all within the link angle,
   if they are fewer than NEAR. A node with more of them is crowded: its list
   may have lost some. A list holds places in its block, and goes with its node.
4. Each block of a shard meets itself and each other one once; the home nodes of
   either search the other. A meeting prunes the lists of both in the same way,
   adds a few long links, and searches for every home node: greedily with a beam
   from the medoids, then widening
   from all it found (and itself) through every neighbour within the link angle
   and some slack, until nothing new turns up. Links are what was searched and
   verified in double precision. A node that isn't crowded has every link of its
   own block in its list, so its search there is complete.
5. Where that isn't so (a crowded node, or one that meets another block of its
   shard), the search's links are kept and the rest is counted exactly. One node
   in ``AUDIT`` is counted exactly whatever its list: if its search missed a link,
   the whole meeting is counted. ``link_table`` returns how many links the search
   found, how many a count added, and for audited nodes what was there.

No task holds more than two blocks, however tight a group of near copies is;
links are counted where they are found, and only sums and stars of components
leave a meeting.

Null, zero or non-finite vectors, those with null components and those without
a label link with nothing; vectors of other dimensions link only with their
own. Rows that repeat an id or a vector count as other vectors. Ties don't
matter: every link counts. An empty table has no rows. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators.graphs import components
from ..sources.scratch import kept, spread
from .common import arrow_map, small_batches, stored
from .ngram_join import roots_of, whole_groups
from .vectors import bounded_sample, matrix, usable

#: Nodes that a centroid stands for, and nodes of a block.
SHARD, BLOCK = 4000, 6000
MAX_CENTROIDS = 4096
FIT_ROWS = 40_000
NEAR, DEGREE, LONG = 48, 24, 4
ALPHA = 1.2
BEAM, MEDOIDS = 24, 16
SLACK = 0.04
#: One node in so many is audited.
AUDIT = 64
#: Asking rows of a lot, and pairs that are opened or compared at once.
LOT, PAIRS = 256, 32_768


def spherical_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(11))
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def robust_prune(x: np.ndarray, at: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of the candidates near[i] (nearest first) of node at[i], at most DEGREE that are nearer to it than ALPHA allows from any kept one; -1 fills up."""
    v = x[near]
    own = 2 - 2 * np.einsum("nd,ncd->nc", x[at], v)
    live = near != at[:, None]
    kept = np.full((len(at), DEGREE), -1, np.int64)
    rows = np.arange(len(at))
    for d in range(DEGREE):
        first = live.argmax(1)
        ok = live[rows, first]
        if not ok.any():
            break
        kept[ok, d] = near[rows[ok], first[ok]]
        gap = 2 - 2 * np.einsum("nd,ncd->nc", v[rows, first], v)
        live &= ~(ok[:, None] & (ALPHA**2 * gap <= own))
        live[rows, first] = False
    return kept


def pair_scores(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("nd,nd->n", x[a[i : i + PAIRS]], x[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)] or [np.zeros(0)])


def pruned(x: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Neighbours of each row out of the directed pairs a to b, -1 where there are fewer: at most DEGREE by pruning, and all at or above least, if fewer than NEAR."""
    n = len(x)
    key = np.unique(a * n + b)
    a, b = key // n, key % n
    a, b = a[a != b], b[a != b]
    score = pair_scores(x, a, b)
    order = np.lexsort((-score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    linked = score >= least
    few = linked & (np.bincount(a[linked], minlength=n) < NEAR)[a]
    direct = np.full((n, NEAR), -1, np.int64)
    direct[a[few], place[few]] = b[few]
    a, b, place = a[place < NEAR], b[place < NEAR], place[place < NEAR]
    near = np.tile(np.arange(n)[:, None], (1, NEAR))
    near[a, place] = b
    kept = np.concatenate([robust_prune(x, np.arange(i, min(n, i + 512)), near[i : i + 512]) for i in range(0, n, 512)])
    return np.concatenate([kept, direct], 1)


def build(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each row, -1 where there are fewer, and which rows are crowded: NEAR others or more are at or above least."""
    n = len(x)
    c = min(NEAR + 1, n)  # a row is its own nearest
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    crowded = np.zeros(n, bool)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        at = np.arange(a, min(n, a + 512))
        crowded[at] = (s >= least).sum(1) > NEAR
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        own = robust_prune(x, at, near[:, :NEAR])
        who, k = np.nonzero((np.take_along_axis(s, near, 1) >= least) & ~crowded[at][:, None])
        pairs += [(np.repeat(at, DEGREE)[own.ravel() >= 0], own.ravel()[own.ravel() >= 0]), (at[who], near[who, k])]
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    return pruned(x, np.concatenate([a, b]), np.concatenate([b, a]), least), crowded


def with_long_links(graph: np.ndarray) -> np.ndarray:
    n = len(graph)
    return np.concatenate([graph, np.random.Generator(np.random.PCG64(5)).integers(0, n, (n, LONG))], 1)


def medoids(x: np.ndarray) -> np.ndarray:
    """The row nearest to the mean, and rows each far from those before."""
    picked = [int((x @ x.mean(0)).argmax())]
    far = x @ x[picked[0]]
    for _ in range(min(MEDOIDS, len(x)) - 1):
        picked.append(int(far.argmin()))
        far = np.maximum(far, x @ x[picked[-1]])
    return np.asarray(picked)


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """Which rows each asking row q reaches within the link angle and the slack."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    seen[:, start] = True
    pool, score = np.tile(start, (len(q), 1)), x[q] @ x[start].T
    opened = np.zeros(pool.shape, bool)
    reach = np.zeros_like(seen)
    while True:
        open_score = np.where(opened, -9.0, score)
        best = open_score.argmax(1)
        go = open_score[rows, best] > -9
        if not go.any():
            break
        opened[rows, best] = True
        to = np.where(go[:, None], graph[pool[rows, best]], -1)
        new = (to >= 0) & ~seen[rows[:, None], to]
        seen[rows[:, None], np.where(to >= 0, to, start[0])] = True
        gained = np.where(new, np.einsum("nd,nkd->nk", x[q], x[to]), -9.0)
        pool, score = np.concatenate([pool, to], 1), np.concatenate([score, gained], 1)
        opened = np.concatenate([opened, ~new], 1)
        if pool.shape[1] > BEAM:
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            pool, score, opened = (np.take_along_axis(z, top, 1) for z in (pool, score, opened))
    # widening: every pair within reach opens its neighbours, once
    who, it = np.nonzero(score >= least - SLACK)
    reach[who, pool[who, it]] = True
    reach[rows, q] = True
    waiting = [np.flatnonzero(reach)]
    width = max(1, PAIRS // graph.shape[1])
    while waiting:
        key = waiting.pop()
        if len(key) > width:
            waiting.append(key[width:])
        who, far = np.repeat(key[:width] // len(x), graph.shape[1]), graph[key[:width] % len(x)].reshape(-1)
        who, far = who[far >= 0], far[far >= 0]
        new = ~reach[who, far]
        key = np.unique(who[new] * len(x) + far[new])
        if len(key):
            key = key[pair_scores(x, q[key // len(x)], key % len(x)) >= least - SLACK]
        if len(key):
            reach[key // len(x), key % len(x)] = True
            waiting.append(key)
    return reach


def links(x: np.ndarray, graph: np.ndarray, asks: np.ndarray, have: np.ndarray, open_: np.ndarray, audit: np.ndarray,
    least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In lots: pairs (asking row, row of have) at or above least, how many of each asking row's the search found, and how many an audited row has (else -1).

    have, open_ and audit are masks of rows. A row's pairs are those of its search, each verified; only rows of open_ take what a count of all adds.
    """
    start, exact = medoids(x), False
    lots = [asks[a : a + LOT] for a in range(0, len(asks), LOT)]
    searched = []
    for q in lots:
        who, it = np.nonzero(search(x, graph, q, start, least) & have)
        ok = (pair_scores(x, q[who], it) >= least) & (q[who] != it)
        searched.append((who[ok], it[ok]))
        at = np.flatnonzero(audit[q] & ~open_[q])
        exact |= bool(len(at)) and bool((np.bincount(who[ok], minlength=len(q))[at] < counted_rows(x, q[at], have, least).sum(1)).any())
    for q, (who, it) in zip(lots, searched, strict=True):
        n = np.bincount(who, minlength=len(q))
        again = np.flatnonzero(open_[q] | audit[q] | exact)
        there = np.full(len(q), -1)
        if len(again):
            true = counted_rows(x, q[again], have, least)
            there[again] = true.sum(1)
            found = np.zeros_like(true)
            spot = np.full(len(q), -1)
            spot[again] = np.arange(len(again))
            mine = spot[who] >= 0
            found[spot[who[mine]], it[mine]] = True
            more, far = np.nonzero(true & ~found & (open_[q[again]] | exact)[:, None])
            who, it = np.concatenate([who, again[more]]), np.concatenate([it, far])
        yield q[who], it, n, np.where(audit[q], there, -1)


def counted_rows(x: np.ndarray, q: np.ndarray, have: np.ndarray, least: float) -> np.ndarray:
    """All rows of have at or above least of each row of q."""
    true = (x[q] @ x.T >= least) & have
    true[np.arange(len(q)), q] = False
    return true


class Meeting:
    """Two blocks of a shard, or one and itself: the home nodes of either search the other. Rows are sorted by block and node, so that lists lead to them."""

    def __init__(self, t: pa.Table):
        column = {c: t.column(c).combine_chunks() for c in ("v", "near", "shards")}
        x = matrix(column["v"], len(column["v"][0]))
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.node, self.home, self.n, block = (t.column(c).to_numpy() for c in ("node", "home", "n", "block"))
        self.shard, one, two = (t.column(c)[0].as_py() for c in ("shard", "one", "two"))
        later = (block == two) & (one != two)
        mine = self.home == self.shard
        every = np.ones(len(block), bool)
        #: Of each search: who asks, what may be found, and whose finds are completed by a count.
        self.sides = [(mine, every, t.column("crowded").to_numpy())] if one == two else [(mine & ~later, later, every), (mine & later, ~later, every)]
        near, size = column["near"].flatten().to_numpy().astype(np.int64), column["near"].value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(block)), size)
        self.pairs = owner, near + np.where(later[owner], int((~later).sum()), 0)
        self.shards = column["shards"].flatten().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(self.node)), column["shards"].value_lengths().to_numpy())

    def counted(self, least: float) -> pa.RecordBatch:
        """node, links, searched (those that search alone found), root, and of audited nodes the links there are, of nodes with links and audited ones."""
        m = len(self.node)
        graph = with_long_links(pruned(self.x, *self.pairs, least))
        count, searched, there = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, -1)
        star = np.zeros(0, np.int64), np.zeros(0, np.int64)
        homes = np.unique(self.home)
        joined = np.zeros((m, len(homes)), bool)  # which of the homes that occur here each node is a member of
        at = np.minimum(np.searchsorted(homes, self.shards), len(homes) - 1)
        joined[self.owner[homes[at] == self.shards], at[homes[at] == self.shards]] = True
        home_at = np.searchsorted(homes, self.home)
        for who, have, open_ in self.sides:
            asks = np.flatnonzero(who)
            for lot, (a, b, n, audited) in enumerate(links(self.x, graph, asks, have, open_, self.node % AUDIT == 0, least)):
                count += np.bincount(a, self.n[b], m).astype(np.int64)
                searched[asks[lot * LOT : lot * LOT + len(n)]] = n
                there[asks[lot * LOT : lot * LOT + len(n)]] = audited
                # a found row that searches elsewhere, where the asking one isn't, counts it here
                blind = (self.home[b] != self.shard) & ~joined[a, home_at[b]]
                count += np.bincount(b[blind], self.n[a[blind]], m).astype(np.int64)
                root = roots_of(m, np.concatenate([star[0], a]), np.concatenate([star[1], b]))
                used = np.union1d(star[0], np.union1d(a, b))
                star = used, root[used]
        roots = np.arange(m)
        roots[star[0]] = star[1]
        used = np.union1d(star[0], np.flatnonzero(there >= 0))
        return pa.RecordBatch.from_arrays([pa.array(self.node[used]), pa.array(count[used]), pa.array(searched[used]), pa.array(self.node[roots[used]]),
            pa.array(there[used], mask=there[used] < 0)], ["node", "links", "searched", "root", "audited"])


def whole_parts(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each value of the keys, by which the input is sorted."""
    for t, group in whole_groups(batches, keys, 1):
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            yield t.slice(int(at[0]), len(at))


def vector_key() -> Column:
    """Names a vector (v) of a label in rows that are joined, in place of its numbers."""
    return F.unhex(F.sha2(F.to_json(F.struct("label", "v")), 256))


def numbered_nodes(rows: DataFrame) -> DataFrame:
    """node, key, label, v, rep (least id), n (copies) and group (label and dimension) of each distinct usable vector."""
    own = rows.where("usable").withColumn("key", vector_key())
    per = own.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("n"))
    return stored(per.withColumn("group", F.concat_ws("/", F.size("v"), "label")).withColumn("node", F.monotonically_increasing_id()), "flat-nodes")


def inside(x: np.ndarray, centroids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and of which shards it is a member."""
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    angle = np.arccos(np.clip(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) @ centroids.T, -1, 1))
    home = angle.argmin(1)
    return home, angle <= angle[np.arange(len(x)), home][:, None] + reach


def worthwhile(x: np.ndarray, n: int, centroids: np.ndarray, least: float) -> bool:
    """Whether shards make no more copies of the n nodes that x is a sample of than the blocks of one shard of all would: a member goes to each block of its shard."""
    share = sum(inside(x[a : a + 4096], centroids, least)[1].sum(0) for a in range(0, len(x), 4096)) / len(x)
    return bool((share * np.ceil(share * n / BLOCK)).sum() <= np.ceil(n / BLOCK))


def fit_centroids(nodes: DataFrame, least: float) -> dict[str, np.ndarray]:
    """For groups of more than a shard that they divide: MAX_CENTROIDS of them at most, however many labels there are."""
    share = max(SHARD, -(-nodes.count() // MAX_CENTROIDS))
    large = {r["group"]: (r["n"], r["d"]) for r in nodes.groupBy("group").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("d"))
        .where(F.col("n") > share).collect()}
    out: dict[str, np.ndarray] = {}
    if large:
        sample = bounded_sample(nodes.where(F.col("group").isin(list(large))).select("node", "group", "v"), "node", FIT_ROWS, max(d for _, d in large.values()))
        of = np.asarray(sample.column("group").to_pylist())
        for g, (n, d) in large.items():
            x = matrix(sample.column("v").take(pa.array(np.flatnonzero(of == g))), d) if (of == g).any() else np.zeros((0, d))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            k = min(round(n / share), len(x))
            if k > 1 and worthwhile(x, n, found := spherical_means(x, k), least):
                out[g] = found
    return out


def shard_members(nodes: DataFrame, centroids: dict[str, np.ndarray], least: float) -> DataFrame:
    """node, v, home, shards, n, group, shard, block and blocks: a row for each shard of each node."""

    def deal():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            groups, lists = b.column(1).to_pylist(), b.column(2)
            home, also = np.zeros(len(groups), np.int64), [[0]] * len(groups)
            for g in set(groups) & set(centroids):
                at = [i for i, y in enumerate(groups) if y == g]
                near, member = inside(matrix(lists.take(pa.array(at)), centroids[g].shape[1]), centroids[g], least)
                for i, h, row in zip(at, near, member, strict=True):
                    home[i] = h
                    also[i] = np.flatnonzero(row).tolist()
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(home), pa.array(also, pa.list_(pa.int64())), b.column(3), b.column(1)],
                ["node", "v", "home", "shards", "n", "group"])

        return one

    if centroids:
        numbers = nodes.schema["v"].dataType.simpleString()
        dealt = stored(arrow_map(nodes.select("node", "group", "v", "n"), deal, f"node bigint, v {numbers}, home bigint, shards array<bigint>, n bigint, group string"), "flat-members")
    else:
        dealt = nodes.select("node", "v", F.lit(0).cast("long").alias("home"), F.array(F.lit(0).cast("long")).alias("shards"), "n", "group")
    members = dealt.withColumn("shard", F.explode("shards"))
    sizes = kept(members.groupBy("group", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "flat-sizes", small=True)
    # a shard has a row; centroids are bounded, labels need not be
    return members.join(sizes, ["group", "shard"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def listed(members: DataFrame, least: float) -> DataFrame:
    """The members with near (the places of their neighbours in their block, whose nodes are in order) and crowded."""
    columns = ["node", "v", "home", "shards", "n", "group", "shard", "block", "blocks"]

    def graphs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_parts(batches, ["group", "shard", "block"]):
            v = t.column("v").combine_chunks()
            x = matrix(v, len(v[0]))
            near, crowded = build(x / np.linalg.norm(x, axis=1, keepdims=True), least)
            ends = np.concatenate([[0], (near >= 0).sum(1).cumsum()])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near[near >= 0], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in columns), lists, pa.array(crowded)], [*columns, "near", "crowded"])

    blocks = ["group", "shard", "block"]
    numbers = members.schema["v"].dataType.simpleString()
    return spread(members.select(*columns), *blocks).sortWithinPartitions(*blocks, "node").mapInArrow(graphs,
        f"node bigint, v {numbers}, home bigint, shards array<bigint>, n bigint, group string, shard bigint, block int, blocks int, near array<int>, crowded boolean")


def link_table(nodes: DataFrame, least: float) -> DataFrame:
    """node, links, searched, root and audited, several rows a node; the sums of searched and links tell what the search found, those of audited rows its recall."""
    full = listed(shard_members(nodes, fit_centroids(nodes, least), least), least)
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_parts(batches, ["group", "shard", "one", "two"]):
            yield Meeting(t).counted(least)

    keys = ["group", "shard", "one", "two"]
    found = spread(met.drop("other", "blocks"), *keys).sortWithinPartitions(*keys, "block", "node").mapInArrow(meet,
        "node bigint, links bigint, searched bigint, root bigint, audited bigint")
    return stored(found, "flat-links")


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    small_batches(vectors.sparkSession)
    kind = vectors.schema[vec_col].dataType.elementType
    numbers = F.col(vec_col) if isinstance(kind, FloatType | DoubleType) else F.transform(vec_col, lambda x: x.cast("double"))  # floats take half the room, and become doubles where they are multiplied
    rows = vectors.select(F.col(id_col).alias("id"), numbers.alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("usable", usable(F.col("v")) & F.col("label").isNotNull())
    nodes = numbered_nodes(rows)
    found = link_table(nodes, least)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = nodes.select("node", "key", "rep", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
    named = per.select("key", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    done = named.join(least_id, "root").select("key", F.coalesce("component_id", "rep").alias("component_id"), "n_links")
    linked = rows.where("usable").select("id", vector_key().alias("key")).join(done, "key")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
