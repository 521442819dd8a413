"""Hard negatives by Fagin's threshold algorithm.

Components become whole numbers (floor of ``SCALE`` times each), so that every
score is exact. Rows are put in order of label and dealt to shards of even
size; a shard holds, for each component, the list of its rows in order of that
component. An anchor reads all lists at once, from the top where its own
component is positive and from the bottom where it is negative (lists of its
zero components can't matter). Each row met for the first time is looked up and
scored whole. What the next unread entries would add up to is the threshold: no
unmet row scores more. The anchor stops once the threshold falls strictly below
the last score that each of its windows still needs, so ties are met as well.

Two rounds: among rows of its label an anchor finds its positives (in the
shards that hold its label), then among all others, for each positive, the first
rows whose score lies in that positive's window. A window that has too few rows
needs the threshold to fall below its lower end. Anchors are dealt in blocks,
each block and shard a task's unit; a shard's few best of each window are merged
by rank. Vectors spread evenly in many directions let the threshold fall late:
then lists are read to a large part, and nearly all rows of a shard are scored.

Rows with a null id, label or vector, or any null or non-finite component, and
those whose dimension isn't the commonest (the smaller of two) take no part.
Rows that repeat an id each count, but never for an anchor of that id; each
repeated anchor answers. Negative and zero positives have windows as the
inequality gives them: empty for negative ones, zero alone for zero. Ties go to
the smaller id. Components too large for scores of 63 bits are refused with an
error before anything is mined. An empty table, or one without anchors, has no
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import running_sums
from .common import claim, small_batches, stored
from .vectors import matrix

SCALE = 256
#: Rows of a shard at most, and anchors of a block about.
SHARD, BLOCK = 4096, 2048
#: Entries of each list that an anchor reads first; twice as many each time after.
FIRST = 32


class Lists:
    """A shard: its rows, and for each component the rows in order of it."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: list):
        self.ids = ids
        # products of whole numbers below 2**53 in all are exact in double precision, and faster
        exact = float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < 1 << 53
        self.x = x.astype(np.float64) if exact else x.astype(np.int64)
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.x.T, self.order, 1)
        self.names = {v: i for i, v in enumerate(dict.fromkeys(labels))}
        self.labels = np.asarray([self.names[v] for v in labels], np.int64)

    def of(self, label: object) -> np.ndarray:
        return self.labels == self.names.get(label, -1)

    def descend(self, anchor: np.ndarray, allowed: np.ndarray, least: Callable[[np.ndarray, np.ndarray], float]) -> tuple[np.ndarray, np.ndarray, int]:
        """Allowed rows met and their scores, and how many rows were scored. least: the score that the threshold must fall below, given those so far."""
        n, q = len(self.ids), anchor.astype(self.x.dtype)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        unmet, depth, step = allowed.copy(), 0, FIRST
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        if not allowed.any():
            return rows, scores, 0
        if not len(up) + len(down):  # every score is zero
            rows = np.flatnonzero(allowed)
            return rows, np.zeros(len(rows), self.x.dtype), len(rows)
        while depth < n and (q[up] @ self.values[up, n - 1 - depth]) + (q[down] @ self.values[down, depth]) >= least(rows, scores):
            upto = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - upto : n - depth]] = True
            met[self.order[down, depth:upto]] = True
            fresh = np.flatnonzero(met & unmet)
            unmet[fresh] = False
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.x[fresh] @ q])
            depth, step = upto, step * 2
        return rows, scores, len(rows)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k highest, ties to the smaller id."""
        return np.lexsort((self.ids[rows], -scores))[:k]

    def positives(self, anchor: np.ndarray, own: int, label: object, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the shard's k first rows of the label."""

        def least(_: np.ndarray, scores: np.ndarray) -> float:
            return np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf

        rows, scores, _ = self.descend(anchor, self.of(label) & (self.ids != own), least)
        at = self.best(rows, scores, k)
        return self.ids[rows[at]], scores[at].astype(np.int64)

    def negatives(self, anchor: np.ndarray, own: int, label: object, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest and highest score): ids and scores of the shard's k first rows of other labels in it."""

        def least(_: np.ndarray, scores: np.ndarray) -> float:
            need = np.inf
            for lo, hi in windows:
                if lo <= hi:
                    inside = scores[(scores >= lo) & (scores <= hi)]
                    need = min(need, np.partition(inside, -k)[-k] if len(inside) >= k else lo)
            return need

        rows, scores, _ = self.descend(anchor, ~self.of(label) & (self.ids != own), least)
        out = []
        for lo, hi in windows:
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            at = inside[self.best(rows[inside], scores[inside], k)]
            out.append((self.ids[rows[at]], scores[at].astype(np.int64)))
        return out


def visited(index: DataFrame, asked: DataFrame, blocks: int, dim: int, answer: Callable[[Lists, dict], Iterable[tuple]], schema: str, tasks: int) -> DataFrame:
    """What each asked row (shard, aid, id, label, v, known) is answered by its shard's lists. A shard's rows come before its anchors in each block."""
    names = [f.split()[0] for f in schema.split(", ")]
    nothing = F.lit(None).cast("array<bigint>")
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "aid", "id", "label", "v",
        nothing.alias("known"))
    asks = asked.select("shard", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "aid", "id", "label", "v", "known")
    both = held.unionByName(asks).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "kind")
    types = dict(zip(names, (f.split()[1] for f in schema.split(", ")), strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lists", lambda: None)
        parts: list[pa.RecordBatch] = []
        lists, where = None, None
        for b in batches:
            at = np.stack([c.to_numpy() for c in b.columns[:3]], 1)
            cut = np.flatnonzero((np.diff(at, axis=0) != 0).any(1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(at)], strict=True):
                part, unit = b.slice(lo, hi - lo), tuple(at[lo][:2])
                if at[lo][2] == 0:
                    if unit != where:
                        parts, where = [], unit
                    parts.append(part)
                    lists = None
                elif unit == where:
                    if lists is None:
                        t = pa.Table.from_batches(parts)
                        lists = Lists(matrix(t["v"], dim), t["id"].to_numpy(), t["label"].to_pylist())
                    got = [row for ask in part.to_pylist() for row in answer(lists, ask)]
                    if got:
                        cols = [pa.array(c, pa.int32() if types[n] == "int" else pa.int64()) for c, n in zip(zip(*got, strict=True), names, strict=True)]
                        yield pa.RecordBatch.from_arrays(cols, names)

    return both.mapInArrow(run, schema)


def first(df: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """Rows ranked from 1 by score, ties to the smaller id."""
    best = W.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its first positives, the first rows of another
    label whose score is low to high per cent of the positive's."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"),
        (F.col(label_col) if label is None else label).alias("label"), F.transform(vec_col, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")).where("label IS NOT NULL AND size(v) > 0")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"),
        largest.alias("m")).orderBy(F.desc("n"), "d").first()
    if size is None or not size["q"]:
        return spark.createDataFrame([], schema)
    dim, n = size["d"], size["n"]
    if dim * size["m"] ** 2 >= 1 << 62:
        raise ValueError(f"scores of components up to {size['m']:.3g} don't fit into 63 bits")
    shards, blocks = -(-n // shard), -(-size["q"] // block)
    placed = running_sums(rows.where(F.size("v") == dim).withColumn("h", F.xxhash64("id")), [F.col("label"), F.col("h"), F.col("id")], {"aid": F.lit(1)})
    placed = stored(placed.select(F.col("aid").cast("long"), F.expr(f"cast(aid * {shards} div {n} AS int)").alias("shard"), "id", "label", "v", "asks"), "placed")
    index, asks = placed.select("shard", "aid", "id", "label", "v"), placed.where("asks").select("aid", "id", "label", "v")
    of_label = placed.select("shard", F.col("label").alias("label2")).distinct()
    own = asks.join(of_label, F.col("label") == F.col("label2")).select("shard", *asks.columns, F.lit(None).cast("array<bigint>").alias("known"))
    tasks = 2 * shards * blocks

    def near(lists: Lists, ask: dict) -> Iterator[tuple]:
        for other, score in zip(*lists.positives(np.asarray(ask["v"]), ask["id"], ask["label"], positives), strict=True):
            yield ask["aid"], other, score

    close = first(visited(index, own, blocks, dim, near, "aid bigint, other bigint, score bigint", tasks), ["aid"], "score", "other", positives)
    pairs = stored(close.select("aid", F.struct("rank", F.col("other").alias("id"), "score").alias("p")).groupBy("aid").agg(F.sort_array(F.collect_list("p")).alias("p")),
        "positives")
    knowing = asks.join(pairs, "aid").withColumn("known", F.flatten(F.transform("p", lambda p: F.array(p["id"], p["score"]))))
    everywhere = knowing.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *asks.columns, "known")

    def far(lists: Lists, ask: dict) -> Iterator[tuple]:
        known = list(zip(ask["known"][::2], ask["known"][1::2], strict=True))
        windows = [(-(-low * s // 100), high * s // 100) for _, s in known]
        found = lists.negatives(np.asarray(ask["v"]), ask["id"], ask["label"], windows, negatives)
        for i, ((other, s), got) in enumerate(zip(known, found, strict=True)):
            for negative, score in zip(*got, strict=True):
                yield ask["aid"], ask["id"], i, other, s, negative, score

    met = visited(index, everywhere, blocks, dim, far,
        "aid bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", tasks)
    return first(met, ["aid", "place"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score")


#: Every pair of an anchor and another row scored.
HARD_NEGATIVES_SQL = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT * FROM u WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
