"""Nearest neighbours by multi-index hashing.

Vectors get codes of 640 bits from learned rotations (iterative quantisation on
a bounded sample). Each code is split into 40 substrings of 16 bits, and each
shard of rows has an index from substring number and value to its rows, built
once. A query probes all values within distance r of each of its substrings;
by the pigeonhole principle that retrieves every code within Hamming distance
40 (r + 1) - 1, and many beyond. r grows from 0 until ``FOUND`` codes lie
within that distance, or, from ``RADIUS`` on, until so many rows (all, if there
are fewer) have been retrieved. Every retrieved row is reranked by inner
product in double precision. Nothing but probes retrieves rows; every row is
indexed, and there is no cap on a bucket.

Vectors of unequal length are mapped so that angles order them as inner
products do: one more coordinate lifts each to the largest length.

Rows are dealt to shards once, each query visits each shard once, and of each
visit only the nearest k stay. Queries stream past the shard's index.

Vectors that are null, zero or hold null or non-finite components, those of a
null id, and those whose dimension isn't the commonest take no part. Rows that
repeat an id are never neighbours of each other, and count once, with their
best score, as neighbours of others. Ties go to the smaller id. An empty table
has no result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches
from .vectors import bounded_sample, matrix, usable

PARTS, WIDTH = 40, 16
BITS = PARTS * WIDTH
#: Codes within the pigeonhole distance that end a query's probes; from RADIUS on, retrieved rows that do.
FOUND, RADIUS = 1000, 3
SHARD = 8192
FIT_ROWS = 16_384
#: Queries whose probes are run together.
TOGETHER = 64
VALUES = 1 << WIDTH
#: All masks of a substring, those of fewer bits first, and where those of each number of bits end.
MASKS = np.argsort(np.bitwise_count(np.arange(VALUES, dtype=np.uint32)), kind="stable").astype(np.uint16)
ENDS = np.bincount(np.bitwise_count(np.arange(VALUES, dtype=np.uint32)), minlength=WIDTH + 1).cumsum()


class Codes:
    """Learned rotations: mean, columns of directions."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, rounds: int = 15):
        self.longest = longest or 1.0
        x = self.lift(sample)
        self.mean = x.mean(0) if len(x) else np.zeros(sample.shape[1] + 1)
        x = x - self.mean
        dim, r, made = x.shape[1], np.random.Generator(np.random.PCG64(7)), []
        base = np.linalg.svd(x, full_matrices=False)[2][: min(dim, bits)].T if len(x) > dim else np.eye(dim)[:, : min(dim, bits)]
        x = x @ base
        while sum(m.shape[1] for m in made) < bits:
            turn = np.linalg.qr(r.normal(size=(x.shape[1], x.shape[1])))[0]
            for _ in range(rounds if len(x) else 0):
                u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
                turn = (u @ v).T
            made.append(base @ turn)
        self.turn = np.concatenate(made, 1)[:, :bits]

    def lift(self, x: np.ndarray) -> np.ndarray:
        y = x / self.longest
        return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y**2).sum(1)))[:, None]], 1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((self.lift(x) - self.mean) @ self.turn > 0, axis=1)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.packbits((np.concatenate([q, np.zeros((len(q), 1))], 1) - self.mean) @ self.turn > 0, axis=1)


class Tables:
    """The index of one shard: for each substring number, the rows in order of their value, and where each value's rows begin."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        parts = np.ascontiguousarray(codes).view(np.uint16)
        self.rows = np.stack([np.argsort(parts[:, j], kind="stable") for j in range(PARTS)])
        self.start = np.stack([np.concatenate([[0], np.bincount(parts[:, j], minlength=VALUES).cumsum()]) for j in range(PARTS)])

    def probe(self, sub: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of which a substring differs in exactly r bits; some more than once."""
        masks = MASKS[ENDS[r - 1] if r else 0 : ENDS[r]]
        who, row = [], []
        for j in range(PARTS):
            value = sub[:, j][:, None] ^ masks[None, :]
            lo = self.start[j][value]
            q, m = np.nonzero(self.start[j][value.astype(np.int64) + 1] > lo)
            lo, hi = lo[q, m], self.start[j][value[q, m].astype(np.int64) + 1]
            count = hi - lo
            who.append(np.repeat(q, count))
            row.append(self.rows[j][np.repeat(lo - (count.cumsum() - count), count) + np.arange(count.sum())])
        return np.concatenate(who), np.concatenate(row)

    def retrieve(self, codes: np.ndarray, found: int = FOUND, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """For each query: a mask of the retrieved rows, and the r at which its probes ended."""
        n, q = len(self.words), np.ascontiguousarray(codes).view(np.uint64)
        sub = np.ascontiguousarray(codes).view(np.uint16)
        hit, ended = np.zeros((len(q), n), bool), np.full(len(q), WIDTH)
        near = np.zeros(len(q), np.int64)
        live, want = np.arange(len(q)), min(found, n)
        for r in range(WIDTH + 1):
            who, row = self.probe(sub[live], r)
            fresh = np.unique((live[who] * n + row)[~hit[live[who], row]])
            who, row = fresh // n, fresh % n
            hit[who, row] = True
            # what lies within the distance that the probes now cover: of the new rows, and of the old ones
            near[live] = 0
            sure = PARTS * (r + 1) - 1
            for a in live:
                rows = np.flatnonzero(hit[a])
                near[a] = int((np.bitwise_count(q[a] ^ self.words[rows]).sum(1) <= sure).sum()) if len(rows) >= want else 0
            done = (near[live] >= want) | ((r >= radius) & (hit[live].sum(1) >= want))
            ended[live[done]] = r
            live = live[~done]
            if not len(live):
                break
        return hit, ended


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order whatever its place among the rows: equal rows have equal scores."""
    return (x * q).sum(1)


def best_rows(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, found: int = FOUND, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows, ties to the smaller id."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("v")) & F.col("id").isNotNull())
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    if size is None or not size["q"]:
        return spark.createDataFrame([], schema)
    dim = size["d"]
    rows = rows.where(F.size("v") == dim)
    sample = matrix(bounded_sample(rows.select("id", "v"), "id", FIT_ROWS, dim).column("v"), dim)
    codes = Codes(sample, float(np.sqrt(size["m"])))
    shards = -(-size["n"] // SHARD)
    index = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"),
        "id", "v")

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Tables, np.ndarray, np.ndarray]]:
        """Each shard's rows come first and are held; its queries follow, batch by batch."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard, tables, x, of = None, None, None, None
        for b in batches:
            at, kind, ids, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), dim)
            cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(at)], strict=True):
                if kind[lo] == 0:
                    if at[lo] != shard:
                        shard, held = at[lo], []
                    held.append((ids[lo:hi], v[lo:hi]))
                    tables = None
                elif at[lo] == shard:  # else no row of this shard
                    if tables is None:
                        of, x = np.concatenate([i for i, _ in held]), np.concatenate([y for _, y in held])
                        tables = Tables(codes.of_rows(x))
                    yield of, x, tables, ids[lo:hi], v[lo:hi]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, x, tables, ids, v in visits(batches):
            for a in range(0, len(ids), TOGETHER):
                q, them, s = [], [], []
                hit, _ = tables.retrieve(codes.of_queries(v[a : a + TOGETHER]), found)
                for i, row in enumerate(hit):
                    near = np.flatnonzero(row)
                    near = near[of[near] != ids[a + i]]
                    score = inner(x[near], v[a + i])
                    best = best_rows(of[near], score, k)
                    q.append(np.full(len(best), ids[a + i]))
                    them.append(of[near][best])
                    s.append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(them)), pa.array(np.concatenate(s))],
                    ["query_id", "vec_id", "score"])

    met = index.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run,
        "query_id bigint, vec_id bigint, score double")
    once = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
