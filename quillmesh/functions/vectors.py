"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def shortened(v: Column, dims: int) -> Column:
    """The first dims components, at unit length again."""
    head = F.slice(v, 1, dims)
    return F.transform(head, lambda x: x.cast("double") / norm(head))


find_words = re.compile(r"[^\W_]+").findall


def hashed_row(text: str | None, dims: int) -> np.ndarray:
    """Counts of hashed words with hashed signs, at unit length; zeros where there is no word."""
    h = np.fromiter((crc32(w.encode()) for w in find_words((text or "").lower())), np.int64)
    v = np.bincount(h % dims, np.where(h >> 20 & 1, 1.0, -1.0), dims)
    n = np.linalg.norm(v)
    return v / n if n else v


def hashed(text: Column, dims: int = 64) -> Column:
    """A deterministic embedding: counts of hashed words with hashed signs, at unit length; a stand-in where no model is.

    A batch at a time in numpy: as nested column functions it would cost words times dims.
    """

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hashed_row(t, dims).tolist())

    return embed(text)


def fake_row(text: str | None, dims: int) -> np.ndarray:
    r = random.Random(int(hashlib.sha256((text or "").encode()).hexdigest(), 16) % 2**31)
    v = np.fromiter((r.gauss(0, 1) for _ in range(dims)), float, dims)
    return v / np.linalg.norm(v)


def fake_rows(texts: pa.Array, dims: int) -> pa.Array:
    """fake_row of each text: the vectors lie in one block from the first, and of the texts one at a time is a Python string."""
    v = np.empty((len(texts), dims))
    for i, t in enumerate(texts):
        v[i] = fake_row(t.as_py(), dims)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(v.ravel()))


def fake(text: Column, dims: int = 384) -> Column:
    """Gaussian unit vectors seeded by the sha256 of the whole text, for tests."""

    @F.arrow_udf("array<double>")
    def embed(s: pa.Array) -> pa.Array:
        return fake_rows(s, dims)

    return embed(text)


def diverse(df: DataFrame, group: str, k: int, lam: float) -> DataFrame:
    """Greedy maximal marginal relevance within each group of candidates (id, score, vec): the k best, in order.

    Candidates are a bounded top list; each group is one small frame.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.asarray(pdf["vec"].tolist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        score, taken = pdf["score"].to_numpy(float), []
        near = np.zeros(len(pdf))
        while len(taken) < min(k, len(pdf)):
            worth = lam * score - (1 - lam) * near if taken else score.copy()
            worth[taken] = -np.inf
            taken.append(int(worth.argmax()))
            near = np.maximum(near, v @ v[taken[-1]]) if len(taken) > 1 else v @ v[taken[-1]]
        return pd.DataFrame({group: pdf[group].iloc[taken], "id": pdf["id"].iloc[taken], "place": range(1, len(taken) + 1)})

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(group).applyInPandas(pick, f"{group} {kind[group]}, id {kind['id']}, place int")


def within_budget(df: DataFrame, group: str, order: list, length: str, most: int, tail: int = 200) -> DataFrame:
    """Ranked blocks until most characters are used; the one that crosses is cut if over tail are left. taken: characters of each."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = df.withColumn("__end", F.sum(length).over(w)).withColumn("__left", most - (F.col("__end") - F.col(length)))
    taken = F.when(F.col("__end") <= most, F.col(length)).when(F.col("__left") > tail, F.col("__left"))
    return run.withColumn("taken", taken).where("taken IS NOT NULL").drop("__end", "__left")


def expanded(seeds: DataFrame, links: DataFrame, factor: float = 0.5) -> DataFrame:
    """(id, score, why) of seeds (id, score) and what links (a, b) lead to from them, at a factor of the best seed's score."""
    near = links.select(F.col("a").alias("id"), "b").join(seeds,
        "id").groupBy(F.col("b").alias("id")).agg((F.max("score") * factor).alias("score")).join(seeds.select("id"), "id", "left_anti")
    return seeds.select("id", "score", F.lit("found").alias("why")).unionByName(near.select("id", "score", F.lit("neighbour").alias("why")))
