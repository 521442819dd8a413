"""Windows, rankings, top lists and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import kept


def running_sums(df: DataFrame, order: list, amounts: dict[str, Column]) -> DataFrame:
    """df with the sums of amounts over all rows before each in the order, under their names: range partitions, their sums, then a window within each. No task sorts all rows."""
    ranged = kept(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__p").agg(*(F.sum(x).alias(f"__{name}") for name, x in amounts.items()))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("__p", *(F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in amounts))
    inside = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    run = ranged.join(F.broadcast(bases), "__p")  # a row a partition
    return run.select(*df.columns, *((F.col(f"__{name}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(name) for name, x in amounts.items()))


def numbered(df: DataFrame, order: list, out: str = "place") -> DataFrame:
    """Rows numbered from 1 in the order, whose keys must be unique."""
    return running_sums(df, order, {out: F.lit(1)}).withColumn(out, (F.col(out) + 1).cast("int"))


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Of each distinct value: below (rows with a smaller one), ties and n (all rows); counted before anything is ordered."""
    counts = df.groupBy(value).agg(F.count("*").alias("ties"))
    total = counts.agg(F.sum("ties").alias("n"))
    return running_sums(counts, [F.col(value)], {"below": F.col("ties")}).join(F.broadcast(total))  # one row


def with_rank_share(df: DataFrame, value: str, out: str, of: DataFrame | None = None) -> DataFrame:
    """Average 0-based rank over n - 1, as a share: ties have the mean of their ranks, a single row 0.5. of: rows to rank among, those of df by default."""
    share = F.when(F.col("n") == 1, F.lit(0.5)).otherwise((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("n") - 1))
    ranks = value_ranks(df if of is None else of, value).select(F.col(value).alias("__v"), share.alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def with_share_below(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of rows with a smaller value."""
    ranks = value_ranks(df, value).select(F.col(value).alias("__v"), (F.col("below") / F.col("n")).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def burndown(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Open items at the end of each day: daily sums first, then a running sum over days alone."""
    days = opened.select(F.col("day"),
        F.lit(1).alias("d")).unionByName(closed.select("day", F.lit(-1).alias("d"))).groupBy("day").agg(F.sum("d").alias("change"))
    return days.withColumn("open", F.sum("change").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)))


def smooth_derivative(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First derivative of a five-point cubic Savitzky-Golay fit; ends are mirrored. Series shorter than five have none."""
    w = W.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    i = F.row_number().over(w) - 1

    def at(k: int) -> Column:
        return F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)

    def near(k: int) -> Column:
        """The value k rows on; beyond an end, that as far inside of it."""
        out, side = at(k), -1 if k < 0 else 1
        for edge in range(abs(k)):  # rows from the end, 0 is the last before it
            here = i == edge if side < 0 else i == n - 1 - edge
            out = F.when(here, at(-side * (abs(k) - 2 * edge))).otherwise(out)
        return out

    derivative = (near(-2) - 8 * near(-1) + 8 * near(1) - near(2)) / 12
    return df.withColumn("derivative", F.when(n >= 5, derivative))


def valleys(df: DataFrame, keys: list[str], order: str, value: str, share: float = 0.2) -> DataFrame:
    """Rows where the derivative turns from negative to not negative and the value is in the lowest share of its series."""
    d = smooth_derivative(df, keys, order, value)
    low = df.groupBy(*keys).agg(F.percentile(value, share).alias("__low"))
    before = F.lag("derivative").over(W.partitionBy(*keys).orderBy(order))
    turned = d.withColumn("__before", before).where("__before < 0 AND derivative >= 0")
    return turned.join(low, keys).where(F.col(value) <= F.col("__low")).drop("__low", "__before")


def spaced(df: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Greedily from the first, positions at least gap apart: one pass over each group in order, which holds no more than the last position taken."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            keep = []
            for *k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                take = k != key or x - last >= gap
                if take:
                    key, last = k, x
                keep.append(take)
            yield b.filter(pa.array(keep))

    rows = df.select(*keys, F.col(at).cast("long").alias(at)).where(F.col(at).isNotNull())
    return rows.repartition(*keys).sortWithinPartitions(*keys, at).mapInArrow(run, rows.schema)


def adaptive_cut(df: DataFrame, keys: list[str], score: str, id_col: str, ratio: float, k: int) -> DataFrame:
    """Rows up to the first drop of more than ratio times the top score; one at least, k at most, one when the top is zero."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), id_col)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    top, before = F.first(score).over(w), F.lag(score).over(w)
    drop = F.coalesce(before - F.col(score) > ratio * top, F.lit(False)) | ((top <= 0) & (F.col("rank") > 1))
    cut = ranked.withColumn("__drop", drop.cast("int"))
    return cut.withColumn("__gone", F.max("__drop").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("__gone = 0").drop("__drop", "__gone")


def symbol_search(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes by how well their name matches: whole, prefix, part, then part of the id."""
    q, name = text.lower(), F.lower("name")
    score = F.when(name == q, 1.0).when(name.startswith(q), 0.8).when(name.contains(q), 0.6).when(F.lower("id").contains(q), 0.4)
    return nodes.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "file_path", "name", "id").limit(limit)


def sprint(items: DataFrame, capacity: int, now: str) -> DataFrame:
    """Open items of least urgency score: ten a priority step, less up to five for age, less five when active."""
    age = F.datediff(F.lit(now).cast("timestamp"), F.col("created_at").cast("timestamp"))
    score = F.substring("priority", 2, 1).cast("int") * 10 - F.least(age * 0.1, F.lit(5.0)) - F.when(F.col("active"), 5.0).otherwise(0.0)
    return items.withColumn("score", F.round(score, 4)).orderBy("score", "id").limit(capacity)


def alerts(hits: DataFrame, drain: int = 3) -> DataFrame:
    """Each rule and file once a session, the gravest first; those beyond drain stay queued."""
    rank = F.when(F.col("severity") == "review", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    once = hits.dropDuplicates(["session", "rule", "path"])
    place = F.row_number().over(W.partitionBy("session").orderBy(rank, "rule", "path"))
    return once.withColumn("place", place).withColumn("state", F.when(F.col("place") <= drain, "drained").otherwise("queued"))


def merge_kept_state(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """new rows over old ones by key, keeping what users set; old rows that are gone stay."""
    o, n = old.select(key, F.col(state).alias("__old"), F.col("value").alias("__v")), new.select(key, "value")
    return o.join(n, key, "full_outer").select(key, F.coalesce("value", "__v").alias("value"), F.coalesce("__old", F.lit(False)).alias(state))


# The categories of concepts by axis.
AXES = {
    "intent": ["architecture", "domain", "product"],
    "rules": ["security", "constraint", "decision", "tradeoff"],
    "implementation": ["technical", "pattern", "process", "epistemic", "brand"],
}


def worker_scopes(size: int) -> list[tuple[str, str]]:
    """(worker, category) for a crew: one worker for all, one for each axis (3), or one for each category (10)."""
    if size not in (1, 3, 10):
        raise ValueError(f"a crew is of 1, 3 or 10, not of {size}")
    return [("all" if size == 1 else axis if size == 3 else c, c) for axis, own in AXES.items() for c in own]


def scoped(concepts: DataFrame, sizes: list[int]) -> DataFrame:
    """size, worker, category, concepts: how many concepts (id, category) each worker of each crew takes on."""
    table = concepts.sparkSession.createDataFrame([(s, *x) for s in sizes for x in worker_scopes(s)], "size int, worker string, category string")
    many = concepts.groupBy("category").agg(F.count("id").alias("concepts"))
    return table.join(many, "category", "left").select("size", "worker", "category", F.coalesce("concepts", F.lit(0)).alias("concepts"))
