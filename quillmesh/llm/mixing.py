"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its share of all words by weight, at most ``most`` times
its own size; what stops there is shared again among the rest by weight until
none is above. Inside a source, documents have weights of their own (longer
texts up to ``1.75`` times that of short ones, or a column): a document expects
min(rate * weight, most) copies, and the source's rate is the one at which
those add up to its target, so what the bound cuts goes to the other documents.
The whole part of the copies is certain, the fraction is the inclusion
probability p. Documents are ranked by their random odds u / (1 - u) over their
inclusion odds p / (1 - p), and each source takes the least ranks until the
words that its certain copies leave open are filled (a rank whose middle word
lies beyond that is out). u comes from a digest of id and text, so reruns agree.

The rate is found from one row a source and weight; weights are read to the
nearest 64th, from 1/64 to 64, so a source has few. The cut of each source is
found without sorting it: sums over bins of the rank, then over finer bins
inside the bin that holds the cut, then the few different ranks of that finer
bin in order. Only one row a source is joined back to the documents, whose
texts are not shuffled. The sources themselves, one row each, are put in order
by one task: there may be thousands of them, not one for each document.

Null texts and those without words have size 0 and none of their words are
taken; a null source is a source of its own, the last. Null and repeated ids
are told apart by their texts; rows that repeat both are taken or left
together. Very long texts count whole; one may take its source past its target
by half its words. Equal ranks go by id and size. An empty table gives an empty
mix. ``mixed`` returns all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


#: The weight of a text grows by a quarter each 256 words, up to this many steps.
STEP_WORDS, STEPS = 256, 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """Of the open interval from 0 to 1, from 48 bits of the MD5 of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def length_weight(size: Column) -> Column:
    return 1.0 + F.least(F.floor(size / STEP_WORDS), F.lit(STEPS)).cast("double") * 0.25


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """s, source_size, target of each source, from its rows (s, source_size); one row a source."""
    by_name = W.partitionBy().orderBy(F.col("s").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most)
    by_fill = W.partitionBy().orderBy("fill", F.col("s").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, W.unboundedFollowing)
    open_ = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # fullest sources first: one is capped while the level that the open words would reach is above its cap
    level = sizes.withColumn("w", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("w")).withColumn("level", open_)
    stop = F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(W.partitionBy())
    return level.select("s", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * stop, F.col("cap"))).alias("target"))


def odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def rates(per_weight: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """s, source_size, target and rate of each source, from rows (s, weight, x words) and (s, source_size, target).

    Heaviest first: a weight is at its bound while the rate that the open words would need takes it above; the first that isn't gives the rate.
    """
    to = goal.select(F.col("s").alias("s2"), "source_size", "target")
    by_weight = W.partitionBy("s").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("x").over(by_weight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("x") * F.col("weight")).over(by_weight.rowsBetween(0, W.unboundedFollowing))
    both = per_weight.join(to, F.col("s").eqNullSafe(F.col("s2"))).withColumn("before", before).withColumn("rest", rest)
    both = both.withColumn("level", F.when(F.col("rest") > 0, (F.col("target") - F.lit(most) * F.col("before")) / F.col("rest")))
    free = F.when(F.col("level") * F.col("weight") <= most, F.col("weight"))
    found = both.groupBy("s").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max_by("level", free).alias("level"),
        (F.lit(most) / F.min("weight")).alias("full"))
    return found.select("s", "source_size", "target", F.when(F.col("source_size") > 0, F.coalesce("level", "full")).alias("rate"))


def ranked(rows: DataFrame, most: float) -> DataFrame:
    """Adds certain copies and the rank key of the extra copy (null: it has none) to rows with u, weight, rate."""
    expected = F.least(F.coalesce(F.col("rate") * F.col("weight"), F.lit(0.0)), F.lit(most))
    certain = F.floor(expected).cast("long")
    key = odds(F.col("u")) / odds(expected - certain)
    return rows.withColumn("certain", certain).withColumn("key", F.when((certain + 1 <= most) & (expected > certain), key)).withColumn("fine",
        F.floor(F.col("key") / (1 + F.col("key")) * (BINS * BINS)).cast("long"))


def _weight(weight_col: str | None, size: Column) -> Column:
    if not weight_col:
        return length_weight(size)
    own = F.coalesce(F.nanvl(F.col(weight_col).cast("double"), F.lit(None).cast("double")), F.lit(1.0))
    return F.round(F.least(F.greatest(own, F.lit(1 / 64)), F.lit(64.0)) * 64) / 64


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weight_col: str | None = None) -> DataFrame:
    """One row a source: s, source_size, target, rate, and the finer bin and key up to which an extra copy is taken."""
    text, size = F.col(text_col), words(F.col(text_col))
    small = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), size.alias("size"), uniform(F.col(id_col), text).alias("u"),
        _weight(weight_col, size).alias("weight")), "mix-sizes")
    per_weight = small.groupBy("s", "weight").agg(F.sum("size").alias("x"))
    goal = targets(per_weight.groupBy("s").agg(F.sum("x").alias("source_size")), weights, most)
    sources = stored(rates(per_weight, goal, most), "mix-sources", small=True)
    per = sources.select(F.col("s").alias("s2"), "target", "rate")
    rated = ranked(small.join(per, F.col("s").eqNullSafe(F.col("s2"))), most).withColumn("bin", F.floor(F.col("fine") / BINS).cast("long")).select("s", "id",
        "size", "certain", "key", "bin", "fine", "target")
    bins = rated.groupBy("s", "target", "bin").agg(F.sum(F.when(F.col("key").isNotNull(), F.col("size")).otherwise(0)).alias("x"),
        F.sum(F.col("size") * F.col("certain")).alias("sure"))
    by_s = W.partitionBy("s")
    run = by_s.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    left = F.col("target") - F.sum("sure").over(by_s)
    coarse = bins.withColumn("left", left).withColumn("upto", F.sum("x").over(run))
    holds = coarse.where(F.col("bin").isNotNull() & (F.col("upto") >= F.col("left"))).groupBy("s").agg(F.min(F.struct("bin",
        (F.col("upto") - F.col("x")).alias("before"), "left")).alias("c"))
    holds = holds.select(F.col("s").alias("s3"), F.col("c.bin").alias("b"), F.col("c.before").alias("before"), F.col("c.left").alias("left"))
    same = F.col("s").eqNullSafe(F.col("s3"))
    inside = rated.join(holds, same & (F.col("bin") == F.col("b"))).drop("s3")
    fine = inside.groupBy("s", "fine").agg(F.sum("size").alias("x"), F.first("before").alias("before"), F.first("left").alias("left"))
    fine = fine.withColumn("upto", F.col("before") + F.sum("x").over(by_s.orderBy("fine").rowsBetween(W.unboundedPreceding, W.currentRow)))
    spot = fine.where(F.col("upto") >= F.col("left")).groupBy("s").agg(F.min(F.struct("fine", (F.col("upto") - F.col("x")).alias("before"), "left")).alias("c"))
    spot = spot.select(F.col("s").alias("s3"), F.col("c.fine").alias("f"), F.col("c.before").alias("before"), F.col("c.left").alias("left"))
    last = rated.join(spot, same & (F.col("fine") == F.col("f"))).groupBy("s", "key", "id", "size").agg(F.count("*").alias("n"),
        F.first("before").alias("before"), F.first("left").alias("left"))
    order = by_s.orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order))
    # of the ranks at the cut: the first that is out, by the place of its middle word
    out = last.where(F.col("upto") - F.col("size") * F.col("n") / 2 > F.col("left")).groupBy("s").agg(F.min(F.struct("key", "id", "size")).alias("stop"))
    ends = spot.select(F.col("s3").alias("s"), "f").join(out.withColumnRenamed("s", "s3"), F.col("s").eqNullSafe(F.col("s3")),
        "left").select(F.col("s").alias("s4"), "f", "stop")
    return stored(sources.join(ends, F.col("s").eqNullSafe(F.col("s4")), "left").drop("s4"), "mix-plan", small=True)


def _with_copies(rows: DataFrame, plan_: DataFrame, most: float) -> DataFrame:
    """rows (id, s, size, u, weight and more) with what the plan has for their source (mix) and the copies to take."""
    per = plan_.select(F.struct("s", "source_size", "target", "f", "stop").alias("mix"), "rate", F.col("s").alias("of"))
    both = ranked(rows.join(per, F.col("s").eqNullSafe(F.col("of"))), most)
    before = F.struct("key", "id", "size") < F.col("mix.stop")
    within = F.when(F.col("mix.f").isNull(), F.lit(True)).when(F.col("fine") != F.col("mix.f"),
        F.col("fine") < F.col("mix.f")).otherwise(F.col("mix.stop").isNull() | before)
    return both.withColumn("copies", F.col("certain") + (F.col("key").isNotNull() & within).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weight_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of every document."""
    out = _with_copies(_read(docs, id_col, text_col, source_col, weight_col), plan(docs, weights, most, id_col, text_col, source_col, weight_col), most)
    return out.select(F.col("id").alias("doc_id"), "size", "mix.source_size", "mix.target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, all its columns."""
    out = _with_copies(_read(docs, id_col, text_col, source_col, weight_col, F.struct("*").alias("row")),
        plan(docs, weights, most, id_col, text_col, source_col, weight_col), most)
    return out.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def _read(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, *more: Column) -> DataFrame:
    text, size = F.col(text_col), words(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), size.alias("size"), uniform(F.col(id_col), text).alias("u"),
        _weight(weight_col, size).alias("weight"), *more)


#: The same mix, document by document, with the plain order of all ranks in place of bins.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
g AS (SELECT *, 1.0::DOUBLE + least(size // 256, 3)::DOUBLE * 0.25::DOUBLE AS weight FROM d),
z AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM z),
l AS (SELECT *, cap / w AS fill FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY fill, s NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT s, source_size, least(cap, coalesce(w * max(CASE WHEN fill >= level THEN level END) OVER (), cap)) AS target FROM v),
x AS (SELECT s, weight, sum(size)::DOUBLE AS x FROM g GROUP BY s, weight),
y AS (SELECT x.*, t.source_size, t.target, coalesce(sum(x) OVER (PARTITION BY x.s ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
             sum(x * weight) OVER (PARTITION BY x.s ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM x JOIN t ON x.s IS NOT DISTINCT FROM t.s),
h AS (SELECT *, CASE WHEN rest > 0 THEN (target - 3.0::DOUBLE * before) / rest END AS level FROM y),
k AS (SELECT s, first(source_size) AS source_size, first(target) AS target,
             CASE WHEN first(source_size) > 0 THEN coalesce(max_by(level, weight) FILTER (WHERE level * weight <= 3.0::DOUBLE), 3.0::DOUBLE / min(weight)) ELSE 0.0::DOUBLE END AS rate FROM h GROUP BY s),
r AS (SELECT g.*, k.source_size, k.target, least(k.rate * g.weight, 3.0::DOUBLE) AS e FROM g JOIN k ON g.s IS NOT DISTINCT FROM k.s),
c AS (SELECT *, floor(e)::BIGINT AS certain, CASE WHEN e > floor(e) THEN (u / (1.0 - u)) / ((e - floor(e)) / (1.0 - (e - floor(e)))) END AS key FROM r),
o AS (SELECT *, sum(CASE WHEN key IS NULL THEN 0 ELSE size END) OVER (PARTITION BY s ORDER BY key NULLS LAST, doc_id NULLS FIRST, size) AS upto,
             target - sum(size * certain) OVER (PARTITION BY s) AS open FROM c),
p AS (SELECT *, certain + CASE WHEN key IS NOT NULL AND upto - size / 2.0 <= open THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM p
"""
