"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest of id and text and numbered in
that order; a row's fractional rank is (number + phase) / rows of its source.
The phases of sources, in a seeded order, are evenly spaced between 0 and 1, so
that sources of few rows don't meet at one place. All rows in order of
fractional rank are cut into shards of equal numbers of rows: every shard has
its share of every source, to within about two rows, and shards differ by one
row at most (the law ``rows``).

Both numberings are range partitions with the sums of those before, then a
window inside each (``operators.rank.running_sums``): a hot source spreads over
as many tasks as it needs, and no task sorts a source. Sources are one row each,
joined by name; Spark broadcasts them only when they are small, and splits the
hot ones of a shuffled join. Texts are not shuffled to find the shards; only
``written`` moves them, once, to where they are written.

A null text has no bytes and the CRC of none; a null source is a source of its
own, the last. Null and repeated ids are told apart by their texts. Rows that
repeat id, text and source lie side by side, in no fixed order, with equal
results; equal texts of other ids are rows like all others: copies spread over
the shards as their sources do. Very long texts count as one row, so shards of
this law differ in bytes. An empty table has no rows and no shards. Columns
whose names clash with results are kept in ``written`` inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import running_sums
from .common import stored

SHARDS = 16


def bits(key: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def placed(rows: DataFrame, shards: int = SHARDS, seed: int = 0, tie: list[str] | None = None) -> DataFrame:
    """rows (s: source, h: shuffled key, and more) with shard and slot. tie: columns that order rows of one key."""
    kept = rows.columns
    inside = running_sums(rows, [F.col("s").asc_nulls_last(), F.col("h"), *(F.col(c).asc_nulls_first() for c in tie or [])], {"place": F.lit(1)})
    inside = stored(inside, "sharding-ranks")
    named = stored(inside.groupBy("s").agg(F.min("place").alias("first"), F.count("*").alias("rows")).withColumnRenamed("s", "s2").withColumn("turn",
        bits(F.concat(F.lit(f"{seed} "), F.coalesce("s2", F.lit(""))), 15)), "sharding-sources")
    sources = stored(running_sums(named, [F.col("turn"), F.col("s2").asc_nulls_last()], {"nth": F.lit(1)}).join(F.broadcast(named.agg(F.count("*").alias("m")))),
        "sharding-phases")  # joined to one row
    phase = (F.col("nth").cast("double") + 0.5) / F.col("m")
    share = ((F.col("place") - F.col("first")).cast("double") + phase) / F.col("rows")
    ranked = inside.join(sources, F.col("s").eqNullSafe(F.col("s2"))).withColumn("share", share).select(*kept, "share")
    ordered = running_sums(ranked, [F.col("share"), F.col("s").asc_nulls_last()], {"place": F.lit(1)})
    total = sources.agg(F.sum("rows").alias("total"))
    at = ordered.join(F.broadcast(total)).withColumn("shard", F.expr(f"cast(place * {shards} div total AS int)"))  # one row
    return at.withColumn("slot", F.expr(f"place - (shard * total + {shards - 1}) div {shards}")).select(*kept, "shard", "slot")


def read(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.lit(f"{seed} "), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), text)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("s"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), bits(key, 15).alias("h"), *more)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    rows = stored(read(docs, seed, id_col, text_col, source_col), "sharding-rows")
    out = placed(rows, shards, seed, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def written(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source") -> DataFrame:
    """Whole documents as Parquet under path, a folder for each shard, in order of slots over its files; returns the table (row, slot, shard) as read back."""
    rows = read(docs, seed, id_col, text_col, source_col, F.struct("*").alias("row"))
    out = placed(rows, shards, seed, ["doc_id", "size", "text_crc32"]).select("row", "slot", "shard")
    # ranges of shard and slot: a shard is several tasks, each of them one file of consecutive slots
    out.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


#: Ranks by plain windows over whole sources; CRC-32 by its table, bit by bit.
SHARDING_SQL = """
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, source AS s, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes,
             ('0x' || substr(md5('0 ' || coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
      FROM documents),
n AS (SELECT s, ((row_number() OVER (ORDER BY ('0x' || substr(md5('0 ' || coalesce(s, '')), 1, 15))::BIGINT, s NULLS LAST) - 1)::DOUBLE + 0.5) / count(*) OVER () AS phase
      FROM (SELECT DISTINCT s FROM b)),
d AS (SELECT b.*, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, t),
r AS (SELECT *, ((row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1)::DOUBLE + phase) / count(*) OVER (PARTITION BY s) AS share
      FROM (SELECT d.*, phase FROM d JOIN n ON n.s IS NOT DISTINCT FROM d.s)),
p AS (SELECT *, row_number() OVER (ORDER BY share, s NULLS LAST) - 1 AS place, count(*) OVER () AS total FROM r),
c AS (SELECT *, place * 16 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM c
"""
