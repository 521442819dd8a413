"""Writing, pruning, upserting and exporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """Writes with the committer's all-or-nothing rename and reads back with the same schema."""
    path = scratch_path(df.sparkSession, f"sink-{kind}")
    df.write.format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def prune(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def evict(rows: DataFrame, keep: int) -> DataFrame:
    """Each project keeps its keep newest rows, stale ones going first; this cap is the feature."""
    w = W.partitionBy("project_id").orderBy("stale", F.desc("created_at"), F.desc("id"))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def manifest(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(F.lit(name).alias("name"), "n", "bytes")


def markdown(items: DataFrame, most: int) -> DataFrame:
    """A section a category with its first most items; this cap is the feature."""
    w = W.partitionBy("category").orderBy("id")
    some = items.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    line = F.struct("id", F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(" "), F.col("file_path")).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"])
    return some.groupBy("category").agg(F.concat(F.lit("## "), F.first("category"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def sarif(items: DataFrame) -> DataFrame:
    """One SARIF result a row, as JSON."""
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.concat(F.lit("rule/"), "category").alias("ruleId"), level.alias("level"),
        F.struct(F.concat_ws(" ", "analyzer", "category").alias("text")).alias("message"), place.alias("locations"))
    return items.select("id", F.to_json(result).alias("result"))


def sarif_document(spark: SparkSession, path: str, results: DataFrame, tool: str) -> DataFrame:
    """Writes a SARIF document in parts that read as one in file order: head, a result a line, tail. Rows (part, line) come back from what was written."""
    head = f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    first = results.agg(F.min("id")).first()[0]
    body = results.orderBy("id").select(F.concat(F.when(F.col("id") == first, "").otherwise(","), "result").alias("line"))
    for part, rows in (("1-head", spark.createDataFrame([(head,)], "line string")), ("2-results", body),
        ("3-tail", spark.createDataFrame([("]}]}",)], "line string"))):
        rows.write.text(f"{path}/part={part}")
    return spark.read.schema("value string, part string").text(path).select("part", F.col("value").alias("line"))


def vectors_mode(spark: SparkSession, path: str, now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Writes a vector index (vec_id, embedding, hash): full without one before, noop if nothing changed, else incremental: unchanged rows are taken over, changed and new ones replaced. Returns the index with its mode."""
    if before is None:
        out, mode = now, "full"
    else:
        changed = now.join(before.select("vec_id", F.col("hash").alias("old")), "vec_id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).drop("old")
        gone = before.join(now.select("vec_id"), "vec_id", "left_anti")
        mode = "noop" if changed.isEmpty() and gone.isEmpty() else "incremental"
        out = before if mode == "noop" else before.join(now.select("vec_id"), "vec_id", "left_semi").join(changed.select("vec_id"), "vec_id",
            "left_anti").unionByName(changed)
    out.withColumn("mode", F.lit(mode)).write.parquet(path)
    return spark.read.parquet(path)
