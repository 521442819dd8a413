"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session without one gets a folder of its own: elsewhere executors would not see it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
        found = sc.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def few(df: DataFrame, times: int = 2) -> DataFrame:
    """In no more partitions than a small multiple of the cluster's cores: for rows that are narrow or few."""
    return df.coalesce(max(2, times * df.sparkSession.sparkContext.defaultParallelism))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """By keys in all of the session's shuffle partitions, which Spark then doesn't join to fewer: for rows that take far more room in a task's maps than in a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kept(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Writes df once and reads it back, which cuts its lineage and survives lost executors; small: in few files."""
    path = scratch_path(df.sparkSession, tag)
    (few(df) if small else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a kept table that nothing reads any more: the round before the last of an iteration."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_scratch", None)
    if path:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
