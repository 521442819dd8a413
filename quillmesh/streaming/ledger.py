"""A log of activity and a bus of events over one stream: several sinks, each row once, whatever is run again.

A batch's rows go to partitions of their day, query and batch under each sink, and overwrite just those: a batch that is run again, after a lost
driver or by hand, replaces itself. Reads name days, so only those folders are listed; old days are dropped as folders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

PARTS = ["day", "query", "batch"]


class Ledger:
    """Sinks by name, with the rows that each takes (a condition on the columns of the stream, one of which is ts)."""

    def __init__(self, spark: SparkSession, path: str, sinks: dict[str, Column]):
        self.spark, self.path, self.sinks = spark, path.rstrip("/"), sinks

    def put(self, query: str) -> Callable[[DataFrame, int], None]:
        """What a stream of that name does with each batch."""

        def write(batch: DataFrame, n: int) -> None:
            rows = batch.withColumn("day", F.to_date("ts")).withColumn("query", F.lit(query)).withColumn("batch", F.lit(n).cast("long"))
            rows.persist()
            try:
                for name, takes in self.sinks.items():
                    out = rows.where(takes).repartition("day")  # a file a day and batch
                    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{self.path}/{name}")
            finally:
                rows.unpersist()

        return write

    def follow(self, stream: DataFrame, query: str) -> None:
        """Takes in all that the stream has, and remembers how far it came."""
        flow = stream.writeStream.foreachBatch(self.put(query)).option("checkpointLocation", f"{self.path}/_checkpoints/{query}").trigger(availableNow=True).start()
        flow.awaitTermination()

    def read(self, sink: str, since: date | None = None) -> DataFrame:
        """The rows of a sink; since: of that day and later, whose folders alone are listed."""
        rows = self.spark.read.parquet(f"{self.path}/{sink}")
        return rows if since is None else rows.where(F.col("day") >= F.lit(since))

    def recent(self, sink: str, condition: Column, most: int, since: date | None = None, tie: str = "event_id") -> DataFrame:
        """The newest rows."""
        return self.read(sink, since).where(condition).orderBy(F.desc("ts"), F.desc(tie)).limit(most)

    def prune(self, sink: str, today: date, days: int = 30) -> list[date]:
        """Drops the days that are older than so many; returns them."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sink}")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for status in files.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("day=") and "=__" not in name and (day := date.fromisoformat(name[4:])) < today - timedelta(days):
                files.delete(status.getPath(), True)
                gone.append(day)
        return sorted(gone)


def fresh(spark: SparkSession, sinks: dict[str, Column]) -> Ledger:
    return Ledger(spark, scratch_path(spark, "ledger"), sinks)
