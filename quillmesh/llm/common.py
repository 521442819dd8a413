"""Shared pieces of the training-data operators: scratch tables, folds, batching."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import few, kept, scratch_path, shared_dir  # noqa: F401  for the operators here
from ..sources.shipping import ship

#: Characters of text that one call into a tokenizer or feature loop sees at once.
SLICE_CHARS = 1_000_000
#: Bytes of a table, as the optimizer expects them, that one task may write.
TASK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """A table in the shared folder, which cuts the lineage and survives lost executors.

    small: what comes of an aggregation or a search, not the input's own rows. Such tables, and those that the
    optimizer expects to give every core's second task less than TASK_BYTES, are written in few files.
    """
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return kept(df, tag, small or expected <= TASK_BYTES * 2 * df.sparkSession.sparkContext.defaultParallelism)


_caches: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called by an operator as its task begins in a worker: what other operators remember there is dropped first."""
    for other in [k for k in _caches if k != name]:
        _caches.pop(other)()
    _caches[name] = clear


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a run of very long texts can't fill a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id) == 2


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts of about limit characters."""
    start = seen = 0
    for i, t in enumerate(texts):
        seen += len(t or "") + 16
        if seen >= limit:
            yield start, i + 1
            start, seen = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with one function made per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.mapInArrow(run, schema)
