"""Shared by the vector operators: which vectors take part, and blocks of them as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of float64 from a list column whose lists all have dim members."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: Numbers that a sample brings to the driver at most: 32 MB.
SAMPLE_VALUES = 1 << 22


def bounded_sample(df: DataFrame, id_col: str, rows: int, dim: int) -> pa.Table:
    """The rows rows of least id hash, fewer of long vectors: the same for the same table."""
    most = max(1, min(rows, SAMPLE_VALUES // max(dim, 1)))
    return df.withColumn("__h", F.xxhash64(F.col(id_col), F.lit("sample"))).orderBy("__h").limit(most).drop("__h").toArrow()
