"""Arrow batches in parts, so that what a Python worker holds at once depends neither on the rows of a batch nor on their length."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and bytes of text of a part; a longer text is a part of its own.
ROWS, BYTES = 256, 1 << 20
KINDS = {"string": pa.string(), "int": pa.int32()}


def parts(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches (nothing is copied) of at most ROWS rows and about BYTES bytes in the column at text."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            most = BYTES + (upto[start - 1] if start else 0)
            end = max(start + 1, min(start + ROWS, int(np.searchsorted(upto, most, side="right"))))
            yield b.slice(start, end - start)
            start = end


def rows_of_texts(docs: DataFrame, find: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    """(doc_id, i, *columns) of the rows that find makes of each text, numbered from 0; columns are strings and ints, as in a schema."""
    kinds = [KINDS[c.split()[1]] for c in columns.split(", ")]
    names = ["doc_id", "i", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [(d, i, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, r in enumerate(find(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [b.column(0).type, pa.int32(), *kinds], strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, i int, {columns}")
