"""Python steps hold a part of an Arrow batch at once, not a whole one."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from quillmesh.functions import vectors
from quillmesh.operators import braces, content, parsing
from quillmesh.plans import registry


class Docs:
    """Stands for a DataFrame: gives the function that mapInArrow would run in a worker."""

    schema = StructType().add("doc_id", "long").add("path", "string").add("text", "string")

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def sizes(run, texts, ids=None):
    batch = pa.RecordBatch.from_arrays([pa.array(ids or range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    return [b.num_rows for b in run(iter([batch]))]


def plain(n):
    return [f"# a\nbody {i}" for i in range(n)]


@pytest.mark.parametrize("step", [content.markdown_sections, content.markdown_chunks, content.semantic_parts])
def test_markdown_in_parts(step):
    assert sizes(step(Docs()), plain(600)) == [256, 256, 88]


def test_long_texts_are_parts_of_their_own():
    from quillmesh.functions.batches import BYTES, parts

    texts = ["a", "b" * (2 * BYTES), None, "c" * (BYTES - 1), "d", "", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    got = list(parts([batch, batch.slice(0, 0), batch.slice(2, 3)]))
    assert [b.num_rows for b in got] == [1, 1, 4, 1, 3]
    assert [t for b in got for t in b.column(1).to_pylist()] == texts + texts[2:5]


def test_python_files_in_parts():
    files = [f"class A{i}:\n    pass" for i in range(600)]
    assert sizes(parsing.python_graph(Docs()), files, [f"{i}.py" for i in range(600)]) == [512, 512, 176]


@pytest.mark.parametrize("level", ["2", "2.5", "3", "4"])
def test_skeletons_in_parts(level):
    files = [f"class A{i}:\n    pass" for i in range(600)]
    assert sizes(parsing.skeletons(Docs(), level), files, [f"{i}.py" for i in range(600)]) == [256, 256, 88]


def test_fake_vectors_take_their_own_room_alone():
    texts = pa.array(["a" * 20_000 + str(i) for i in range(500)] + [None])
    tracemalloc.start()
    got = vectors.fake_rows(texts, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [vectors.fake_row(t, 64).tolist() for t in texts.to_pylist()]
    assert peak < 2_000_000  # the texts are 10 MB


def test_patterns_in_parts(spark):
    from quillmesh.operators import patterns

    class Here(Docs):
        sparkSession = spark  # noqa: N815

    table = spark.createDataFrame([(1, "body")], "pattern long, words string")
    assert sizes(patterns.occurrences(Here(), table), plain(600)) == [256, 256, 88]


class Files(Docs):
    """The same for files with a language; all of them have one that is parsed."""

    def where(self, *_):
        return self


def test_brace_files_in_parts(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.rs" for i in range(600)]), pa.array(["rust"] * 600), pa.array([f"fn f{i}() {{ g(); }}" for i in range(600)])], ["path", "language", "text"])
    assert [b.num_rows for b in braces.graph(Files())(iter([batch]))] == [768, 768, 264]


@pytest.mark.parametrize("name, parsed_again", [("gen_parse_parallel", 1), ("lod_rust", 0)])
def test_brace_files_are_parsed_once(spark, name, parsed_again):
    """What is read several times is stored; only the Python files, which are read once, are parsed as they are read."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == parsed_again
