"""What a user asks of a corpus, in SQL: logical tables as views, questions as table functions.

``register`` adds to a session the views of a folder, SQL functions that read them (``search_documents``, ``hubs``, ``impact``, ``concepts_of``),
and three Python table functions for what a row or an ordered group needs: ``parse_code`` (by the row's own language), ``audit_text`` and
``validity``, which takes any table argument with PARTITION BY and ORDER BY and returns its columns with the interval that each row is valid for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, OrderingColumn

from .sources.catalog import BASE, TABLES, Catalog


@udtf(returnType="part string, kind string, name string, target string, start_line int, end_line int")
class ParseCode:
    """Nodes and edges of a text in a language; languages that no parser knows have none."""

    def eval(self, text: str, language: str) -> Iterator[tuple]:
        from .operators import braces, parsing

        if text is None or language is None:
            return
        if language == "python":
            yield from parsing.python_rows(text)
        elif language in braces.LANGUAGES:
            for row in braces.declared(text, braces.LANGUAGES[language]):
                yield tuple(row[:6])


CHECKS = {
    "mark of work left": r"\b(?:TODO|FIXME|HACK|XXX)\b",
    "debug output": r"\b(?:console\.log|print|println!)\(",
    "wide exception": r"\bexcept\s*(?:Exception\s*)?:",
}


@udtf(returnType="line int, finding string, excerpt string")
class AuditText:
    """Lines of a text that a check finds."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, line in enumerate((text or "").split("\n"), 1):
            for name, pattern in CHECKS.items():
                if re.search(pattern, line):
                    yield i, name, line.strip()[:200]


@udtf
class Validity:
    """Each row of a group in the order of its time, valid until the next one of other content; rows of the same content in a row are one."""

    @staticmethod
    def analyze(table: AnalyzeArgument, at: AnalyzeArgument, content: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("validity(TABLE(t), time column, content column, key column)")
        names = [f.name for f in table.dataType.fields]
        for column in (at.value, content.value, key.value):
            if column not in names:
                raise ValueError(f"no column {column}; there are {', '.join(names)}")
        fields = [f for f in table.dataType.fields if f.name not in ("valid_from", "valid_to")]
        return AnalyzeResult(StructType([*fields, StructField("valid_from", TimestampNTZType()), StructField("valid_to", TimestampNTZType())]),
            partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(at.value)])

    def __init__(self) -> None:
        self.open: list[Any] | None = None
        self.since = self.content = None

    def eval(self, row: Row, at: str, content: str, key: str) -> Iterator[tuple]:
        if self.open is not None and row[content] == self.content:
            return
        if self.open is not None:
            yield (*self.open, self.since, row[at])
        self.open = [row[f] for f in row.__fields__ if f not in ("valid_from", "valid_to")]
        self.since, self.content = row[at], row[content]

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield (*self.open, self.since, None)


#: Questions as SQL over the views; {p} stands before each view's name.
FUNCTIONS = {
    "search_documents": ("question STRING, k INT", "doc_id BIGINT, score DOUBLE", """
        SELECT doc_id, score FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (
          SELECT doc_id, round(sum(ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * words / average))), 6) AS score FROM (
            SELECT d.doc_id, d.words, d.tf, count(*) OVER (PARTITION BY term) AS df, n, average FROM (
              SELECT doc_id, size(w) AS words, term, size(filter(w, x -> x = term)) AS tf FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS w FROM {p}documents)
              LATERAL VIEW explode(array_distinct(filter(regexp_extract_all(lower(question), '([a-z0-9_]+)', 1), x -> length(x) > 2))) t AS term) d
            CROSS JOIN (SELECT count(*) AS n, avg(size(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))) AS average FROM {p}documents) WHERE tf > 0)
          GROUP BY doc_id)) WHERE r <= k"""),
    "hubs": ("k INT", "file_path STRING, in_degree BIGINT", """
        SELECT file_path, in_degree FROM (SELECT file_path, in_degree, row_number() OVER (ORDER BY in_degree DESC, file_path) AS r FROM (
          SELECT t.file_path, count(*) AS in_degree FROM {p}edges e JOIN {p}nodes t ON t.id = e.target WHERE origin <> 'external' GROUP BY t.file_path)) WHERE r <= k"""),
    "impact": ("node STRING", "id STRING, hops INT", """
        SELECT id, min(hops) AS hops FROM (SELECT source AS id, 1 AS hops FROM {p}edges WHERE target = node
          UNION ALL SELECT b.source, 2 FROM {p}edges a JOIN {p}edges b ON b.target = a.source WHERE a.target = node) WHERE id <> node GROUP BY id"""),
    "concepts_of": ("state STRING, least DOUBLE", "id BIGINT, title STRING, confidence DOUBLE", """
        SELECT id, title, confidence FROM {p}concepts WHERE status = state AND confidence >= least"""),
}


def register(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Adds the views and functions of a folder's corpus to a session; returns the functions' names. prefix: before each name, where several corpora share a session."""
    tables = Catalog(spark, folder)
    for name in [*BASE, *TABLES]:
        getattr(tables, name).createOrReplaceTempView(prefix + name)
    for name, f in {"parse_code": ParseCode, "audit_text": AuditText, "validity": Validity}.items():
        spark.udtf.register(prefix + name, f)
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURNS TABLE ({gives}) RETURN {body.format(p=prefix)}")
    return [prefix + n for n in ("parse_code", "audit_text", "validity", *FUNCTIONS)]
