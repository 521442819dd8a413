"""A paged source of issues, read from pages saved as JSON: one partition a page, through Spark's Python data source interface."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "number bigint, title string, category string, priority string, state string"
# Labels and what they say of an issue.
CATEGORIES = {"bug": "bug", "enhancement": "feature", "documentation": "docs", "security": "security"}
PRIORITIES = {"critical": "P0", "high": "P1", "low": "P3"}


class Page(InputPartition):
    def __init__(self, body: str):
        self.body = body


class PagedReader(DataSourceReader):
    def __init__(self, pages: list[str]):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in self.pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for issue in json.loads(partition.body):
            labels = [str(x).lower() for x in issue.get("labels", [])]
            category = next((CATEGORIES[x] for x in labels if x in CATEGORIES), "feature")
            priority = next((PRIORITIES[x] for x in labels if x in PRIORITIES), "P2")
            yield issue["number"], issue.get("title", ""), category, priority, issue.get("state", "open")


class PagedIssues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_issues"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(json.loads(self.options["pages"]))


def issues(spark: SparkSession, pages: list[list[dict]]) -> DataFrame:
    """Rows of all pages; a fetcher with network access passes what it got, page by page."""
    spark.dataSource.register(PagedIssues)
    return spark.read.format("paged_issues").option("pages", json.dumps([json.dumps(p) for p in pages])).load()
