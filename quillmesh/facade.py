"""One object with what a user asks of a corpus, each answer a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vectors
from .operators import aggregates, graphs, joins, rank
from .sources.catalog import Catalog


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.tables = Catalog(spark, folder)

    def search(self, question: str, k: int = 10) -> DataFrame:
        """Documents by BM25 of the question's keywords; without keywords, none."""
        row = self.tables.spark.range(1).select(tx.query_keywords(tx.clean_query(F.lit(question))).alias("k")).first()
        terms = list(row.k) or ["\x00"]
        return joins.bm25(self.tables.documents, terms, id_col="doc_id").orderBy(F.desc("score"), "doc_id").limit(k)

    def symbols(self, text: str, limit: int = 50) -> DataFrame:
        return rank.symbol_search(self.tables.nodes, text, limit)

    def hubs(self, k: int = 10, scope: str | None = None) -> DataFrame:
        return aggregates.hub_files(self.tables.nodes, self.tables.edges, k, scope)

    def impact(self, node: str, hops: int = 2, most: int = 30) -> DataFrame:
        start = self.tables.spark.createDataFrame([(node,)], "id string")
        return graphs.impact(self.tables.edges.select("source", "target"), start, hops, most)

    def audit(self, analyzers: list[str] | None = None) -> DataFrame:
        """Findings of the named analyzers, of all eleven by default."""
        from .plans.audit_queries import findings

        return findings(self.tables, analyzers)

    def similar(self, vector: list[float], k: int = 50) -> DataFrame:
        """(doc_id, score, embedding) of the k documents whose vectors are nearest by inner product."""
        scored = self.tables.vectors.select(F.col("vec_id").alias("doc_id"), vectors.dot(F.col("embedding"), F.array(*map(F.lit, vector))).alias("score"),
            "embedding")
        return scored.orderBy(F.desc("score"), "doc_id").limit(k)

    def context(self, question: str, vector: list[float], k: int = 10, budget: int = 6000, ratio: float = 0.4, balance: float = 0.7) -> DataFrame:
        """Hybrid retrieval: words and vectors fused, cut where scores fall, made diverse, joined by their neighbours in the same source, within a budget of characters.

        doc_id, place, score, why (found or neighbour) and taken (characters). What is searched is every document; only the k * 5 best of each leg go on.
        """
        legs = self.search(question, 5 * k).select("doc_id", F.lit("words").alias("leg"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("r"))
        near = self.similar(vector, 5 * k)
        ranked = near.select("doc_id", F.lit("vectors").alias("leg"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("r"))
        fused = legs.unionByName(ranked).groupBy("doc_id").agg(F.sum(1.0 / (60 + F.col("r"))).alias("score"))
        kept_ = rank.adaptive_cut(fused.withColumn("q", F.lit(0)), ["q"], "score", "doc_id", ratio, 3 * k)
        rows = kept_.join(self.tables.vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id").select("q",
            F.col("doc_id").alias("id"), "score", "vec")
        found = vectors.diverse(rows, "q", k, balance).select(F.col("id").alias("doc_id"), "place").join(fused, "doc_id").withColumn("why", F.lit("found"))
        side = self.tables.files.join(found.select("doc_id"), "doc_id").select("source", F.col("doc_id").alias("of"))
        beside = self.tables.files.select("doc_id", "source").join(side,
            "source").where("doc_id != of AND abs(doc_id - of) <= 1").select("doc_id").distinct().join(found.select("doc_id"), "doc_id", "left_anti")
        whole = found.unionByName(beside.select("doc_id", F.lit(k + 1).alias("place"), F.lit(0.0).alias("score"), F.lit("neighbour").alias("why")))
        sized = whole.join(self.tables.files.select("doc_id", "size"), "doc_id").withColumn("q", F.lit(0))
        return vectors.within_budget(sized, "q", ["place", "doc_id"], "size", budget).select("doc_id", "place", F.round("score", 6).alias("score"), "why",
            "taken")

    def consensus(self, least: int = 2) -> DataFrame:
        return aggregates.consensus(self.tables.observations, least)

    def concepts(self, status: str = "active") -> DataFrame:
        return self.tables.concepts.where(F.col("status") == status)


class Registry:
    """Named implementations of an extension point."""

    def __init__(self, **known: Callable):
        self.known = dict(known)

    def add(self, name: str, f: Callable) -> None:
        self.known[name] = f

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"unknown: {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name]
