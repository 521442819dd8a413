"""Row filters and per-row projections of the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def by_globs(files: DataFrame, include: list[str], exclude: list[str], col: str = "path") -> DataFrame:
    return files.where(paths.included(F.col(col), include, exclude))


def in_scopes(files: DataFrame, scopes: DataFrame, col: str = "path") -> DataFrame:
    """Rows at or under any scope: a path's ancestors are joined to the scopes by equality, not by a range."""
    parts = F.split(col, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = files.select(col, F.explode(ancestors).alias("scope")).join(scopes, "scope", "left_semi").select(col).distinct()
    return files.join(hits, col, "left_semi")


def blocked(files: DataFrame, globs: list[str], col: str = "path") -> DataFrame:
    """Case is ignored, so that no spelling slips through."""
    return files.where(paths.any_glob(F.lower(F.col(col)), [g.lower() for g in globs]))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "P0", 0).when(priority == "P1", 1).when(priority == "P2", 2).when(priority == "P3", 3).otherwise(9)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(9)


def opportunities(items: DataFrame, categories: list[str] | None = None, sources: list[str] | None = None, least_priority: str | None = None,
    dismissed: bool = False) -> DataFrame:
    out = items if dismissed else items.where(~F.col("dismissed"))
    if categories:
        out = out.where(F.col("category").isin(categories))
    if sources:
        out = out.where(F.col("source").isin(sources))
    if least_priority:
        out = out.where(priority_rank(F.col("priority")) <= priority_rank(F.lit(least_priority)))
    return out


def log_page(log: DataFrame, kind: str | None, since: str | None, until: str | None, limit: int, offset: int) -> DataFrame:
    """A page of an event log, newest first; this limit is the feature."""
    out = log
    if kind:
        out = out.where(F.col("event_type") == kind)
    if since:
        out = out.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        out = out.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return out.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)


def context_tier(budget: Column) -> Column:
    return F.when(budget >= 40_000, F.lit(1.0)).when(budget >= 22_000, F.lit(2.0)).otherwise(F.lit(2.5))


def level_of_detail(score: Column, expanded: Column) -> Column:
    return F.when(expanded, 4).when(score >= 0.5, 0).when(score >= 0.35, 2).when(score >= 0.2, 4).otherwise(5)


def drift(score: Column) -> Column:
    return F.when(score > 0.8, "healthy").when(score > 0.6, "minor").when(score > 0.4, "significant").otherwise("critical")


def significance(category: Column, consensus: Column, hubs: Column, confidence: Column) -> Column:
    return F.when((category == "security") | (consensus > 0.5), "mandatory").when((confidence == "low") & (hubs == 0), "informational").otherwise("recommended")


def hub_severity(degree: Column, z: Column) -> Column:
    return F.when((z >= 4) | (degree >= 20), "critical").when((z >= 3) | (degree >= 15), "high").when((z >= 2) | (degree >= 8), "moderate").otherwise("low")


def cycle_severity(size: Column) -> Column:
    return F.when(size >= 6, "high").when(size >= 3, "moderate").otherwise("low")


def churn_class(commits: Column, authors: Column) -> Column:
    """Files without commits in the window are unknown."""
    return F.when(commits.isNull(), "unknown").when(commits < 3, "stable").when(commits <= 15, "evolving").when(authors >= 3, "fragile").otherwise("evolving")


def finding_ids(findings: DataFrame, prefix: str = "f-") -> DataFrame:
    """Priority from severity and an id from the digest of what identifies a finding, its paths in order."""
    priority = F.when(F.col("severity") == "critical", "P0").when(F.col("severity") == "warning", "P1").when(F.col("severity") == "info", "P2").otherwise("P3")
    identity = F.concat_ws("|", "analyzer", "category", F.array_join(F.array_sort("paths"), ","))
    return findings.withColumn("priority", priority).withColumn("finding_id", F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, 8)))


def gate(confidence: Column, high: float, low: float) -> Column:
    if low > high:
        raise ValueError("low must not exceed high")
    return F.when(confidence >= high, "active").when(confidence >= low, "triage").otherwise("archive")


def triage(concepts: DataFrame, clusters: DataFrame, archive_below: float) -> DataFrame:
    """Members of a cluster that aren't its representative become shadows; lone ones without anchors and confidence are archived."""
    shadow = F.col("representative").isNotNull() & (F.col("id") != F.col("representative"))
    alone = F.col("representative").isNull() & (F.col("confidence") < archive_below) & (F.size("anchors") == 0)
    return concepts.join(clusters, "id", "left").withColumn("action", F.when(shadow, "shadow").when(alone, "archive").otherwise("keep"))
