"""Scores of files for roles, and role vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the role score, and words that mean much the same.
ROLE_WEIGHTS = {"layer": 0.25, "tags": 0.30, "audience": 0.10, "centrality": 0.20, "confidence": 0.15}
SYNONYMS = [
    ["ui", "presentation", "frontend", "component", "view", "layout", "widget"],
    ["api", "endpoint", "route", "handler", "controller", "rest", "graphql"],
    ["auth", "authentication", "authorization", "permission", "security", "token", "credential"],
    ["data", "database", "persistence", "storage", "model", "schema", "orm", "migration"],
    ["deploy", "infrastructure", "devops", "ci-cd", "docker", "kubernetes", "helm", "terraform"],
    ["test", "testing", "spec", "qa", "quality", "coverage", "e2e"],
    ["build", "compile", "bundle", "webpack", "vite", "toolchain", "packaging"],
    ["docs", "documentation", "readme", "guide", "reference", "wiki"],
    ["state", "state-management", "store", "context", "redux", "zustand"],
    ["style", "css", "theme", "design-system", "design-token", "styling", "sass"],
    ["monitoring", "observability", "logging", "metrics", "tracing", "telemetry"],
    ["ml", "machine-learning", "ai", "model-training", "inference", "embedding"],
]
# What is left of a score after an event.
DECAY = {"source_changed": 0.0, "neighbor_enriched": 0.95, "doc_updated": 0.90, "trace_rebuilt": 0.80, "module_resynthesized": 0.97}


def cluster(tag: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for i, words in enumerate(SYNONYMS) for w in words for x in (w, i)))
    return F.element_at(pairs, tag)


def synonyms(a: Column, b: Column) -> Column:
    return F.coalesce(cluster(a) == cluster(b), F.lit(False))


def affinity(tags: Column, words: Column) -> Column:
    """The best match of any tag with any word: equal 1, one inside the other 0.7, synonyms 0.5."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[-_]", " ")

    def one(t: Column, w: Column) -> Column:
        a, b = plain(t), plain(w)
        same = synonyms(F.regexp_replace(a, " ", "-"), F.regexp_replace(b, " ", "-"))
        return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7).when(same, 0.5).otherwise(0.0)

    return F.coalesce(F.array_max(F.flatten(F.transform(tags, lambda t: F.transform(words, lambda w: one(t, w))))), F.lit(0.0))


def audience(tags: Column, of_tag: Column, role: str) -> Column:
    """Share of tags whose audience, by the map of_tag, holds the role."""
    n = F.size(F.filter(tags, lambda t: F.coalesce(F.array_contains(F.element_at(of_tag, F.regexp_replace(F.lower(t), "_", "-")), role), F.lit(False))))
    return F.when(F.size(tags) == 0, 0.0).otherwise(n / F.size(tags))


def relevance(layer: Column, tags: Column, audience_: Column, degree: Column, most: Column, confidence: Column, layers: dict[str, float], words: list[str],
    centrality: float) -> Column:
    weights = F.create_map(*(F.lit(x) for kv in layers.items() for x in kv))
    central = F.when(most > 0, F.least(F.lit(1.0), degree / F.greatest(F.lit(1.0), most * 0.3))).otherwise(0.0) * centrality
    w = ROLE_WEIGHTS
    total = w["layer"] * F.coalesce(F.element_at(weights, layer), F.lit(0.1)) + w["tags"] * affinity(tags,
        F.array(*map(F.lit, words))) + w["audience"] * audience_ + w["centrality"] * central + w["confidence"] * F.greatest(F.lit(0.0),
        F.least(F.lit(1.0), confidence))
    return F.round(F.least(F.lit(1.0), total), 4)


def blended(weights: DataFrame) -> DataFrame:
    """Weighted means per layer of role vectors (role, share, layer, weight); layers a role lacks count as zero."""
    total = weights.select("role", "share").distinct().agg(F.sum("share").alias("all"))
    return weights.groupBy("layer").agg(F.sum(F.col("share") * F.col("weight")).alias("s")).join(F.broadcast(total)).select("layer",
        F.round(F.col("s") / F.col("all"), 6).alias("weight"))


def term_idf(terms: DataFrame) -> DataFrame:
    """1 over the square root of the number of roles that hold a term."""
    return terms.groupBy("term").agg((1 / F.sqrt(F.countDistinct("role"))).alias("idf"))


def decayed(score: Column, event: Column) -> Column:
    factor = F.element_at(F.create_map(*(F.lit(x) for kv in DECAY.items() for x in kv)), event)
    return F.when(factor.isNull(), score).otherwise(F.round(score * factor, 3))


def atlas_budget(files: Column) -> Column:
    ramp = F.when(files < 2, 0).when(files <= 50, 1200).when(files <= 200, 1200 + (files - 50) * 6).when(files <= 1000,
        F.floor(2100 + (files - 200) * 1.5)).otherwise(F.floor(3300 + (files - 1000) * 0.35))
    return F.least(F.lit(4000), ramp).cast("long")


def root_budget(files: Column) -> Column:
    full = atlas_budget(files)
    return F.when(full <= 0, 0).otherwise(F.greatest(F.lit(1200), F.least(F.lit(2500), F.floor(full * 0.55)))).cast("long")


def modified(weight: Column, key: str, modifiers: dict[str, tuple[float, float]]) -> Column:
    """weight scaled and shifted by what its row's key asks for, within 0 and 1."""
    out = F.when(F.lit(False), weight)
    for name, (scale, shift) in modifiers.items():
        out = out.when(F.col(key) == name, weight * scale + shift)
    return F.least(F.greatest(out.otherwise(weight), F.lit(0.0)), F.lit(1.0))


def resolved(items: DataFrame, by_anchor: DataFrame, by_module: DataFrame, default: str = "default") -> DataFrame:
    """(id, role, by) of items (id, a1, module): the role of the anchor goes before that of the module, and both before the default."""
    both = items.join(by_anchor.withColumnRenamed("role", "ra"), "a1", "left").join(by_module.withColumnRenamed("role", "rm"), "module", "left")
    by = F.when(F.col("ra").isNotNull(), "anchor").when(F.col("rm").isNotNull(), "module").otherwise("default")
    return both.select("id", F.coalesce("ra", "rm", F.lit(default)).alias("role"), by.alias("by"))
