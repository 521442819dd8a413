"""Thousands of patterns sought in one pass over texts: an automaton that a worker builds once of a table of patterns.

Patterns are taken to the workers in parts of at most ``PART`` characters, so that what is broadcast is bounded; more of them cost more passes.
Texts and patterns are compared in lower case; a hit begins and ends where a word does, unless stems are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import parts as parts_of

#: Characters of the patterns that one pass takes along.
PART = 4_000_000
WORD = re.compile(r"\w")

_built: dict[int, ahocorasick.Automaton] = {}


def automaton(token: int, patterns: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """The automaton of a pass, built by each worker once."""
    if token not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        ids: dict[str, list[int]] = {}
        for i, p in patterns:
            ids.setdefault(p, []).append(i)
        for p, own in ids.items():
            made.add_word(p, (len(p), own))
        made.make_automaton()
        _built[token] = made
    return _built[token]


def hits(text: str, found: ahocorasick.Automaton, bounds: bool = True) -> dict[int, tuple[int, int]]:
    """Of each pattern in a text: how often, and where first (characters from 0)."""
    low, out = text.lower(), {}
    for end, (size, ids) in found.iter(low):
        start = end - size + 1
        begins = not start or not (WORD.match(low[start]) and WORD.match(low[start - 1]))
        ends = end + 1 == len(low) or not (WORD.match(low[end]) and WORD.match(low[end + 1]))
        if not bounds or begins and ends:
            for i in ids:
                n, first = out.get(i, (0, start))
                out[i] = n + 1, min(first, start)
    return out


def occurrences(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: bool = True) -> DataFrame:
    """(id_col, pattern, n, first) of every pattern (pattern: a number, words) in every text; empty ones are never met. bounds: only where a word begins and ends."""
    usable = patterns.select(F.col("pattern").cast("long").alias("pattern"), F.lower("words").alias("words")).where("words <> ''")
    size = usable.agg(F.sum(F.length("words") + 8)).first()[0] or 0
    kind = docs.schema[id_col].dataType.simpleString()
    schema, out = f"{id_col} {kind}, pattern bigint, n bigint, first bigint", None
    for part in range(parts := max(1, -(-size // PART))):
        # a hash deals patterns into parts of about PART characters
        own = usable.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).toArrow()
        taken = list(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True))
        sent, token = docs.sparkSession.sparkContext.broadcast(taken), id(own)

        def run(batches: Iterable[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            for b in parts_of(batches):
                if not sent.value:
                    return
                found = automaton(token, sent.value)
                rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for x in ((p, *v) for p, v in hits(t, found, bounds).items())]
                if rows:
                    ids, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *(pa.array(c, pa.int64()) for c in rest)], [id_col, "pattern", "n", "first"])

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def mined(docs: DataFrame, keywords: DataFrame, most: int = 20) -> DataFrame:
    """The first most documents (path, text) in order of path that name a keyword (pattern: its rank, words): id, path, line, keyword, title, note of the best ranked one on the first line that has any."""
    met = occurrences(docs, keywords, "path", bounds=False)
    first = met.groupBy("path").agg(F.min("first").alias("first"))
    lines = docs.join(first, "path").withColumn("before", F.substring("text", F.lit(1), F.col("first")))
    line = F.length("before") - F.length(F.replace("before", F.lit("\n"), F.lit(""))) + 1
    on = lines.withColumn("line", line).withColumn("note", F.trim(F.element_at(F.split("text", "\n"), F.col("line")))).select("path", "line", "note")
    top = on.orderBy("path").limit(most)
    best = occurrences(top.withColumnRenamed("note", "text"), keywords, "path", bounds=False).groupBy("path").agg(F.min("pattern").alias("pattern"))
    named = top.join(best, "path").join(keywords.select("pattern", "words"), "pattern")
    name = F.element_at(F.split("path", "/"), -1)
    return named.select(F.concat(F.lit("RM-"), F.substring(F.sha2(F.concat_ws(":", F.lit("mine:keyword"), "path", "words"), 256), 1, 8)).alias("id"), "path", "line",
        F.col("words").alias("keyword"), F.concat(F.lit("Review: "), "words", F.lit(" in "), name).alias("title"), F.substring("note", 1, 200).alias("note"))


# Topics and their words.
TOPICS = {
    "authentication": ["auth", "login", "logout", "session", "token", "tokens", "jwt", "oauth", "sso", "password", "credential", "signup", "signin"],
    "e-commerce": ["cart", "checkout", "payment", "order", "orders", "invoice", "billing", "subscription", "pricing", "product", "products", "catalog", "shop", "store"],
    "UI components": ["button", "modal", "dialog", "sidebar", "navbar", "nav", "header", "footer", "card", "cards", "form", "input", "dropdown", "tooltip", "menu", "tabs", "panel", "layout", "widget"],
    "API layer": ["api", "endpoint", "endpoints", "route", "routes", "router", "controller", "controllers", "handler", "handlers", "middleware", "rest", "graphql", "grpc"],
    "data models": ["model", "models", "schema", "schemas", "entity", "entities", "migration", "migrations", "database", "db", "orm", "repository", "repo"],
    "testing": ["test", "tests", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "e2e", "integration", "unit"],
    "infrastructure": ["deploy", "deployment", "docker", "dockerfile", "compose", "terraform", "k8s", "kubernetes", "ci", "cd", "pipeline", "github", "workflow", "nginx", "helm"],
    "configuration": ["config", "settings", "env", "environment", "constants", "defaults", "options", "preferences"],
    "state management": ["store", "redux", "context", "provider", "reducer", "action", "actions", "state", "slice", "zustand", "atom"],
    "animation & visuals": ["animation", "parallax", "scroll", "canvas", "transition", "effect", "shader", "particle", "three", "webgl", "gsap"],
    "messaging & events": ["event", "events", "listener", "emitter", "queue", "message", "messages", "pubsub", "webhook", "webhooks", "notification", "notifications"],
    "file & storage": ["upload", "download", "file", "files", "storage", "s3", "blob", "media", "image", "images", "asset", "assets"],
}


def topics(files: DataFrame, most: int = 5, shown: int = 8) -> DataFrame:
    """The topics of at least two words that file names (path) hold: topic, matches, words, files (the first by path); those of most words first, ties in the order of TOPICS."""
    spark = files.sparkSession
    table = spark.createDataFrame([(i, t, w) for i, (t, words) in enumerate(TOPICS.items()) for w in words], "place int, topic string, word string")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    words = F.filter(F.transform(F.regexp_extract_all(stem, F.lit(r"([a-z]+|[A-Z][a-z]*|\d+)"), F.lit(1)), lambda x: F.lower(x)), lambda x: F.length(x) > 1)
    met = files.select("path", F.explode(F.array_distinct(words)).alias("word")).join(table, "word")
    found = met.groupBy("place", "topic").agg(F.array_sort(F.collect_set("word")).alias("words")).withColumn("matches", F.size("words")).where("matches >= 2")
    first = first_paths(met, shown)
    return found.join(first, "place").orderBy(F.desc("matches"), "place").limit(most).select("topic", "matches", F.array_join("words", " ").alias("words"),
        F.array_join(F.transform("paths", lambda p: F.element_at(F.split(p, "/"), -1)), " ").alias("files"))


def first_paths(met: DataFrame, shown: int) -> DataFrame:
    """The first paths of each place, ranked in parts so that no task sorts all of a topic's files."""
    one = met.select("place", "path").distinct().withColumn("part", F.pmod(F.xxhash64("path"), F.lit(64)))
    near = one.withColumn("r", F.row_number().over(W.partitionBy("place", "part").orderBy("path"))).where(F.col("r") <= shown)
    last = near.withColumn("r", F.row_number().over(W.partitionBy("place").orderBy("path"))).where(F.col("r") <= shown)
    return last.groupBy("place").agg(F.array_sort(F.collect_list("path")).alias("paths"))
