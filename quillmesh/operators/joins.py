"""Joins of graph, change and knowledge tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import paths
from ..sources.scratch import kept
from . import overlaps
from .rank import numbered


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the limit is pushed below the shuffle by the planner."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def neighbours(edges: DataFrame, nodes: DataFrame, of: DataFrame, kinds: list[str] | None = None, most: int = 50) -> DataFrame:
    """probe, direction, neighbour, kind of up to most neighbours of each node id of ``of`` (column id), both directions, each edge with its own node."""
    use = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    out = use.join(of.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("probe"), F.lit("out").alias("direction"),
        F.col("target").alias("neighbour"), "kind")
    into = use.join(of.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("target").alias("probe"), F.lit("in").alias("direction"),
        F.col("source").alias("neighbour"), "kind")
    known = out.unionByName(into).join(nodes.select(F.col("id").alias("neighbour"), "file_path"), "neighbour")
    return first_n(known, ["probe"], ["direction", "neighbour", "kind"], most)


def enriched_findings(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Findings with the structural context of their file, and a risk from both."""
    joined = findings.join(context, "file_path", "left")
    base = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "warning", 0.6).otherwise(0.3)
    return joined.withColumn("dependents", F.coalesce("dependents", F.lit(0))).withColumn("risk",
        F.round(F.least(base * (1 + F.col("dependents") / 20), F.lit(1.0)), 4))


def with_modules(edges: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """Import edges with paths and modules of both ends; an end without a module has null."""
    of = nodes.select("id", "file_path").join(modules.select(F.col("path").alias("file_path"), "module"), "file_path", "left")
    a = of.select(F.col("id").alias("source"), F.col("file_path").alias("source_path"), F.col("module").alias("source_module"))
    b = of.select(F.col("id").alias("target"), F.col("file_path").alias("target_path"), F.col("module").alias("target_module"))
    return edges.where("kind = 'imports'").join(a, "source").join(b, "target")


def cross_module(edges: DataFrame, nodes: DataFrame, modules: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of modules with at least least imports across, and the file most of them go to."""
    across = with_modules(edges, nodes, modules).where("source_module != target_module")
    per_file = across.groupBy("source_module", "target_module", "target_path").agg(F.count("*").alias("n"))
    pairs = per_file.groupBy("source_module", "target_module").agg(F.sum("n").alias("imports"),
        F.min(F.struct((-F.col("n")).alias("k"), "target_path")).alias("top"))
    n, top = F.col("imports"), -F.col("top.k")
    bottleneck = (top > n * 0.6) & (top >= 3)
    severity = F.when(bottleneck, F.when(top >= 5, "critical").otherwise("warning")).when(n >= 10, "warning").otherwise("info")
    return pairs.where(n >= least).select("source_module", "target_module", "imports", F.col("top.target_path").alias("bottleneck"),
        top.alias("bottleneck_imports"), severity.alias("severity"))


def module_edges(edges: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    return with_modules(edges, nodes,
        modules).where("source_module IS NOT NULL AND target_module IS NOT NULL AND source_module != target_module").groupBy("source_module",
        "target_module").agg(F.count("*").alias("n"))


def unused_files(nodes: DataFrame, edges: DataFrame, entry_marks: str = "main|index|app|cli|server|setup|conftest") -> DataFrame:
    """Files that nothing imports, without entry points, tests and prose."""
    files = nodes.where("kind = 'file'")
    name = F.lower(paths.stem(F.col("file_path")))
    skip = name.rlike(entry_marks) | F.col("file_path").contains("/test") | name.contains("test_") | name.contains("_test") | (F.col("language") == "markdown")
    return files.where(~skip).join(edges.where("kind = 'imports'").select(F.col("target").alias("id")), "id", "left_anti")


def isolated_modules(modules: DataFrame, links: DataFrame) -> DataFrame:
    """Modules of more than one file that no module edge touches."""
    size = modules.groupBy("module").agg(F.count("*").alias("files")).where("files > 1")
    return size.join(links.select(F.col("source_module").alias("module")), "module", "left_anti").join(links.select(F.col("target_module").alias("module")),
        "module", "left_anti")


def overlay(base: DataFrame, delta: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """delta's rows in place of base's of the same key; keys in gone are hidden from the base."""
    out = base.join(delta.select(key), key, "left_anti")
    if gone is not None:
        out = out.join(gone.select(key), key, "left_anti")
    return out.unionByName(delta)


def tested_sources(files: DataFrame) -> DataFrame:
    """(test, source) by the name of the file under test."""
    bare = F.regexp_replace(F.regexp_replace(paths.stem(F.col("path")), "^(?:test_|tests_)", ""), "(?:_test|_spec|_tests)$", "")
    tests = files.where(paths.test_file(F.col("path"))).select(F.col("path").alias("test"), bare.alias("stem"))
    sources = files.where(~paths.test_file(F.col("path"))).select(F.col("path").alias("source"), paths.stem(F.col("path")).alias("stem"))
    return tests.join(sources, "stem").select("test", "source")


#: Bits of the bitmap of a set: two sets differ in as many tokens at least as their bitmaps in bits.
BITS = 512


def bitmap(x: Column) -> dict[str, Column]:
    """m0, m1, ...: the words of the bitmap of an array of integers."""
    places = F.transform(x, lambda r: F.pmod(F.xxhash64(r), F.lit(BITS)).cast("int"))

    def word(i: int) -> Column:
        own = F.filter(places, lambda p: F.floor(p / 64) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)))

    return {f"m{i}": word(i) for i in range(BITS // 64)}


def jaccard_pairs(sets: DataFrame, least: float, strict: bool = False, apart: str | None = None, most: int | None = None) -> DataFrame:
    """a, b, jaccard of pairs of rows (id, tokens) by prefix filtering; apart: a column in which both must differ; most: that many of the surest pairs only.

    Equal sets are one, compared once. Tokens are numbered rarest first, so a set is a sorted array of integers; different sets meet in blocks (``overlaps``),
    and no pair leaves a block that isn't similar. With most, each class of equal sets sends its first most + 1 members only: a pair with a later one comes
    behind most others.
    """
    sets = kept(sets.select("id", F.array_distinct("tokens").alias("tokens"), *([apart] if apart else [])), "sets")  # texts are cut into tokens once
    one = sets.select("id", F.explode("tokens").alias("t"))
    number = numbered(one.groupBy("t").agg(F.count("*").alias("df")), [F.col("df"), F.col("t")], "r").select("t", "r")
    rows = one.join(number, "t").groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("x"))
    rows = kept(rows.withColumn("set", F.md5(F.array_join("x", ",").cast("binary"))), "jaccard")
    distinct = kept(rows.groupBy("set").agg(F.first("x").alias("x")).withColumn("n", F.size("x")), "jaccard")
    near = overlaps.similar(distinct, least).select("u", "v", (F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))).alias("jaccard"))
    found = kept(near.where(F.col("jaccard") > least if strict else F.col("jaccard") >= least), "similar")
    same = rows.groupBy("set").agg(F.count("*").alias("m")).where("m > 1").select(F.col("set").alias("u"), F.col("set").alias("v"), F.lit(1.0).alias("jaccard"))
    found = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "jaccard")).unionByName(same.where(F.lit(not strict or least < 1)))
    member = rows.select("id", "set") if apart is None else rows.select("id", "set").join(sets.select("id", F.col(apart).alias("side")), "id")
    if most:
        place = F.row_number().over(W.partitionBy("set", *(["side"] if apart else [])).orderBy("id"))
        member = member.withColumn("place", place).where(F.col("place") <= most + 1).drop("place")
    ends = [member.select(F.col("id").alias(k), F.col("set").alias(s), *([F.col("side").alias(f"side_{k}")] if apart else [])) for k,
        s in (("a", "u"), ("b", "v"))]
    out = found.join(ends[0], "u").join(ends[1], "v").where("a < b")
    out = (out.where("side_a != side_b") if apart else out).select("a", "b", "jaccard")
    return out.orderBy(F.desc("jaccard"), "a", "b").limit(most) if most else out


def anchor_pairs(anchors: DataFrame, titles: DataFrame, least_shared: int = 2, title_jaccard: float = 0.6, hub: int | None = None) -> DataFrame:
    """Pairs of concepts sharing least_shared anchors, or one and a similar title; anchors of more than hub concepts say nothing when hub is given.

    Pairs of one anchor alone are never made: a pair meets by each set of least_shared anchors that it shares, and by an anchor with two similar titles,
    and counts where it meets first. So what is joined grows with the result. Titles are compared once for all concepts that have their words.
    """
    use = anchors.where("id IS NOT NULL AND anchor IS NOT NULL").distinct()
    least_shared = 1 if title_jaccard <= 0 else max(least_shared, 1)
    n_parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few rows may make many pairs
    if hub:
        use = use.join(use.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") <= hub), "anchor").drop("m")
    words = titles.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    have = kept(use.groupBy("id").agg(F.array_sort(F.collect_list("anchor")).alias("have")).join(words, "id"), "anchored")
    sides = lambda rows, on: (rows.select(F.col("id").alias(x), *on(x), F.col("have").alias(f"have_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in ("a", "b"))
    both = F.array_intersect("have_a", "have_b")
    n, union = F.size(F.array_intersect("tokens_a", "tokens_b")), F.size(F.array_union("tokens_a", "tokens_b"))
    similar = F.when(union > 0, n / union).otherwise(0.0)
    pair = lambda rows: rows.select("a", "b", F.size(both).cast("long").alias("shared"), F.round(similar, 6).alias("title_jaccard"))
    sets = F.transform("have", lambda x: F.array(x))
    for _ in range(least_shared - 1):
        sets = F.flatten(F.transform(sets, lambda k: F.transform(F.filter("have", lambda x: x > F.element_at(k, -1)), lambda x: F.concat(k, F.array(x)))))
    by_set = have.withColumn("key", F.explode(sets)).repartition(n_parts, "key")
    a, b = sides(by_set, lambda x: ["key"])
    many = pair(a.join(b, "key").where("a < b").where(F.slice(both, 1, least_shared) == F.col("key")))
    if least_shared == 1 or title_jaccard > 1:
        return many
    title = have.select("tokens").distinct()
    alike = kept(similar_sets(title, title_jaccard), "alike")
    a, b = sides(have.withColumn("anchor", F.explode("have")), lambda x: ["anchor"])
    one = pair(a.join(alike, "tokens_a").repartition(n_parts, "anchor", "tokens_b").join(b, ["anchor", "tokens_b"]).where("a < b").where((F.size(both) < least_shared) & (both[0] == F.col("anchor"))))
    return many.unionByName(one)


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(tokens_a, tokens_b), both ways and each with itself, of different sorted sets (tokens) of a Jaccard similarity of least (over 0, at most 1) or more; those of no tokens are like nothing.

    Two such sets share a token among the first of either, as many as the rest can't make up for, the rarest first.
    """
    some = sets.where("size(tokens) > 0")
    itself = some.select(F.col("tokens").alias("tokens_a"), F.col("tokens").alias("tokens_b"))
    count = some.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    ranked = some.select("tokens", F.explode("tokens").alias("t")).join(count, "t").groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("r"))
    first = ranked.select("tokens", F.explode(F.slice("r", F.lit(1), (F.size("tokens") - F.ceil(F.size("tokens") * F.lit(least) - 1e-9) + 1).cast("int"))).alias("r")).select("tokens", F.col("r.t").alias("t"))
    met = first.select("t", F.col("tokens").alias("tokens_a")).join(first.select("t", F.col("tokens").alias("tokens_b")), "t").where("tokens_a < tokens_b").drop("t").distinct()
    near = met.where(F.size(F.array_intersect("tokens_a", "tokens_b")) / F.size(F.array_union("tokens_a", "tokens_b")) >= least)
    return itself.unionByName(near).unionByName(near.select(F.col("tokens_b").alias("tokens_a"), F.col("tokens_a").alias("tokens_b")))


def concept_conflicts(concepts: DataFrame) -> DataFrame:
    """Active constraints and architecture notes on one anchor: the oldest wins, each other one is in conflict with it."""
    w = W.partitionBy("anchor").orderBy("created", "id")
    ranked = concepts.where("status = 'active' AND category IN ('constraint', 'architecture')").withColumn("winner", F.first("id").over(w))
    return ranked.where("winner != id").select("anchor", "winner", F.col("id").alias("loser"))


def agent_conflicts(observations: DataFrame) -> DataFrame:
    """Pairs of agents that saw the same file, with the last observation of each."""
    last = observations.groupBy("file_path", "agent").agg(F.max_by("id", F.struct("created_at", "id")).alias("last"))
    return last.select("file_path", F.col("agent").alias("a"),
        F.col("last").alias("last_a")).join(last.select("file_path", F.col("agent").alias("b"), F.col("last").alias("last_b")), "file_path").where("a < b")


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, take: list[str], days: int = 32) -> DataFrame:
    """Each left row with the latest right row of its key not after it, by buckets of days, so that a hot key is many groups.

    Inside a bucket one union is sorted by time; what a bucket starts with is the last right row of the buckets before it, found among one row a key and bucket.
    """
    number = isinstance(left.schema[left_ts].dataType, NumericType)  # numbers are seconds
    bucket = lambda ts: F.floor(F.col(ts) / (days * 86_400) if number else F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / days)
    a = left.withColumn("__b", bucket(left_ts)).withColumn("__ts", F.col(left_ts)).withColumn("__side", F.lit(1))
    b = right.select(*key, bucket(right_ts).alias("__b"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*take).alias("__take"))
    ends = a.select(*key, "__b").distinct().join(b.groupBy(*key, "__b").agg(F.max_by("__take", "__ts").alias("__last")), [*key, "__b"], "full_outer")
    before = W.partitionBy(*key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.withColumn("__start", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    w = W.partitionBy(*key, "__b").orderBy("__ts", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__take", F.last("__take", ignorenulls=True).over(w)).where("__side = 1")
    out = both.join(starts, [*key, "__b"], "left").withColumn("__take", F.coalesce("__take", "__start"))
    return out.select(*left.columns, *(F.col(f"__take.{t}").alias(t) for t in take))


def ranking_diff(old: DataFrame, new: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """new, removed and rank_changed (by more than one) entries of two rankings."""
    o, n = old.select(key, F.col(rank).alias("old_rank")), new.select(key, F.col(rank).alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "new").when(F.col("new_rank").isNull(), "removed").when(F.abs(F.col("old_rank") - F.col("new_rank")) > 1,
        "rank_changed")
    return o.join(n, key, "full_outer").withColumn("change", change).where("change IS NOT NULL")


def size_diff(old: DataFrame, new: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    o, n = old.select(key, F.col("n").alias("old_n")), new.select(key, F.col("n").alias("new_n"))
    moved = F.abs(F.col("new_n") - F.col("old_n")) > share * F.greatest(F.col("old_n"), F.lit(1))
    change = F.when(F.col("old_n").isNull(), "new").when(F.col("new_n").isNull(), "removed").when(moved, "size_changed")
    return o.join(n, key, "full_outer").withColumn("change", change).where("change IS NOT NULL")


def changeset(old: DataFrame, new: DataFrame, comparable: bool = True) -> DataFrame:
    """path and status of two (path, hash) snapshots; where hashes can't be compared, common paths count as unchanged."""
    both = old.select("path", F.col("hash").alias("h0"),
        F.lit(True).alias("had")).join(new.select("path", F.col("hash").alias("h1"), F.lit(True).alias("has")), "path", "full_outer")
    same = F.col("h0").eqNullSafe(F.col("h1")) if comparable else F.lit(True)
    status = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def coverage(files: DataFrame, changes: DataFrame, embedded: DataFrame, excluded: list[str]) -> DataFrame:
    """traced, pending, stale, untraced or excluded for every file."""
    state = F.when(paths.any_glob(F.col("path"), excluded), "excluded").when(F.col("done").isNotNull() & (F.col("status") == "modified"),
        "stale").when(F.col("done").isNotNull(), "traced").when(F.col("status").isin("added", "modified"), "pending").otherwise("untraced")
    return files.select("path").join(changes, "path", "left").join(embedded.select("path", F.lit(True).alias("done")), "path", "left").select("path",
        state.alias("state"))


def longest_prefix(items: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """Each path with the longest of the prefixes (prefix, value) that it lies in or equals: its ancestors are joined by equality."""
    parts = F.split(path, "/")
    up = items.select(path, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("prefix",
        F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.col("depth")), "/"))
    best = up.join(prefixes, "prefix").groupBy(path).agg(F.max_by(F.struct("prefix", "value"), "depth").alias("best"))
    return items.join(best.select(path, "best.prefix", "best.value"), path, "left")


def documents_of_segments(mentions: DataFrame, segments: DataFrame, most: int = 5) -> DataFrame:
    """The documents that mention most files of each segment."""
    n = mentions.join(segments, "path").groupBy("segment", "doc_id").agg(F.countDistinct("path").alias("overlap"))
    return first_n(n, ["segment"], [F.desc("overlap"), "doc_id"], most)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of known ends, each once."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target",
        "left_semi").dropDuplicates(["source", "target", "kind"])


def replace_origin(edges: DataFrame, new: DataFrame, origin: str) -> DataFrame:
    """All of an origin's edges replaced by new ones that no other origin has."""
    rest = edges.where(F.col("origin") != origin)
    fresh = new.join(rest.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")
    return rest.unionByName(fresh.withColumn("origin", F.lit(origin)))


def judged_hypotheses(guesses: DataFrame, nodes: DataFrame, known: DataFrame, least: float = 0.7) -> DataFrame:
    """Why each guessed edge is refused, or that it is accepted or supports a known one."""
    a = nodes.select(F.col("id").alias("source"), F.lit(1).alias("has_source"))
    b = nodes.select(F.col("id").alias("target"), F.lit(1).alias("has_target"))
    k = known.select("source", "target", F.lit(1).alias("is_known")).distinct()
    verdict = F.when(F.col("has_source").isNull(), "missing_source").when(F.col("has_target").isNull(), "missing_target").when(F.col("confidence") < least,
        "low_confidence").when(F.col("is_known") == 1, "boosts_known").otherwise("accepted")
    return guesses.join(a, "source", "left").join(b, "target", "left").join(k, ["source", "target"], "left").withColumn("verdict", verdict)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id and BM25 score of documents that hold any of the terms. Texts are read once, for their lengths and the few words that are asked for."""
    terms = list(dict.fromkeys(terms))
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    read = docs.select(id_col, F.transform(F.array(words),
        lambda w: F.struct(F.size(w).alias("len"), F.filter(w, lambda x: x.isin(terms)).alias("hits")))[0].alias("__r"))
    tokens = kept(read.select(id_col, "__r.len", *(F.size(F.filter("__r.hits", _equals(t))).alias(f"__{i}") for i, t in enumerate(terms))), "postings")
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("mean"),
        *(F.sum(F.when(F.col(f"__{i}") > 0, 1).otherwise(0)).alias(f"__df{i}") for i in range(len(terms))))
    joined = tokens.where(reduce(lambda x, y: x | y, [F.col(f"__{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"__{i}"), F.col(f"__df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return joined.select(id_col, F.round(score, 6).alias("score"))


def search_notes(notes: DataFrame, question: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id and score of notes by BM25 of a question's words; if none has any, those that hold the question as it stands, at 0."""
    terms = [w for w in re.findall(r"[^\W_]+", question.lower()) if w] or ["\x00"]
    found = bm25(notes, terms, id_col=id_col, text_col=text_col)
    if not found.isEmpty():
        return found
    return notes.where(F.contains(text_col, F.lit(question))).select(id_col, F.lit(0.0).alias("score"))


def missing_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, missing) of nodes with edges to what isn't there, and how many."""
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("missing"))


def with_untested(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per top folder: files that aren't tests, those that a test names, and the share."""
    sources = files.where(~paths.test_file(F.col("path"))).join(pairs.select(F.col("source").alias("path"), F.lit(1).alias("hit")).distinct(), "path", "left")
    return sources.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).agg(F.count("*").alias("files"), F.count("hit").alias("tested"),
        F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("pct"))
