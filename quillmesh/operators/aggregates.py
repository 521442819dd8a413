"""Aggregations over graphs, changes, usage and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.files import INSTALL_DIRS
from ..sources.scratch import kept, spread
from .joins import first_n
from .rank import running_sums, with_share_below

# Weights of the file score, its bands, and the weights of other scores.
FILE_WEIGHTS = {"lines": 0.25, "fan_in": 0.20, "fan_out": 0.10, "symbols": 0.10, "circular": 0.10, "tech_debt": 0.15, "low_confidence": 0.10}
FILE_BANDS = {"critical": 0.75, "warning": 0.50, "info": 0.45}
RISK_WEIGHTS = {"hub": 0.40, "concept": 0.30, "observation": 0.20, "churn": 0.10}
NODE_WEIGHTS = {"summary": 0.2353, "validation": 0.1765, "neighbours": 0.2353, "references": 0.1765, "depth": 0.1764}


def in_degrees(edges: DataFrame, kinds: list[str] | None = None, origins: list[str] | None = None) -> DataFrame:
    use = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    use = use.where(F.col("origin").isin(origins)) if origins else use
    return use.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every end, from one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def hub_files(nodes: DataFrame, edges: DataFrame, k: int = 10, scope: str | None = None) -> DataFrame:
    """The k files with most incoming edges; an edge to a symbol counts for its file, repeated edges count each time, external ones don't."""
    files = nodes.where("kind = 'file'").select(F.col("id").alias("file_id"), "file_path")
    target = nodes.select(F.col("id").alias("target"), "file_path")
    into = edges.where("origin != 'external'").join(target, "target").groupBy("file_path").agg(F.count("*").alias("in_degree"))
    out = into.join(files, "file_path")
    if scope:
        out = out.where(paths.under(F.col("file_path"), F.lit(scope)))
    return out.orderBy(F.desc("in_degree"), "file_path").limit(k).select("file_id", "file_path", "in_degree")


def churn(commits: DataFrame, since: str) -> DataFrame:
    """Commits, lines, first and last day and authors of each path since a day.

    A path's rows are shuffled once, as they are. What is counted distinct becomes rows of its own (a commit's with its lines, an author's) behind
    that shuffle, and both groupings stay in its partitions.
    """
    rows = commits.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).select("path", "commit_id", "author", "ts", "added", "removed")
    rows = spread(rows, "path")
    types = {f.name: f.dataType for f in rows.schema.fields}
    own = lambda *names: F.struct(*((F.col(k) if k in names else F.lit(None).cast(types[k])).alias(k) for k in rows.columns[1:]),
        F.lit("author" not in names).alias("of_commit"))
    each = rows.select("path", F.explode(F.array(own("commit_id", "ts", "added", "removed"), own("author"))).alias("r")).select("path", "r.*")
    once = each.groupBy("path", "of_commit", "commit_id", "author").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return once.groupBy("path").agg(F.count("commit_id").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("author").alias("authors"))


def hot_zones(commits: DataFrame, depth: int = 3, least: int = 10, groups: int = 3, top: int = 5) -> DataFrame:
    """The folders with most commits; none at all when fewer than groups folders have least commits."""
    folder = F.array_join(F.slice(F.split(paths.directory(F.col("path")), "/"), 1, depth), "/")
    pairs = spread(commits.select(folder.alias("zone"), "commit_id"), "zone", "commit_id").distinct()
    zones = pairs.groupBy("zone").agg(F.count("commit_id").alias("commits")).where(F.col("commits") >= least)
    enough = zones.withColumn("__n", F.count("*").over(W.partitionBy()))
    return enough.where(F.col("__n") >= groups).orderBy(F.desc("commits"), "zone").limit(top).drop("__n")


def consensus(observations: DataFrame, least: int = 2) -> DataFrame:
    """Files that at least least agents noted, and the share of all of a project's agents; the totals are one row a project."""
    fresh = observations.where("NOT stale")
    total = fresh.groupBy("project_id").agg(F.countDistinct("agent").alias("all_agents"))
    per = fresh.groupBy("project_id", "file_path").agg(F.countDistinct("agent").alias("agents"), F.count("*").alias("n")).where(F.col("agents") >= least)
    return per.join(total, "project_id").withColumn("score", F.round(F.col("agents") / F.col("all_agents"), 6))


def usage_sets(usage: DataFrame) -> DataFrame:
    """Tokens by provider, by model, by task and in all, in one pass of grouping sets."""
    return usage.groupingSets([[F.col("provider")], [F.col("model")], [F.col("task_id")], []], F.col("provider"), F.col("model"),
        F.col("task_id")).agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("n"))


def summary(items: DataFrame) -> DataFrame:
    """Open items by each of five properties, in one pass of grouping sets."""
    keys = ["priority", "category", "source", "analyzer", "severity"]
    return items.where("NOT dismissed").groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.count("*").alias("n"))


def file_scores(raw: DataFrame) -> DataFrame:
    """score and severity of rows path, lines, fan_in, fan_out, symbols, circular, tech_debt, confidence (null: 0.5); healthy files are left out.

    One pass ranks all six signals: rows of (signal, value) are counted, values put in order once, and each row takes the mean rank of its value's ties.
    """
    base = kept(raw.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))), "file-scores")
    signals, w = ["lines", "fan_in", "fan_out", "symbols", "tech_debt", "confidence"], FILE_WEIGHTS
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in signals)))
    rows = base.select("path", each.alias("s")).select("path", "s.signal", "s.value")
    counts = rows.groupBy("signal", "value").agg(F.count("*").alias("ties"))
    placed = kept(running_sums(counts, [F.col("signal"), F.col("value")], {"before": F.col("ties")}), "file-ranks")
    of = placed.groupBy("signal").agg(F.min("before").alias("first"), F.sum("ties").alias("n"))  # six rows
    below = F.col("before") - F.col("first")
    share = F.when(F.col("n") == 1, F.lit(0.5)).otherwise((below + (F.col("ties") - 1) / 2) / (F.col("n") - 1))
    ranks = placed.join(F.broadcast(of), "signal").select("signal", F.col("value").alias("v"), share.alias("share"))
    weight = F.create_map(*(F.lit(x) for c in signals[:5] for x in (c, w[c])))
    part = F.when(F.col("signal") == "confidence", w["low_confidence"] * (1 - F.col("share"))).otherwise(F.element_at(weight, F.col("signal")) * F.col("share"))
    own = rows.withColumnRenamed("signal", "s").join(ranks, (F.col("s") == F.col("signal")) & F.col("value").eqNullSafe(F.col("v")))
    sums = own.groupBy("path").agg(F.sum(part).alias("sum"))
    scored = base.select("path", "circular").join(sums, "path").withColumn("score", F.round(F.col("sum") + w["circular"] * F.col("circular").cast("double"), 6))
    severity = F.when(F.col("score") >= FILE_BANDS["critical"], "critical").when(F.col("score") >= FILE_BANDS["warning"],
        "warning").when(F.col("score") >= FILE_BANDS["info"], "info")
    return scored.withColumn("severity", severity).where("severity IS NOT NULL").select("path", "score", "severity")


def repository_profile(files: DataFrame, depth: int = 4, most: int = 5000) -> DataFrame:
    """kind, name, value of a repository by the first most of its paths, not deeper than depth: languages and globs to include with their files, install folders to exclude with theirs, and the weight of each role."""
    shown = files.where(F.size(F.split("path", "/")) <= depth).orderBy("path").limit(most)
    install = F.array_intersect(F.split("path", "/"), F.array(*map(F.lit, INSTALL_DIRS)))
    rows = shown.select("path", paths.language(F.col("path")).alias("language"), paths.extension(F.col("path")).alias("ext"), F.get(install, F.lit(0)).alias("folder"), paths.role(F.col("path")).alias("role"))
    fact = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    own = F.col("folder").isNull() & F.col("language").isNotNull()
    facts = F.array(F.when(own, fact("language", F.col("language"))), F.when(own, fact("include", F.concat(F.lit("**/*"), "ext"))),
        F.when(F.col("folder").isNotNull(), fact("exclude", F.concat(F.lit("**/"), "folder", F.lit("/**")))), fact("role", F.col("role")))
    counted = rows.select(F.explode(F.filter(facts, lambda x: x.isNotNull())).alias("f")).groupBy("f.kind", "f.name").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counted.join(F.broadcast(total)).select("kind", "name", F.when(F.col("kind") == "role", F.round(F.col("n") / F.col("total"), 6)).otherwise(F.col("n").cast("double")).alias("value"))


def hub_outliers(degree: DataFrame, least_z: float = 2.0, least_degree: int = 8, least_files: int = 5) -> DataFrame:
    """Files whose positive in-degree stands out by the sample deviation; the statistics are one row, joined to all."""
    stats = degree.where("in_degree > 0").agg(F.avg("in_degree").alias("mean"), F.stddev_samp("in_degree").alias("sd"), F.count("*").alias("n"))
    z = (F.col("in_degree") - F.col("mean")) / F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)
    out = degree.where("in_degree > 0").join(F.broadcast(stats)).where(F.col("n") >= least_files).withColumn("z", z)
    return out.where((F.col("z") >= least_z) & (F.col("in_degree") >= least_degree)).select("id", "in_degree", F.round("z", 4).alias("z"))


def risk(hub: Column, constraint: Column, architecture: Column, observation: Column, churn_: Column) -> Column:
    w, concept = RISK_WEIGHTS, F.when(constraint, 1.0).when(architecture, 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w["hub"] * hub + w["concept"] * concept + w["observation"] * observation + w["churn"] * churn_))


def coupling_hotspots(degree: DataFrame, least_z: float = 2.0, least_degree: int = 8) -> DataFrame:
    """Outliers among files that aren't generated, with the share of files strictly below them and the risk of that."""
    use = degree.where(~paths.generated(F.col("file_path")))
    stats = use.agg(F.avg("in_degree").alias("mean"), F.stddev_samp("in_degree").alias("sd"), F.count("*").alias("n"))
    z = (F.col("in_degree") - F.col("mean")) / F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)
    out = with_share_below(use, "in_degree", "percentile").join(F.broadcast(stats)).where("n >= 2").withColumn("z", z)
    hot = out.where((F.col("z") >= least_z) & (F.col("in_degree") >= least_degree))
    nothing = F.lit(False)
    return hot.select("file_path", "in_degree", F.round("z", 4).alias("z"),
        F.round(risk(F.col("percentile"), nothing, nothing, F.lit(0.0), F.lit(0.0)), 4).alias("risk"))


def best_findings(findings: list[DataFrame], top: int = 20) -> DataFrame:
    """The riskiest finding of each type and path, then the top of all."""
    every = findings[0]
    for f in findings[1:]:
        every = every.unionByName(f)
    return first_n(every, ["finding_type", "file_path"], [F.desc("risk")], 1).orderBy(F.desc("risk"), "finding_type", "file_path").limit(top)


def consolidated(items: DataFrame, label: Column) -> DataFrame:
    """Groups of items by label: size, most urgent priority, commonest category (ties to the first by name)."""
    n = items.withColumn("label", label).groupBy("label", "category").agg(F.count("*").alias("n"), F.min("priority").alias("p"))
    return n.groupBy("label").agg(F.sum("n").alias("n"), F.min("p").alias("priority"),
        F.min(F.struct((-F.col("n")).alias("k"), "category")).alias("top")).select("label", "n", "priority", F.col("top.category").alias("category"))


def by_root_file(items: DataFrame) -> DataFrame:
    """Files with two items or more are a group; the rest go by category."""
    n = items.groupBy("file_path").agg(F.count("*").alias("__n"))
    return consolidated(items.join(n, "file_path", "left"), F.when(F.col("__n") >= 2, F.concat(F.lit("Improve: "), paths.base_name(F.col("file_path"))))
        .otherwise(F.col("category")))


def node_scores(nodes: DataFrame, edges: DataFrame, enriched: DataFrame) -> DataFrame:
    """Composite of five components for nodes (id, confidence, validated, refs); enriched has id and depth."""
    each = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    both = edges.select(each.alias("e")).select("e.*").where(F.col("target").startswith("file:"))  # the edges are made once for both directions
    near = spread(both, "target").distinct().join(enriched.select(F.col("id").alias("target"), F.lit(1).alias("hit")), "target",
        "left").groupBy(F.col("source").alias("id")).agg((F.count("hit") / F.count("*")).alias("c3"))
    joined = nodes.join(near, "id", "left").join(enriched, "id", "left")
    c2 = F.when(F.col("depth").isNotNull(), 1.0).when(F.col("validated"), 0.6).otherwise(0.0)
    c5 = F.when(F.col("depth").isNull(), 0.0).when(F.col("depth") >= 4, 1.0).when(F.col("depth") >= 3, 0.75).otherwise(0.5)
    w = NODE_WEIGHTS
    composite = w["summary"] * F.coalesce("confidence", F.lit(0.0)) + w["validation"] * c2 + w["neighbours"] * F.coalesce("c3",
        F.lit(0.5)) + w["references"] * F.least(F.lit(1.0), F.col("refs") / 4.0) + w["depth"] * c5
    return joined.select("id", F.round(composite, 3).alias("composite"))


def convergence(before: DataFrame, now: DataFrame, settled: float = 0.95) -> DataFrame:
    both = now.join(before.withColumnRenamed("score", "old"), "id", "left")
    return both.agg(F.round(F.avg((F.col("score") >= settled).cast("double")), 6).alias("settled_ratio"), F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))), 6).alias("max_residual"))


def segments(files: DataFrame, least: int = 10, most: int = 15, share: float = 0.25) -> DataFrame:
    """Files by top folder, a folder with more than a share of all files by its subfolders; small groups join ``root``, and so do those beyond the most largest.

    Only folders are ranked, not files.
    """
    top, sub = F.split_part("path", F.lit("/"), F.lit(1)), F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    n = files.groupBy(top.alias("top"), sub.alias("sub")).agg(F.count("*").alias("n"))
    deep = F.sum("n").over(W.partitionBy("top")) > share * F.sum("n").over(W.partitionBy())
    n = n.withColumn("segment", F.when(deep, F.col("sub")).otherwise(F.col("top"))).groupBy("segment").agg(F.sum("n").alias("n"))
    ranked = n.withColumn("__r", F.row_number().over(W.orderBy(F.desc("n"), "segment")))
    keep = F.when((F.col("n") >= least) & (F.col("__r") <= most), F.col("segment")).otherwise("root")
    return ranked.groupBy(keep.alias("segment")).agg(F.sum("n").alias("n"))


def segment_descriptors(tags: DataFrame, hubs: DataFrame, most_tags: int = 3, most_hubs: int = 2) -> DataFrame:
    """Per segment its commonest tags and its hubs, each in order."""
    t = first_n(tags.groupBy("segment", "tag").agg(F.count("*").alias("n")), ["segment"], [F.desc("n"), "tag"],
        most_tags).groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag"))),
        lambda x: x["tag"]), ",").alias("tags"))
    h = first_n(hubs, ["segment"], [F.desc("degree"), "path"],
        most_hubs).groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("k"), "path"))),
        lambda x: x["path"]), ",").alias("hubs"))
    return t.join(h, "segment", "full_outer")


def velocity(done: DataFrame, end: str, days: int = 14, windows: int = 6) -> DataFrame:
    """Completed items per window before end, the latest first; windows without any count as zero."""
    at = F.lit(end).cast("timestamp_ntz")
    inside = done.withColumn("window",
        F.when(F.unix_micros(F.col("completed_at").cast("timestamp")) < F.unix_micros(at.cast("timestamp")),
        F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("completed_at").cast("timestamp")) - 1) / (days * 86_400_000_000)))).where(F.col("window") < windows)
    n = inside.groupBy("window").agg(F.count("*").alias("completed"), F.count_if(F.col("priority") == "P0").alias("p0"),
        F.count_if(F.col("priority") == "P1").alias("p1"))
    calendar = done.sparkSession.range(windows).withColumnRenamed("id", "window")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calendar.join(n, "window", "left").select("window", zero("completed"), zero("p0"), zero("p1"))


def size_histogram(sizes: DataFrame) -> DataFrame:
    band = F.when(F.col("n") <= 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").when(F.col("n") <= 25,
        "11-25").otherwise("26+")
    return sizes.groupBy(band.alias("band")).agg(F.count("*").alias("clusters"))


def document_score(links: Column, most_links: Column, convention: Column, folder_ratio: Column, agent_dir: Column) -> Column:
    ratio = F.when(most_links > 0, links / most_links).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 * ratio + F.when(convention, 0.25).otherwise(0.0) + F.when(folder_ratio >= 0.6, 0.15)
        .otherwise(0.0) + F.when(agent_dir, 0.10).otherwise(0.0))


def overlaps(members: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """Pairs of groups by the Jaccard similarity of their items: shared counts and sizes, no sets in memory."""
    sizes = members.groupBy(key).agg(F.countDistinct(item).alias("n"))
    m = members.select(key, item).distinct()
    shared = m.select(F.col(key).alias("a"), item).join(m.select(F.col(key).alias("b"), item), item).where("a < b").groupBy("a",
        "b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.where(j > least).select("a", "b", F.round(j, 6).alias("jaccard"))


def integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """State of each file's record count after a run, against that before."""
    both = before.withColumnRenamed("n", "old").join(after.withColumnRenamed("n", "new"), "name", "full_outer")
    ratio = F.col("new") / F.greatest(F.col("old"), F.lit(1))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when((F.col("old") > 0) & (F.col("new") == 0),
        "catastrophic").when(ratio < 0.5, "major_shrink").when(ratio > 1.5, "growth").otherwise("ok")
    return both.withColumn("state", state)


def audit_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What analyzers know of each file: its node, symbols, imports and importers."""
    files = nodes.where("kind = 'file'").select("id", "file_path", "language", "size")
    symbols = nodes.where("kind = 'symbol'").groupBy("file_path").agg(F.count("*").alias("symbols"))
    used = edges.where("kind = 'imports'")
    out, back = (used.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name)) for end, name in (("source", "imports"), ("target", "importers")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(symbols, "file_path", "left").join(out, "id", "left").join(back, "id", "left").select("id", "file_path", "language", "size",
        zero("symbols"), zero("imports"), zero("importers"))
