"""Iterative operators on graphs; every round is written to the shared folder, and no vertex is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, kept
from .joins import first_n
from .rank import numbered, running_sums


def impact(edges: DataFrame, start: DataFrame, hops: int = 2, most: int | None = None) -> DataFrame:
    """(id, distance) of what depends on the start ids, nearest first: a frontier of reverse edges, each node once."""
    seen = kept(start.select("id", F.lit(0).alias("distance")).distinct(), "impact")
    front = seen
    for hop in range(1, hops + 1):
        back = edges.select(F.col("target").alias("id"), "source").join(front.select("id"), "id").select(F.col("source").alias("id")).distinct()
        front = kept(back.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)), "impact")
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front), "impact")
    out = seen.where("distance > 0")
    return out.orderBy("distance", "id").limit(most) if most else out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b), by alternating large and small stars; nulls and loops are ignored.

    Every round is written to the shared folder, and the number of rounds grows with the logarithm of the longest chain. The centre of a star has one row
    in the table of least neighbours, which is dealt anew before each join: so both sides are shuffled for the join alone, and Spark may split a hot centre.
    """
    now = kept(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "stars", small=True)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(F.xxhash64("a"))
        large = kept(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "stars", small=True)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.repartition(F.xxhash64("a")), "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = kept(small.union(down.select("a", "m")).where("a != b").distinct(), "stars", small=True)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (a, b) left when nodes without an edge in or out are peeled off round by round: all cycles, and the ways between them."""
    now = kept(edges.where("a != b").select("a", "b").distinct(), "core")
    n = now.count()
    while n:
        ins, outs = now.select(F.col("b").alias("a")).distinct(), now.select(F.col("a").alias("b")).distinct()
        now = kept(now.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"), "core")
        left = now.count()
        if left == n:
            break
        n = left
    return now


def chains(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (a, b) with every chain as one edge, and how long it is (steps); (node, head, tail, steps) of the nodes inside of chains, which have one edge in and one out, and aren't in keep (node), steps being those to the tail; and the nodes of rings of such nodes alone, with the least of each (node, root).

    Ends are found by pointer doubling, so the rounds grow with the logarithm of the longest chain; what still points into a chain after that is on a ring.
    """
    edges = kept(edges.where("a != b").select("a", "b").distinct(), "chain-edges")
    ins = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("i"), F.first("a").alias("head"))
    outs = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("o"), F.first("b").alias("tail"))
    one = ins.join(outs, "node").where("i = 1 AND o = 1").select("node", "head", "tail", F.lit(1).cast("long").alias("steps"))
    inner = kept(one if keep is None else one.join(keep, "node", "left_anti"), "chain-nodes")
    n, now, old = inner.count(), inner, None
    for _ in range(max(n, 1).bit_length() + 1 if n else 0):
        ahead, behind = now.select(F.col("node").alias("tail"), F.col("tail").alias("t"), F.col("steps").alias("more")), now.select(F.col("node").alias("head"), F.col("head").alias("h"))
        new = kept(now.join(ahead, "tail", "left").join(behind, "head", "left").select("node", F.coalesce("h", "head").alias("head"), F.coalesce("t", "tail").alias("tail"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("h").isNotNull() | F.col("t").isNotNull()).alias("moved")), "chain-nodes")
        if old is not None and old is not inner:
            drop(old)
        old, now = now, new.select("node", "head", "tail", "steps")
        now._scratch = new._scratch
        if new.where("moved").isEmpty():
            break
    names = inner.select("node")
    ring = kept(now.join(names.withColumnRenamed("node", "tail"), "tail", "left_semi").select("node"), "rings")
    on_ring = edges.join(ring.withColumnRenamed("node", "a"), "a", "left_semi").join(ring.withColumnRenamed("node", "b"), "b", "left_semi")
    done = now.join(ring, "node", "left_anti")
    free = edges.join(names.withColumnRenamed("node", "a"), "a", "left_anti").join(names.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b", F.lit(1).cast("long").alias("steps"))
    short = done.where("head != tail").select(F.col("head").alias("a"), F.col("tail").alias("b"), (F.col("steps") + 1).alias("steps"))
    return free.unionByName(short).groupBy("a", "b").agg(F.max("steps").alias("steps")), kept(done, "chain-ends"), components(on_ring)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root) of strongly connected components of two nodes or more, root being the least member.

    Chains are one edge each first, so the rounds don't grow with their length. A node inside of one is in its ends' component if both are in the same, and a chain that ends where it begins is one with its end.
    Nodes with an edge in and an edge out, which alone can be on cycles, are numbered in the order of their names, so what rounds shuffle or broadcast is numbers.
    """
    own = kept(edges.where("a != b").select("a", "b"), "scc-edges")
    names = kept(positions(own.select(F.col("a").alias("id")).distinct().join(own.select(F.col("b").alias("id")).distinct(), "id", "left_semi")), "scc-names")
    near = own.join(names.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(names.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    found = kept(numbered_components(near.select(F.col("na").alias("a"), F.col("nb").alias("b"))), "scc-found", small=True)
    return found.join(names.select(F.col("n").alias("node"), "id"), "node").join(names.select(F.col("n").alias("root"), F.col("id").alias("least")), "root").select(F.col("id").alias("node"),
        F.col("least").alias("root"))


def positions(nodes: DataFrame) -> DataFrame:
    """(id, n): distinct ids with their place in order, from 0."""
    return running_sums(nodes, [F.col("id")], {"n": F.lit(1)}).select("id", F.col("n").cast("long").alias("n"))


def numbered_components(edges: DataFrame) -> DataFrame:
    """strong_components of nodes that are numbers."""
    short, inner, rings = chains(edges)
    core = kept(short_components(short.select("a", "b")), "scc-core")
    head, tail = (core.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("head", "tail"))
    ends = inner.join(head, "head", "left").join(tail, "tail", "left").withColumn("root", F.when(F.col("head") == F.col("tail"), F.coalesce("head_root", "head"))
        .when(F.col("head_root") == F.col("tail_root"), F.col("head_root"))).where("root IS NOT NULL")
    bases = ends.where("head = tail AND head_root IS NULL").select(F.col("head").alias("node"), F.col("head").alias("root"))
    every = kept(core.unionByName(ends.select("node", "root")).unionByName(bases).distinct(), "scc-all")
    least = every.groupBy("root").agg(F.min("node").alias("least"))
    return every.join(least, "root").select("node", F.col("least").alias("root")).unionByName(rings)


def short_components(edges: DataFrame) -> DataFrame:
    """strong_components without the shortening of chains.

    On the cyclic core, forward colours (the least node that reaches one) are spread to a fixed point; inside a colour, what reaches back to its root is that root's component. It is taken out and the rest goes on.
    """
    left, out = cyclic_core(edges), None
    while not left.isEmpty():
        colour = kept(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("c", F.col("id")), "colour")
        while True:
            came = left.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
            new = kept(colour.join(came, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")), "colour")
            moved = new.where("c != old").isEmpty()
            colour = new.select("id", "c")
            if moved:
                break
        same = kept(left.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a")
            .join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "same")
        reach = kept(colour.where("id = c"), "reach")
        front = reach
        while True:
            front = kept(same.select("a", F.col("b").alias("id")).join(front.select("id"), "id").select(F.col("a").alias("id")).distinct()
                .join(reach.select("id"), "id", "left_anti").join(colour, "id"), "reach")
            if front.isEmpty():
                break
            reach = kept(reach.unionByName(front), "reach")
        found = reach.select(F.col("id").alias("node"), F.col("c").alias("root"))
        out = found if out is None else kept(out.unionByName(found), "scc")
        gone = reach.select("id")
        left = cyclic_core(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    big = out.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return out.join(big, "root", "left_semi").select("node", "root")


def tiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, tier): 0 without dependencies, else one more than the highest of them; nodes of cycles and behind them come last, together.

    Chains are one edge of their length each, so a round settles all nodes whose dependencies are settled, however long the ways between them.
    Nodes are numbered, so what is shuffled and written round by round is numbers.
    """
    names = kept(positions(nodes.select("id").distinct()), "topo")
    ids = names.select(F.col("n").alias("id"))
    named = edges.select("a", "b").where("a != b").join(names.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
    all_ = kept(named.join(names.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b", "left").select(F.col("na").alias("a"), F.col("nb").alias("b")), "topo")
    known = all_.where("b IS NOT NULL")
    lost = all_.where("b IS NULL").select(F.col("a").alias("node")).distinct()  # what depends on something that isn't there
    short, inner, rings = chains(known, lost)
    inside = inner.select(F.col("node").alias("id")).unionByName(rings.select(F.col("node").alias("id")))
    waiting = kept(ids.join(inside, "id", "left_anti").withColumn("tier", F.lit(0).cast("long")), "topo")
    looped = inner.where("head = tail").select(F.col("head").alias("node")).distinct()  # a chain that ends where it begins
    deps = kept(short.unionByName(lost.union(looped).distinct().select(F.col("node").alias("a"), F.lit(None).cast(dict(short.dtypes)["b"]).alias("b"), F.lit(1).cast("long").alias("steps"))), "topo")
    done, before = None, None
    while True:
        ready = kept(waiting.join(deps.select(F.col("a").alias("id")), "id", "left_anti"), "topo")
        if ready.isEmpty():
            break
        done = ready if done is None else kept(done.unionByName(ready), "topo")
        met = deps.join(ready.select(F.col("id").alias("b"), "tier"), "b")
        best = met.groupBy(F.col("a").alias("id")).agg(F.max(F.col("tier") + F.col("steps")).alias("best"))
        rest = waiting.join(ready.select("id"), "id", "left_anti").join(best, "id", "left")
        new = kept(rest.select("id", F.greatest("tier", F.coalesce("best", F.lit(0))).alias("tier")), "topo"), kept(deps.join(ready.select(F.col("id").alias("b")), "b",
            "left_anti").select("a", "b", "steps"), "topo")
        for df in before or ():
            drop(df)
        before = waiting, deps, ready if done is not ready else None
        before = tuple(x for x in before if x is not None)
        waiting, deps = new
    settled = waiting.limit(0) if done is None else done
    along = inner.join(settled.select(F.col("id").alias("tail"), "tier"), "tail").select(F.col("node").alias("id"), (F.col("tier") + F.col("steps")).alias("tier"))
    placed = kept(settled.select("id", "tier").unionByName(along), "topo")
    last = placed.agg((F.coalesce(F.max("tier"), F.lit(-1)) + 1).alias("last"))
    behind = ids.join(placed.select("id"), "id", "left_anti").join(F.broadcast(last)).select("id", F.col("last").alias("tier"))  # one row
    return placed.unionByName(behind).withColumnRenamed("id", "n").join(names, "n").select("id", F.col("tier").cast("int").alias("tier"))


def decay(edges: DataFrame, scores: DataFrame, stale: DataFrame, hops: int = 3, factor: float = 0.95) -> DataFrame:
    """(id, score): stale nodes at zero, all within hops of them at factor times their score once, whatever the distance."""
    near = edges.select("source", "target").union(edges.select("target", "source")).toDF("a", "b").distinct()
    ids = scores.select("id")
    near = near.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    seen = kept(stale.select("id", F.lit(0).alias("hop")), "decay")
    front = seen
    for hop in range(1, hops + 1):
        front = kept(near.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
            .withColumn("hop", F.lit(hop)), "decay")
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front), "decay")
    return seen.join(scores, "id").select("id", F.when(F.col("hop") == 0, 0.0).otherwise(F.round(F.col("score") * factor, 3)).alias("score"))


def proximity(files: DataFrame, known: DataFrame, most: int = 20, least: float = 0.3) -> DataFrame:
    """Pairs of files of one folder (2 to most of them), the less sure the larger it is, without those already linked either way."""
    size = files.groupBy("folder").agg(F.count("*").alias("n")).where(f"n BETWEEN 2 AND {most}")
    f = files.join(size, "folder")
    pairs = f.select("folder", "n", F.col("path").alias("a")).join(f.select("folder", F.col("path").alias("b")), "folder").where("a < b")
    linked = known.select("a", "b").union(known.select("b", "a"))
    return pairs.join(linked, ["a", "b"], "left_anti").select("a", "b", F.round(F.greatest(F.lit(least), 0.7 - 0.04 * F.col("n")), 6).alias("confidence"))


def cochange(commits: DataFrame, now: str, half_life: float = 90.0, least_commits: int = 3, least: float = 0.25, basket: int = 30) -> DataFrame:
    """Pairs of files changed together in commits of 2 to basket files, weighted by age: weighted Jaccard and support.

    Files are numbered in the order of their paths, so the pairs that are shuffled hold three numbers; the paths come back to those that are left.
    """
    size = commits.select("commit_id", "path").distinct().groupBy("commit_id").agg(F.count("*").alias("m")).where(f"m BETWEEN 2 AND {basket}")
    age = F.datediff(F.lit(now).cast("date"), F.col("ts").cast("date"))
    named = kept(commits.select("commit_id", "path", "ts").dropDuplicates(["commit_id", "path"]).join(size, "commit_id").select("commit_id", "path", F.exp(-F.log(F.lit(2.0)) * age
        / half_life).alias("w")), "baskets")
    alone = kept(numbered(named.where("path IS NOT NULL").groupBy("path").agg(F.sum("w").alias("total")), [F.col("path")], "n"), "changed-files")
    rows = named.join(alone.select("path", "n"), "path").select("commit_id", "w", "n")
    both = rows.select("commit_id", "w", F.col("n").alias("na")).join(rows.select("commit_id", F.col("n").alias("nb")),
        "commit_id").where("na < nb").groupBy("na", "nb").agg(F.sum("w").alias("shared")).where(F.col("shared") >= least_commits * 0.5)
    j = both.join(alone.select(F.col("n").alias("na"), F.col("path").alias("a"), F.col("total").alias("ta")),
        "na").join(alone.select(F.col("n").alias("nb"), F.col("path").alias("b"), F.col("total").alias("tb")), "nb")
    weight = F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared"))
    return j.where(weight >= least).select("a", "b", F.round(weight, 6).alias("jaccard"), F.round("shared", 6).alias("support"))


TURNS = 62  # rounds after which the turns of nodes begin anew


def moved_labels(near: DataFrame, nodes: DataFrame, whole: float, resolution: float, rounds: int) -> DataFrame:
    """(id, community) after rounds of local moves: a node goes to the community around it of the highest modularity gain, ties to the least.

    near has (a, b, w, k) in both directions without loops, k being the degree of a, nodes (id, k, turns), whole the sum of degrees. The bits of turns say in which rounds a node may move: about half may in each,
    so that neighbours don't swap places for ever. A community's total comes along with its members, and where a node is with the node's own row, so a round shuffles the edges for one join and one sum.
    """
    label = nodes.select("id", "k", "turns", F.col("id").alias("community"))
    still, old = 0, []
    for turn in range(rounds):
        placed = label.join(label.groupBy("community").agg(F.sum("k").alias("total")), "community")
        around = near.join(placed.select(F.col("id").alias("b"), "community", "total"), "b").select(F.col("a").alias("id"), "community", "total", "k", "w", F.lit(None).cast("long").alias("turns"))
        offers = around.unionByName(placed.select("id", "community", "total", "k", F.lit(0.0).alias("w"), "turns")).groupBy("id", "community").agg(F.max("total").alias("total"),
            F.max("k").alias("k"), F.sum("w").alias("w"), F.max("turns").alias("turns"))
        here = F.col("turns").isNotNull()
        gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / whole
        best = offers.groupBy("id").agg(F.min(F.struct((-F.round(gain, 9)).alias("loss"), (~here).alias("away"), "community")).alias("best"), F.max("k").alias("k"), F.max("turns").alias("turns"),
            F.max(F.when(here, F.col("community"))).alias("own"))
        may = F.shiftright("turns", turn % TURNS).bitwiseAND(F.lit(1)) == 1
        new = kept(best.select("id", "k", "turns", F.when(may, F.col("best.community")).otherwise(F.col("own")).alias("community"), (may & (F.col("best.community") != F.col("own"))).alias("moved")), "louvain", small=True)
        still = still + 1 if new.where("moved").isEmpty() else 0
        label = new.drop("moved")
        for df in old:
            drop(df)
        old = [new]
        if still == 3:
            break
    return label.select("id", "community")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 4) -> DataFrame:
    """(id, community) of high modularity on weighted undirected edges (a, b, w): rounds of local moves, then the same on the graph of communities, level by level.

    A community is named by its least member. Loops, nulls and weights that aren't positive are left out. Nodes are numbered in the order of their ids, so what is shuffled in each round is numbers.
    """
    fine = kept(edges.where("a is not null and b is not null and a != b and w > 0").select("a", "b", F.col("w").cast("double").alias("w")), "louvain")
    turns = reduce(Column.bitwiseOR, (F.shiftleft((F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0).cast("long"), turn) for turn in range(min(rounds, TURNS))), F.lit(0).cast("long"))
    names = kept(running_sums(fine.select(F.col("a").alias("id")).union(fine.select("b")).distinct(), [F.col("id")], {"n": F.lit(1)}).select("id", F.col("n").cast("long").alias("n"), turns.alias("turns")), "louvain")
    number = lambda side: names.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"))
    pairs = fine.join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "w")
    near = kept(pairs.union(pairs.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "louvain")
    whole = near.agg(F.sum("w")).first()[0]
    if not whole:
        return names.select("id", F.col("id").alias("community"))
    found = names.select(F.col("n").alias("id"), F.col("n").alias("community"))
    weight = near.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    for _ in range(levels):
        nodes = kept(weight.join(names.select(F.col("n").alias("id"), "turns"), "id").select("id", "k", "turns"), "louvain", small=True)
        near = kept(near.join(nodes.select(F.col("id").alias("a"), "k"), "a").select("a", "b", "w", "k"), "louvain")
        step = kept(moved_labels(near, nodes, whole, resolution, rounds), "louvain", small=True)
        if step.where("id != community").isEmpty():
            break
        found = kept(found.join(step.select(F.col("id").alias("community"), F.col("community").alias("next")), "community")
            .select("id", F.col("next").alias("community")), "louvain", small=True)
        of = lambda side: step.select(F.col("id").alias(side), F.col("community").alias(f"c{side}"))
        weight = nodes.join(step, "id").groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k"))
        near = kept(near.join(of("a"), "a").join(of("b"), "b").where("ca != cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b"))
            .agg(F.sum("w").alias("w")), "louvain")
    least = found.groupBy("community").agg(F.min("id").alias("name"))
    named = found.join(least, "community").join(names.select(F.col("n").alias("id"), F.col("id").alias("own")), "id")
    return named.join(names.select(F.col("n").alias("name"), F.col("id").alias("first")), "name").select(F.col("own").alias("id"), F.col("first").alias("community"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: the modularity q of a labelling (id, community) on weighted undirected edges (a, b, w)."""
    ends = edges.join(label.select(F.col("id").alias("a"), F.col("community").alias("ca")),
        "a").join(label.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = ends.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    total = ends.select(F.col("ca").alias("c"), "w").union(ends.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("t"))
    return total.agg(F.sum(F.col("t") * F.col("t")).alias("squares")).join(inside).select((F.col("inside") / F.col("all") - F.col("squares") / (4 * F.col("all") * F.col("all"))).alias("q"))


def tag_clusters(entries: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, tag, cluster) of entries (id, tag): each tag's entries split by edges (a, b) between them; parts under least, and entries without a tag, are uncategorized."""
    tags = entries.select("id", F.coalesce("tag", F.lit("uncategorized")).alias("tag"))
    inside = edges.join(tags.select(F.col("id").alias("a"), F.col("tag").alias("ta")), "a").join(tags.select(F.col("id").alias("b"), F.col("tag").alias("tb")),
        "b").where("ta = tb")
    roots = components(inside.select("a", "b"))
    rows = tags.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    size = rows.groupBy("tag", "root").agg(F.count("*").alias("n"))
    large = (F.col("n") >= least) & (F.col("tag") != "uncategorized")
    return rows.join(size, ["tag", "root"]).select("id", F.when(large, F.col("tag")).otherwise("uncategorized").alias("tag"),
        F.when(large, F.col("root")).alias("cluster"))


def clusters(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, representative, size) of concepts that pairs connect: the surest is the representative, ties to the least id."""
    roots = components(pairs.select("a", "b"))
    rows = roots.select(F.col("node").alias("id"), "root").join(concepts, "id")
    best = rows.groupBy("root").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "id")).alias("r"), F.count("*").alias("size"))
    return rows.join(best, "root").select("id", F.col("r.id").alias("representative"), "size")


def reused(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """Each new module with the old one that overlaps it most, above least and short of all."""
    n, o = new.groupBy("module").agg(F.count("*").alias("nn")), old.groupBy(F.col("module").alias("old")).agg(F.count("*").alias("no"))
    both = new.join(old.select(F.col("module").alias("old"), "path"), "path").groupBy("module", "old").agg(F.count("*").alias("c")).join(n, "module").join(o,
        "old")
    j = both.withColumn("jaccard", F.round(F.col("c") / (F.col("nn") + F.col("no") - F.col("c")), 6)).where(f"jaccard > {least} AND jaccard < 1")
    return first_n(j.select("module", "old", "jaccard"), ["module"], [F.desc("jaccard"), "old"], 1)


def every(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def architecture(edges: DataFrame) -> DataFrame:
    """All layers of folders at once, from edges between files (source, target: paths): layer, way, source, target, n.

    An edge is inside the lowest folder that holds both its ends, between that folder's two members; for every folder below that on either side it
    leaves or enters, towards the other end's member of the common folder. Drilling into a folder is a filter on layer.
    """
    a, b = F.split("source", "/"), F.split("target", "/")
    most = F.least(F.size(a), F.size(b)) - 1
    # folders that both paths share
    same = F.size(F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), lambda i: (i < most) & (F.slice(a, F.lit(1), i + 1) == F.slice(b, F.lit(1), i + 1))))
    part = lambda p, k: F.array_join(F.slice(p, F.lit(1), k), "/")
    rows = edges.where("source <> target").withColumn("same", same)
    k = F.col("same")
    # what the layers on one side hold depends on that side's path and the other's member alone, which far fewer rows name than edges do
    side = lambda way, own, other: F.struct(F.lit(way).alias("way"), own.alias("own"), k.alias("same"), part(other, k + 1).alias("other"))
    sides = rows.select(F.explode(F.array(side("leaves", F.col("source"), b), side("enters", F.col("target"), a))).alias("s"))
    few = sides.groupBy("s.way", "s.own", "s.same", "s.other").agg(F.count("*").alias("n"))
    p, other, leaves = F.split("own", "/"), F.col("other"), F.col("way") == "leaves"
    row = lambda layer, way, x, y: F.struct(layer.alias("layer"), way.alias("way"), x.alias("source"), y.alias("target"))
    inside = F.when(leaves, F.array(row(part(p, k), F.lit("inside"), part(p, k + 1), other)))
    deeper = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: (i > k) & (i < F.size(p)))
    below = F.transform(deeper, lambda i: row(part(p, i), F.col("way"), F.when(leaves, part(p, i + 1)).otherwise(other), F.when(leaves, other).otherwise(part(p, i + 1))))
    every = few.select(F.explode(F.concat(F.coalesce(inside, F.slice(below, 1, 0)), below)).alias("e"), "n")
    return every.groupBy("e.layer", "e.way", "e.source", "e.target").agg(F.sum("n").alias("n"))


def members(files: DataFrame) -> DataFrame:
    """(layer, member): each folder and what lies in it, folders and files, from paths; the top layer is ''."""
    parts = F.split("path", "/")
    step = lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("layer"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("member"))
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), step)).alias("m")).select("m.layer", "m.member").distinct()


def orphans(files: DataFrame, layers: DataFrame) -> DataFrame:
    """(layer, member) of the members of folders that no edge touches in their layer."""
    own = layers.select("layer", F.explode(F.when(F.col("way") == "leaves", F.array("source")).when(F.col("way") == "enters", F.array("target")).otherwise(F.array("source",
        "target"))).alias("member")).distinct()
    return members(files).join(own, ["layer", "member"], "left_anti")
