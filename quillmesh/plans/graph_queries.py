"""Registered graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregates as ag
from ..operators import graphs as op
from ..operators import joins as jo
from ..sources.scratch import kept
from .registry import query

IMPORTS = "i AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind = 'imports' AND target NOT LIKE 'ext:%' AND source <> target)"
imports = lambda c: c.edges.where("kind = 'imports' AND target NOT LIKE 'ext:%'").select(F.col("source").alias("a"), F.col("target").alias("b"))
#: Strong components of the import graph, in which suppliers import parts and parts suppliers: those of the suppliers first, by all ways over one part, then the parts between them.
SCC = f"""WITH RECURSIVE {IMPORTS},
    o AS (SELECT DISTINCT x.a, y.b FROM i x JOIN i y ON y.a = x.b WHERE x.a LIKE 'file:supplier/%'),
    r AS (SELECT a, b FROM o UNION SELECT r.a, o.b FROM r JOIN o ON r.b = o.a),
    m AS (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a),
    n AS (SELECT a, min(b) AS c FROM m GROUP BY a),
    t AS (SELECT a AS node, c FROM n UNION SELECT x.b, n.c FROM n JOIN i x ON x.a = n.a JOIN i y ON y.a = x.b JOIN n z ON z.a = y.b AND z.c = n.c),
    s AS (SELECT node, min(node) OVER (PARTITION BY c) AS root FROM t)"""
JOINED = f"""WITH RECURSIVE {IMPORTS},
    u AS (SELECT a AS s, b AS p FROM i WHERE a LIKE 'file:supplier/%' UNION SELECT b, a FROM i WHERE b LIKE 'file:supplier/%'),
    o AS (SELECT DISTINCT x.s AS a, y.s AS b FROM u x JOIN u y USING (p)),
    r AS (SELECT a, b FROM o UNION SELECT r.a, o.b FROM r JOIN o ON r.b = o.a),
    n AS (SELECT a, min(b) AS c FROM r GROUP BY a),
    t AS (SELECT a AS node, c FROM n UNION SELECT p, c FROM u JOIN n ON n.a = u.s)"""
#: What depends on what without cycles: suppliers on the parts they import, parts on their symbols.
LAYERED = "kind = 'contains' OR (kind = 'imports' AND origin = 'static')"

query("gr_impact", lambda c: op.impact(c.edges.select("source", "target"), c.nodes.where("file_path LIKE 'supplier/%'").orderBy("id").limit(1).select("id"), 2),
      """WITH s AS (SELECT min(id) AS id FROM nodes WHERE file_path LIKE 'supplier/%'), h1 AS (SELECT DISTINCT source AS id FROM edges
          WHERE target IN (SELECT id FROM s) AND source NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT source AS id FROM edges
          WHERE target IN (SELECT id FROM h1)) SELECT id, 1 AS distance FROM h1 UNION ALL SELECT id, 2 FROM h2 WHERE id NOT IN (SELECT id FROM h1)
          AND id NOT IN (SELECT id FROM s)""")
query("gr_scc", lambda c: op.strong_components(imports(c)), f"{SCC} SELECT node, root FROM s")
query(
    "gr_cycles",
    lambda c: op.strong_components(imports(c)).groupBy("root").agg(F.count("*").alias("size"))
    .withColumn("severity", F.when(F.col("size") >= 6, "high").when(F.col("size") >= 3, "moderate").otherwise("low")),
    f"""{SCC} SELECT root, count(*) AS size, CASE WHEN count(*) >= 6 THEN 'high' WHEN count(*) >= 3 THEN 'moderate' ELSE 'low' END AS severity FROM s
        GROUP BY root""",
)
query(
    "gr_cycles_file",
    lambda c: c.nodes.where("kind = 'file'").select("id")
        .join(op.strong_components(imports(c)).select(F.col("node").alias("id"), F.lit(True).alias("hit")), "id", "left")
    .select("id", F.coalesce("hit", F.lit(False)).alias("in_cycle")),
    f"{SCC} SELECT id, id IN (SELECT node FROM s) AS in_cycle FROM nodes WHERE kind = 'file'",
)
query(
    "gr_cycles_struct",
    lambda c: op.strong_components(imports(c)).groupBy("root")
        .agg(F.md5(F.array_join(F.array_sort(F.collect_set("node")), ",")).alias("members"), F.count("*").alias("size")),
    f"{SCC} SELECT root, md5(string_agg(node, ',' ORDER BY node)) AS members, count(*) AS size FROM s GROUP BY root",
)
query("gr_union_find", lambda c: op.components(imports(c)), f"{JOINED} SELECT node, min(node) OVER (PARTITION BY c) AS root FROM t")
PAIRS = "p AS (SELECT x.id AS a, y.id AS b FROM concepts x JOIN concepts y ON x.a1 = y.a1 AND x.kind = y.kind AND x.id < y.id)"
stars = lambda rows, keys: rows.join(rows.groupBy(*keys).agg(F.min("id").alias("b")), keys).where("id != b").select(F.col("id").alias("a"), "b")
query("gr_clusters", lambda c: op.clusters(c.concepts.select("id", "confidence"), stars(c.concepts.select("id", "a1", "kind"), ["a1", "kind"])), f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r
    JOIN e ON r.b = e.a), m AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a), f AS (SELECT id, first_value(id) OVER (PARTITION BY root
    ORDER BY confidence DESC, id) AS representative, count(*) OVER (PARTITION BY root) AS size FROM m JOIN concepts USING (id))
    SELECT id, representative, size FROM f""")
SHARED = """e AS (SELECT x.id AS a, y.id AS b FROM concepts x JOIN concepts y ON x.a1 = y.a1 AND x.kind = y.kind AND x.id <> y.id UNION SELECT x.id, y.id
    FROM concepts x JOIN concepts y ON x.a2 = y.a2 AND x.kind = y.kind AND x.id <> y.id)"""


def shared(c):
    """Concepts of one kind that share an anchor, each with the first of them: the same components as all pairs, in linear rows."""
    one = [stars(c.concepts.select("id", "kind", a), ["kind", a]) for a in ("a1", "a2")]
    return one[0].unionByName(one[1]).distinct()


query(
    "gr_components_tag",
    lambda c: op.tag_clusters(c.concepts.select("id", F.col("kind").alias("tag")), shared(c)),
    f"""WITH RECURSIVE {SHARED}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT id, kind, least(id, coalesce((SELECT min(b) FROM r WHERE a = id), id)) AS root FROM concepts),
    n AS (SELECT *, count(*) OVER (PARTITION BY kind, root) AS n FROM k)
    SELECT id, CASE WHEN n >= 2 THEN kind ELSE 'uncategorized' END AS tag, CASE WHEN n >= 2 THEN root END AS cluster FROM n""",
)
query("gr_louvain", lambda c: op.communities(c.edges.where("origin IN ('static', 'inferred')")
    .select(F.col("source").alias("a"), F.col("target").alias("b"), (F.col("weight") * F.col("confidence")).alias("w"))))
query(
    "gr_topo",
    lambda c: op.tiers(c.nodes.select("id"), c.edges.where(LAYERED).select(F.col("source").alias("a"), F.col("target").alias("b"))),
    f"""WITH e AS (SELECT source, target FROM edges WHERE {LAYERED}), s AS (SELECT DISTINCT source FROM e WHERE target LIKE 'sym:%'),
    t AS (SELECT id, CASE WHEN id IN (SELECT source FROM s) THEN 1 ELSE 0 END AS tier FROM nodes WHERE id NOT LIKE 'file:supplier/%')
    SELECT id, tier FROM t UNION ALL SELECT id, coalesce((SELECT max(t.tier) + 1 FROM e JOIN t ON t.id = e.target WHERE e.source = n.id), 0) AS tier FROM nodes n WHERE id LIKE 'file:supplier/%'""",
)
query(
    "gr_decay_bfs",
    lambda c: op.decay(c.edges, c.nodes.select("id", F.lit(0.8).alias("score")), c.nodes.where("kind = 'symbol' AND file_path LIKE 'part/Brand1%'")
        .select("id"), 2),
    """WITH e AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), k AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)),
    h0 AS (SELECT id FROM nodes WHERE kind = 'symbol' AND file_path LIKE 'part/Brand1%'), h1 AS (SELECT DISTINCT b AS id FROM k WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)),
    h2 AS (SELECT DISTINCT b AS id FROM k WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1))
    SELECT id, 0.0::DOUBLE AS score FROM h0 UNION ALL SELECT id, 0.76::DOUBLE FROM h1 UNION ALL SELECT id, 0.76::DOUBLE FROM h2""",
)
query(
    "gr_proximity",
    lambda c: op.proximity(c.part_paths.select(F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 200)).alias("folder"), "path"), file_links(c).withColumnsRenamed({"source": "a", "target": "b"})),
    """WITH d AS (SELECT p_brand || '/' || (p_partkey // 200) AS folder, path FROM part_paths), f AS (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM d),
    k AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind <> 'contains')
    SELECT x.path AS a, y.path AS b, round(greatest(0.3::DOUBLE, 0.7::DOUBLE - 0.04::DOUBLE * x.n), 6) AS confidence FROM f x JOIN f y ON x.folder = y.folder AND x.path < y.path WHERE x.n BETWEEN 2 AND 20
    AND NOT EXISTS (SELECT 1 FROM k WHERE (k.a = x.path AND k.b = y.path) OR (k.a = y.path AND k.b = x.path))""",
)
query("gr_cochange", lambda c: op.cochange(c.commits.groupBy(F.floor(F.col("commit_id") / 8).alias("commit_id"), "path").agg(F.min("ts").alias("ts")), "1998-09-01", 2000.0, 1, 0.1), """WITH r AS (SELECT commit_id // 8 AS k, path, min(ts) AS ts FROM commits GROUP BY 1, 2), z AS (SELECT k FROM r GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30),
      w AS (SELECT r.k, path, exp(-ln(2.0::DOUBLE) * date_diff('day', ts::DATE, DATE '1998-09-01') / 2000.0::DOUBLE) AS w FROM r JOIN z ON z.k = r.k), t AS (SELECT path, sum(w) AS t FROM w GROUP BY 1),
      b AS (SELECT x.path AS a, y.path AS b, sum(x.w) AS s FROM w x JOIN w y ON x.k = y.k AND x.path < y.path GROUP BY 1, 2)
      SELECT a, b, round(s / (p.t + q.t - s), 6) AS jaccard, round(s, 6) AS support FROM b JOIN t p ON p.path = a JOIN t q ON q.path = b WHERE s / (p.t + q.t - s) >= 0.1 AND s >= 0.5""")
query("gr_inferred", lambda c: jo.judged_hypotheses(c.edges.where("origin = 'inferred' AND confidence >= 0.5").select("source", "target", "confidence"), c.nodes, c.edges.where("origin = 'static'"), 0.5).select("source", "target", "verdict"), """SELECT source, target, CASE WHEN EXISTS (SELECT 1 FROM edges k WHERE k.origin = 'static' AND k.source = e.source
    AND k.target = e.target) THEN 'boosts_known' ELSE 'accepted' END AS verdict FROM edges e WHERE origin = 'inferred' AND confidence >= 0.5""")
query("gr_reuse_jaccard", lambda c: op.reused(c.modules.where("length(path) % 4 != 0"), c.modules, 0.5), """WITH n AS (SELECT module, count(*) AS n FROM modules GROUP BY 1), o AS (SELECT module, count(*) AS n FROM modules WHERE length(path) % 4 <> 0
    GROUP BY 1) SELECT n.module, o.module AS old, round(o.n / n.n::DOUBLE, 6) AS jaccard FROM n JOIN o USING (module) WHERE o.n / n.n::DOUBLE > 0.5
    AND o.n < n.n""")


def file_links(c):
    """Edges between files, one for each edge between what is in them; ends outside of the files keep their id."""
    own = lambda end: c.nodes.select(F.col("id").alias(end), F.col("file_path").alias(f"{end}_path"))
    both = c.edges.where("kind <> 'contains'").join(own("source"), "source", "left").join(own("target"), "target", "left")
    return both.select(F.coalesce("source_path", "source").alias("source"), F.coalesce("target_path", "target").alias("target"))


def layers(c):
    found = kept(op.architecture(file_links(c)), "layers")  # read twice
    alone = op.orphans(c.nodes.where("kind = 'file'").select(F.col("file_path").alias("path")), found)
    return found.unionByName(alone.select("layer", F.lit("orphan").alias("way"), F.col("member").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(0).cast("long").alias("n")))


query(
    "gr_architecture",
    layers,
    """WITH l AS (SELECT string_split(coalesce(x.file_path, e.source), '/') AS a, string_split(coalesce(y.file_path, e.target), '/') AS b FROM edges e LEFT JOIN nodes x ON x.id = e.source LEFT JOIN nodes y ON y.id = e.target WHERE e.kind <> 'contains'),
    s AS (SELECT a, b, len(list_filter(range(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS k FROM l WHERE a <> b),
    e AS (SELECT array_to_string(a[1:k], '/') AS layer, 'inside' AS way, array_to_string(a[1:k + 1], '/') AS source, array_to_string(b[1:k + 1], '/') AS target FROM s
      UNION ALL SELECT array_to_string(a[1:i], '/'), 'leaves', array_to_string(a[1:i + 1], '/'), array_to_string(b[1:k + 1], '/') FROM (SELECT *, unnest(range(k + 1, len(a))) AS i FROM s)
      UNION ALL SELECT array_to_string(b[1:i], '/'), 'enters', array_to_string(a[1:k + 1], '/'), array_to_string(b[1:i + 1], '/') FROM (SELECT *, unnest(range(k + 1, len(b))) AS i FROM s)),
    g AS (SELECT layer, way, source, target, count(*) AS n FROM e GROUP BY ALL),
    m AS (SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS layer, array_to_string(p[1:i], '/') AS member FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(file_path, '/') AS p FROM nodes WHERE kind = 'file')))
    SELECT * FROM g UNION ALL SELECT layer, 'orphan', member, NULL, 0 FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.layer = m.layer AND ((way <> 'enters' AND g.source = member) OR (way <> 'leaves' AND g.target = member)))""",
)
query("agg_degree_histogram", lambda c: ag.degrees(c.edges).groupBy("in_degree").agg(F.count("*").alias("n")), """SELECT in_degree, count(*) AS n FROM (SELECT id, sum(i)::BIGINT AS in_degree FROM (SELECT source AS id, 0 AS i FROM edges UNION ALL SELECT target, 1
    FROM edges) GROUP BY 1) GROUP BY 1""")
