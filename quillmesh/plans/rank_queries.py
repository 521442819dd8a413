"""Registered windows, top lists, set operations, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jo
from ..operators import rank as op
from ..operators import sinks
from ..sources.scratch import scratch_path
from .aggregate_queries import LINKED_SQL, scored_docs
from .registry import query

APR = """CASE WHEN count(*) OVER () = 1 THEN 0.5::DOUBLE
    ELSE (rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) END"""

query("win_percentile_norm", lambda c: op.with_rank_share(c.nodes.where("kind = 'file'"), "size", "share").select("id", F.round("share", 8).alias("share")),
    f"SELECT id, round({APR}, 8) AS share FROM (SELECT id, size AS v FROM nodes WHERE kind = 'file')")
query("win_hub_percentile", lambda c: op.with_share_below(c.commits.groupBy("path").agg(F.count("*").alias("m")), "m", "share")
    .select("path", F.round("share", 8).alias("below")),
    "SELECT path, round((rank() OVER (ORDER BY count(*)) - 1) / (count(*) OVER ())::DOUBLE, 8) AS below FROM commits GROUP BY path")
query("win_latest_run", lambda c: op.latest(c.items, ["category", "source"], [F.desc("created_at"), F.desc("id")]).select("id", "category", "source"),
    "SELECT id, category, source FROM (SELECT *, row_number() OVER (PARTITION BY category, source ORDER BY created_at DESC, id DESC) AS r FROM items) WHERE r = 1")
query("win_runs", lambda c: c.items.where("category = 'security' AND status = 'F'").orderBy(F.desc("created_at"), F.desc("id")).limit(20)
    .select("id", "created_at"), "SELECT id, created_at FROM items WHERE category = 'security' AND status = 'F' ORDER BY created_at DESC, id DESC LIMIT 20")
query("win_latest_events", lambda c: c.events.join(F.broadcast(c.events.agg(F.max("ts").alias("last"))), F.col("ts") >= F.expr("last - INTERVAL 12 HOURS"))
    .select("event_id", "ts"), "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
query("win_burndown", lambda c: op.burndown(c.items.select(F.to_date("created_at").alias("day")), c.items.where("status = 'F'").select(F.date_add(F.to_date("created_at"), 30).alias("day"))).select(F.col("day").cast("string").alias("day"), "change", "open"), """WITH e AS (SELECT created_at::DATE AS day, 1 AS d FROM items UNION ALL SELECT created_at::DATE + 30, -1 FROM items
    WHERE status = 'F'), s AS (SELECT day, sum(d)::BIGINT AS change FROM e GROUP BY 1)
    SELECT day::VARCHAR AS day, change, (sum(change) OVER (ORDER BY day))::BIGINT AS open FROM s""")
SERIES = "s AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS v FROM events)"
series = lambda c: c.events.selectExpr("user_id AS k", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i", "value AS v")
SG = """n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM s), d AS (SELECT a.k, a.i, a.v, a.n, (m2.v - 8 * m1.v + 8 * p1.v - p2.v) / 12.0::DOUBLE AS d FROM n a
JOIN n m2 ON m2.k = a.k AND m2.i = CASE WHEN a.i - 2 < 1 THEN 2 - (a.i - 2) ELSE a.i - 2 END JOIN n m1 ON m1.k = a.k AND m1.i = CASE WHEN a.i - 1 < 1 THEN 2 - (a.i - 1) ELSE a.i - 1 END
JOIN n p1 ON p1.k = a.k AND p1.i = CASE WHEN a.i + 1 > a.n THEN 2 * a.n - (a.i + 1) ELSE a.i + 1 END JOIN n p2 ON p2.k = a.k AND p2.i = CASE WHEN a.i + 2 > a.n THEN 2 * a.n - (a.i + 2) ELSE a.i + 2 END WHERE a.n >= 5)"""
query("win_sg_derivative", lambda c: op.smooth_derivative(series(c), ["k"], "i", "v").where("derivative IS NOT NULL")
    .select("k", "i", (F.round("derivative", 6) + 0.0).alias("derivative")),
    f"WITH {SERIES}, {SG} SELECT k, i::INT AS i, round(d, 6) + 0.0::DOUBLE AS derivative FROM d")
query(
    "win_boundaries",
    lambda c: op.spaced(op.valleys(series(c), ["k"], "i", "v", 0.3).select("k", "i"), ["k"], "i", 3),
    f"""WITH RECURSIVE {SERIES}, {SG}, b AS (SELECT *, lag(d) OVER (PARTITION BY k ORDER BY i) AS before FROM d),
    p AS (SELECT k, i FROM b WHERE before < 0 AND d >= 0 AND v <= (SELECT quantile_cont(v, 0.3) FROM s WHERE s.k = b.k)),
    r AS (SELECT k, min(i) AS i FROM p GROUP BY 1 UNION ALL SELECT r.k, min(p.i) FROM r JOIN p ON p.k = r.k AND p.i >= r.i + 3 GROUP BY r.k, r.i) SELECT k, i FROM r""",
)
query(
    "win_min_distance",
    lambda c: op.spaced(c.events.select(F.col("user_id").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("i")).distinct(), ["k"], "i", 50_000),
    """WITH RECURSIVE p AS (SELECT DISTINCT user_id AS k, floor(epoch(ts))::BIGINT AS i FROM events),
    r AS (SELECT k, min(i) AS i FROM p GROUP BY 1 UNION ALL SELECT r.k, min(p.i) FROM r JOIN p ON p.k = r.k AND p.i >= r.i + 50000 GROUP BY r.k, r.i) SELECT k, i FROM r""",
)
query("win_adaptive_k", lambda c: op.adaptive_cut(c.concepts.select(F.col("module").alias("q"), "id",
    (F.col("confidence") * (F.col("id") % 3 + 1)).alias("score")), ["q"], "score", "id", 0.15, 10).select("q", "id", "rank"),
      """WITH r AS (SELECT module AS q, id, confidence::DOUBLE * (id % 3 + 1) AS score
          FROM concepts), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank
          FROM r), d AS (SELECT *, lag(score) OVER (PARTITION BY q ORDER BY rank) - score > 0.15 * first_value(score) OVER (PARTITION BY q
          ORDER BY rank) AS g FROM k WHERE rank <= 10) SELECT q, id, rank::INT AS rank
          FROM (SELECT *, max(coalesce(g, false)::INT) OVER (PARTITION BY q ORDER BY rank) AS gone FROM d) WHERE gone = 0""")
query("win_dedup_file", lambda c: op.latest(c.commits.select("path", "commit_id", "added"), ["path"], [F.desc("added"), "commit_id"]), """SELECT path, commit_id, added FROM (SELECT path, commit_id, added, row_number() OVER (PARTITION BY path ORDER BY added DESC, commit_id) AS r
    FROM commits) WHERE r = 1""")
query("win_hub_chunk", lambda c: op.latest(c.concepts, ["module"], [F.when(F.col("kind").contains("PROMO"), 0).otherwise(1), F.desc("confidence"), "id"]).select("module", "id"), """SELECT module, id FROM (SELECT module, id, row_number() OVER (PARTITION BY module ORDER BY CASE WHEN contains(kind, 'PROMO') THEN 0
    ELSE 1 END, confidence DESC, id) AS r FROM concepts) WHERE r = 1""")
query("top_search_nodes", lambda c: op.symbol_search(c.nodes, "12", 50).select("id", "score"), """SELECT id, score FROM (SELECT id, file_path, name, CASE WHEN lower(name) = '12' THEN 1.0::DOUBLE WHEN lower(name) LIKE '12%' THEN 0.8::DOUBLE
    WHEN lower(name) LIKE '%12%' THEN 0.6::DOUBLE WHEN lower(id) LIKE '%12%' THEN 0.4::DOUBLE END AS score FROM nodes) WHERE score IS NOT NULL
    ORDER BY score DESC, file_path, name, id LIMIT 50""")
DOT = "list_inner_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"
def dot():
    return F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored(c):
    """Each vector's inner product with that of vec_id 0: a one-row broadcast."""
    return c.vectors.join(F.broadcast(c.vectors.where("vec_id = 0").select(F.col("embedding").alias("q")))).where("vec_id != 0").select("vec_id", "label",
        dot().alias("score"))


query("top_knn", lambda c: scored(c).orderBy(F.desc("score"), "vec_id").limit(25).where("score >= 0.2").select("vec_id", F.round("score", 6).alias("score")), f"""SELECT vec_id, round(score, 6) AS score FROM (SELECT v.vec_id, {DOT} AS score FROM vectors v, vectors q WHERE q.vec_id = 0 AND v.vec_id <> 0
    ORDER BY score DESC, v.vec_id LIMIT 25) WHERE score >= 0.2""")
query("top_route", lambda c: scored(c).groupBy("label").agg(F.max("score").alias("score")).where("score >= 0.25").orderBy(F.desc("score"), "label").limit(3).select("label", F.round("score", 6).alias("score")), f"""SELECT label, round(max(score), 6) AS score FROM (SELECT v.label, {DOT} AS score FROM vectors v, vectors q WHERE q.vec_id = 0 AND v.vec_id <> 0)
    GROUP BY 1 HAVING max(score) >= 0.25 ORDER BY max(score) DESC, label LIMIT 3""")
query("top_sprint", lambda c: op.sprint(c.items.where("status IN ('O', 'P')").withColumn("active", F.col("status") == "P"), 15, "1998-09-01").select("id", "score"), """SELECT id, round(substr(priority, 2, 1)::INT * 10 - least(date_diff('day', created_at::DATE, DATE '1998-09-01') * 0.1::DOUBLE, 5.0::DOUBLE) - CASE
    WHEN status = 'P' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS score FROM items WHERE status IN ('O', 'P') ORDER BY score, id LIMIT 15""")
query("top_queue", lambda c: c.commits.select("path", "added").groupBy("path").agg(F.min("added").alias("score")).orderBy("score", "path").limit(30),
    "SELECT path, min(added) AS score FROM commits GROUP BY 1 ORDER BY score, path LIMIT 30")
query("top_validation_queue", lambda c: c.concepts.where("status = 'seed'").select("id", F.round(1 - F.col("confidence"), 6).alias("doubt"))
    .orderBy(F.desc("doubt"), "id").limit(40),
    "SELECT id, round(1 - confidence::DOUBLE, 6) AS doubt FROM concepts WHERE status = 'seed' ORDER BY doubt DESC, id LIMIT 40")
query("top_alerts", lambda c: op.alerts(c.events.selectExpr("user_id AS session", "event_type AS rule", "concat('f', event_id % 5) AS path",
    "CASE WHEN event_type = 'error' THEN 'review' WHEN event_type = 'view' THEN 'warn' ELSE 'inform' END AS severity"))
    .select("session", "rule", "path", "place", "state"),
      """SELECT session, rule, path, p::INT AS place, CASE WHEN p <= 3 THEN 'drained' ELSE 'queued' END AS state
          FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE rule WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, rule, path) AS p
          FROM (SELECT DISTINCT user_id AS session, event_type AS rule, 'f' || (event_id % 5)::VARCHAR AS path FROM events))""")
query("top_hotspots", lambda c: c.part_paths.join(c.commits.groupBy("path").agg(F.countDistinct("author").alias("imports")), "path", "left").where("p_size * 20 > 900 OR imports > 32").select("path", "p_size", "imports"), """SELECT path, p_size, imports FROM part_paths LEFT JOIN (SELECT path, count(DISTINCT author) AS imports FROM commits GROUP BY 1) USING (path)
    WHERE p_size * 20 > 900 OR imports > 32""")
query("top_planning_docs", lambda c: scored_docs(c).where("path LIKE '%.md'").orderBy(F.desc("score"), "path").limit(30),
    f"WITH {LINKED_SQL} SELECT path, score FROM c WHERE path LIKE '%.md' ORDER BY score DESC, path LIMIT 30")
query("top_graph_sort", lambda c: op.numbered(c.nodes.select("id", "file_path", "name", F.when(F.col("kind") == "file", 0).when(F.col("kind") == "symbol", 1)
    .otherwise(2).alias("k")), [F.col(x) for x in ("k", "file_path", "name", "id")]).select("id", "place"),
    "SELECT id, (row_number() OVER (ORDER BY CASE kind WHEN 'file' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END, file_path, name, id))::INT AS place FROM nodes")
query("set_layer_merge", lambda c: jo.overlay(scored(c).where("vec_id % 2 = 0"), scored(c).where("vec_id % 3 = 0").withColumn("score", F.col("score") * 1.1), "vec_id").orderBy(F.desc("score"), "vec_id").limit(8).select("vec_id", F.round("score", 6).alias("score")), f"""WITH s AS (SELECT v.vec_id, {DOT} AS score FROM vectors v, vectors q WHERE q.vec_id = 0 AND v.vec_id <> 0) SELECT vec_id, round(CASE
    WHEN vec_id % 3 = 0 THEN score * 1.1::DOUBLE ELSE score END, 6) AS score FROM s WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 ORDER BY CASE
    WHEN vec_id % 3 = 0 THEN score * 1.1::DOUBLE ELSE score END DESC, vec_id LIMIT 8""")
query("set_effective_excludes", lambda c: c.concepts.where("id % 2 = 0").select("a1").union(c.concepts.where("id % 3 = 0").select("a2"))
    .union(c.concepts.where("id % 5 = 0").select("module")).distinct().toDF("pattern"),
    "SELECT a1 AS pattern FROM concepts WHERE id % 2 = 0 UNION SELECT a2 FROM concepts WHERE id % 3 = 0 UNION SELECT module FROM concepts WHERE id % 5 = 0")
STATUS = "CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'unchanged' ELSE 'deleted' END"
status = lambda c: c.files.select("path", F.expr(STATUS).alias("status"))
query("set_all_known", lambda c: status(c).where("status != 'deleted'").select("path"), f"SELECT path FROM files WHERE {STATUS} <> 'deleted'")
query("set_should_process", lambda c: c.files.select("path", "size").join(status(c).where("status IN ('added', 'modified')"), "path", "left_semi"),
    f"SELECT path, size FROM files WHERE {STATUS} IN ('added', 'modified')")
query("set_scope_membership", lambda c: c.files.where("path LIKE 'src/%'").select("path").union(c.files.where("doc_id % 3 = 0").select("path")).distinct(),
    "SELECT path FROM files WHERE path LIKE 'src/%' OR doc_id % 3 = 0")
query(
    "set_dedupe_swarm",
    lambda c: op.latest(c.concepts.withColumn("tier", F.expr("CASE category WHEN 'constraint' THEN 2 WHEN 'architecture' THEN 1 ELSE 0 END"))
        .withColumn("anchors", F.size(F.array_distinct(F.array("a1", "a2")))),
                        ["a1", "kind"], [F.desc("tier"), F.desc("anchors"), F.desc(F.length("title")), "id"]).select("a1", "kind", "id"),
    """SELECT a1, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY a1, kind ORDER BY CASE category WHEN 'constraint' THEN 2 WHEN 'architecture' THEN 1 ELSE 0 END DESC,
    CASE WHEN a1 = a2 THEN 1 ELSE 2 END DESC, length(title) DESC, id) AS r FROM concepts) WHERE r = 1""",
)
query("set_sanitize_graph", lambda c: jo.valid_edges(c.edges.unionByName(c.edges), c.nodes.where("file_path NOT LIKE '%:%'")).groupBy("kind").agg(F.count("*").alias("n")), """SELECT kind, count(*) AS n FROM (SELECT DISTINCT source, target, kind FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id
    FROM nodes)) GROUP BY 1""")
query("set_merge_opportunities", lambda c: op.merge_kept_state(c.items.where("id % 2 = 0").select("id", "value", "dismissed"), c.items.where("id % 3 = 0").select("id", (F.col("value") + 1).alias("value")), "id", "dismissed"), """SELECT id, CASE WHEN id % 3 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN id % 2 = 0 THEN dismissed ELSE false END AS dismissed FROM items
    WHERE id % 2 = 0 OR id % 3 = 0""")
query("set_rationale_scope", lambda c: c.concepts.where(F.col("category").isin("constraint", "technical")).select("id", "category"),
    "SELECT id, category FROM concepts WHERE category IN ('constraint', 'technical')")
query(
    "set_worker_scopes",
    lambda c: op.scoped(c.concepts.select("id", "category"), [1, 3, 10]),
    """WITH s AS (SELECT * FROM (VALUES ('intent', 'architecture'), ('intent', 'domain'), ('intent', 'product'), ('rules', 'security'), ('rules', 'constraint'), ('rules', 'decision'), ('rules', 'tradeoff'),
      ('implementation', 'technical'), ('implementation', 'pattern'), ('implementation', 'process'), ('implementation', 'epistemic'), ('implementation', 'brand')) v(axis, category)),
    w AS (SELECT 1 AS size, 'all' AS worker, category FROM s UNION ALL SELECT 3, axis, category FROM s UNION ALL SELECT 10, category, category FROM s)
    SELECT size, worker, w.category, count(k.id) AS concepts FROM w LEFT JOIN concepts k ON k.category = w.category GROUP BY 1, 2, 3""",
)
query("set_upsert_antibody", lambda c: sinks.upsert(c.concepts.where("id % 2 = 0").select("id", F.col("title").alias("rule")), c.concepts.where("id % 3 = 0")
    .select("id", F.upper("title").alias("rule")), "id"),
    "SELECT id, CASE WHEN id % 3 = 0 THEN upper(title) ELSE title END AS rule FROM concepts WHERE id % 2 = 0 OR id % 3 = 0")
query("set_role_overrides", lambda c: c.concepts.where("id % 4 = 0").select(F.col("id").alias("role"), F.col("a1").alias("override"))
    .join(c.concepts.where("id % 6 = 0").select(F.col("id").alias("role"), F.col("a2").alias("pin")), "role", "full_outer"),
    "SELECT id AS role, CASE WHEN id % 4 = 0 THEN a1 END AS override, CASE WHEN id % 6 = 0 THEN a2 END AS pin FROM concepts WHERE id % 4 = 0 OR id % 6 = 0")
query("set_pins_reverse", lambda c: c.concepts.select("id", F.array("a1", "a2").alias("pins")).where(F.array_contains("pins", "area7")).select("id"),
    "SELECT id FROM concepts WHERE a1 = 'area7' OR a2 = 'area7'")
query("sink_prune_orphans", lambda c: sinks.prune(c.files.select("path", "size"), c.files.where("doc_id % 3 != 1").select("path"), "path"),
    "SELECT path, size FROM files WHERE doc_id % 3 <> 1")
query(
    "sink_prune_jsonl",
    lambda c: sinks.round_trip(sinks.prune(sinks.round_trip(c.observations.select("id", "file_path", "content"), "json"), c.observations.where("NOT stale")
        .select("file_path").distinct(), "file_path"), "json"),
    "SELECT id, file_path, content FROM observations WHERE file_path IN (SELECT file_path FROM observations WHERE NOT stale)",
)
query(
    "sink_prune_knowledge",
    lambda c: sinks.prune(c.vectors.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x")), c.documents.where("lang = 'en'").select(F.col("doc_id").alias("id")), "id"),
    """SELECT vec_id AS id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS x FROM vectors WHERE vec_id IN (SELECT doc_id FROM documents
        WHERE lang = 'en')""",
)
query("sink_prune_stale_delta", lambda c: c.files.where("doc_id % 2 = 0").select("path")
    .join(c.files.where("doc_id % 6 = 0").select("path"), "path", "left_anti"), "SELECT path FROM files WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0")
query("sink_history", lambda c: sinks.upsert(c.items.where("id % 2 = 0").select("id", "status"), c.items.where("id % 4 = 0")
    .select("id", F.lit("done").alias("status")), "id"), "SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status FROM items WHERE id % 2 = 0")
query("sink_evict", lambda c: sinks.evict(c.observations, 50).select("id", "project_id"), """SELECT id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY stale, created_at DESC, id DESC) AS r FROM observations)
    WHERE r <= 50""")
query("sink_purge", lambda c: c.events.where("ts >= timestamp_ntz'2024-01-20'").select("event_id"),
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def graph_files(c):
    """Nodes and edges, each written whole and read back, as kind and row in JSON."""
    rows = lambda df, kind: sinks.round_trip(df, "json").select(F.lit(kind).alias("part"), F.concat_ws("|", *df.columns).alias("row"))
    nodes = c.nodes.select("id", "kind", "name", "file_path", "language", F.coalesce(F.col("size").cast("string"), F.lit("-")).alias("size"))
    return rows(nodes, "node").unionByName(rows(c.edges.select("source", "target", "kind", "origin", "weight"), "edge"))


query(
    "sink_graph_atomic",
    graph_files,
    """SELECT 'node' AS part, concat_ws('|', id, kind, name, file_path, language, coalesce(size::VARCHAR, '-')) AS row FROM nodes
    UNION ALL SELECT 'edge', concat_ws('|', source, target, kind, origin, weight::VARCHAR) FROM edges""",
)
query(
    "sink_manifest",
    lambda c: sinks.round_trip(sinks.manifest(c.nodes, "nodes").unionByName(sinks.manifest(c.files, "files"))
        .unionByName(sinks.manifest(c.edges.withColumn("size", F.col("weight")), "edges")), "json"),
    """SELECT 'nodes' AS name, count(*) AS n, sum(size)::BIGINT AS bytes FROM nodes UNION ALL SELECT 'files', count(*), sum(size)::BIGINT FROM files
    UNION ALL SELECT 'edges', count(*), sum(weight)::BIGINT FROM edges""",
)
def vector_index(c):
    """Full, then incremental over an index in which a third of the hashes are old and some rows are gone."""
    hashed = lambda salt: c.vectors.select("vec_id", "embedding",
        F.md5(F.concat(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), salt).cast("binary")).alias("hash"))
    first = sinks.vectors_mode(c.spark, scratch_path(c.spark, "index"), hashed(F.when(F.col("label") % 3 == 0, "old").otherwise("")).where("label != 1"),
        None).drop("mode")
    return sinks.vectors_mode(c.spark, scratch_path(c.spark, "index"), hashed(F.lit("")).where("label != 2"), first)


query(
    "sink_vector_index",
    lambda c: vector_index(c).select("vec_id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x"), "mode"),
    "SELECT vec_id, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE, 6) AS x, 'incremental' AS mode FROM vectors WHERE label <> 2",
)
query("sink_export_csv", lambda c: sinks.round_trip(c.items.select("id", "priority", "category", "file_path"), "csv"),
    "SELECT id, priority, category, file_path FROM items")
query(
    "sink_export_md",
    lambda c: sinks.markdown(c.items.where("NOT dismissed"), 3),
    """SELECT category, '## ' || category || chr(10) || string_agg('- ' || id::VARCHAR || ' ' || file_path, chr(10) ORDER BY id) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM items WHERE NOT dismissed) WHERE r <= 3 GROUP BY category""",
)
query(
    "sink_export_sarif",
    lambda c: sinks.sarif_document(c.spark, scratch_path(c.spark, "sarif"), sinks.sarif(c.items), "audit")
        .select("part", F.ltrim(F.col("line"), F.lit(",")).alias("line")),
    """SELECT '1-head' AS part, '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"audit"}},"results":[' AS line UNION ALL SELECT '3-tail', ']}]}' UNION ALL
    SELECT '2-results', '{"ruleId":"rule/' || category || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || analyzer || ' ' || category
    || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file_path || '"}}}]}' FROM items""",
)
query("sink_audit_csv", lambda c: sinks.round_trip(c.events.select("event_id", "event_type", "user_id"), "csv"),
    "SELECT event_id, event_type, user_id FROM events")
