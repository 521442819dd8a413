"""Registered aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregates as op
from ..operators import content, markdown, patterns, semi
from .registry import query
from .text_queries import TAGS_SQL

APR = lambda v: f"""CASE WHEN count(*) OVER () = 1 THEN 0.5::DOUBLE
    ELSE (rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) END"""  # noqa: E731
RAW_SQL = """deg AS (SELECT target AS id, count(*) AS n FROM edges WHERE kind = 'imports' GROUP BY 1), outs AS (SELECT source AS id, count(*) AS n FROM edges WHERE kind = 'imports' GROUP BY 1), syms AS (SELECT file_path, count(*) AS n FROM nodes WHERE kind = 'symbol' GROUP BY 1),
raw AS (SELECT file_path AS path, size // 40 AS lines, coalesce(deg.n, 0) AS fan_in, coalesce(outs.n, 0) AS fan_out, coalesce(syms.n, 0) AS symbols, language = 'typescript' AS circular, size // 10000 AS tech_debt, CASE WHEN length(file_path) % 3 > 0 THEN (size % 7000) / 7000.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM nodes LEFT JOIN deg USING (id) LEFT JOIN outs USING (id) LEFT JOIN syms USING (file_path) WHERE kind = 'file' AND size >= 2000)"""


def raw(c):
    imports = c.edges.where("kind = 'imports'")
    files = c.nodes.where("kind = 'file' AND size >= 2000")
    ins, outs = imports.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in")), imports.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    syms = c.nodes.where("kind = 'symbol'").groupBy("file_path").agg(F.count("*").alias("symbols"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return files.join(ins, "id", "left").join(outs, "id", "left").join(syms, "file_path", "left").select(F.col("file_path").alias("path"),
        F.floor(F.col("size") / 40).alias("lines"), zero("fan_in"), zero("fan_out"), zero("symbols"), (F.col("language") == "typescript").alias("circular"),
        F.floor(F.col("size") / 10000).alias("tech_debt"), F.when(F.length("file_path") % 3 > 0, (F.col("size") % 7000) / 7000.0).alias("confidence"))


def degree(c):
    return op.in_degrees(c.edges, ["imports"])


query("agg_in_degree", lambda c: op.in_degrees(c.edges, origins=["static", "inferred"]),
    "SELECT target AS id, count(*) AS in_degree FROM edges WHERE origin IN ('static', 'inferred') GROUP BY target")
query("agg_node_degree", lambda c: op.degrees(c.edges), """SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0
    FROM edges) GROUP BY id""")
query("agg_hub_files", lambda c: op.hub_files(c.nodes, c.edges), """SELECT f.id AS file_id, t.file_path, count(*) AS in_degree FROM edges e JOIN nodes t ON t.id = e.target JOIN nodes f ON f.file_path = t.file_path
    AND f.kind = 'file' WHERE origin <> 'external' GROUP BY 1, 2 ORDER BY in_degree DESC, file_path LIMIT 10""")
query("agg_churn", lambda c: op.churn(c.commits, "1996-01-01"), """SELECT path, count(DISTINCT commit_id) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, min(ts) AS first_seen,
    max(ts) AS last_seen, count(DISTINCT author) AS authors FROM commits WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY path""")
query("agg_hot_zones", lambda c: op.hot_zones(c.commits), """SELECT zone, commits FROM (SELECT *, count(*) OVER () AS n
    FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS zone, count(DISTINCT commit_id) AS commits FROM commits GROUP BY 1
    HAVING count(DISTINCT commit_id) >= 10)) WHERE n >= 3 ORDER BY commits DESC, zone LIMIT 5""")
query("agg_consensus", lambda c: op.consensus(c.observations, 2), """SELECT o.project_id, file_path, count(DISTINCT agent) AS agents, count(*) AS n, any_value(all_agents) AS all_agents,
    round(count(DISTINCT agent) / any_value(all_agents)::DOUBLE, 6) AS score FROM observations o
    JOIN (SELECT project_id, count(DISTINCT agent) AS all_agents FROM observations WHERE NOT stale GROUP BY 1) t ON t.project_id = o.project_id
    WHERE NOT stale GROUP BY 1, 2 HAVING count(DISTINCT agent) >= 2""")
query("agg_obs_stats", lambda c: c.observations.groupBy("project_id", "category")
    .agg(F.count("*").alias("total"), F.count_if("stale").alias("stale"), F.count_if(~F.col("stale")).alias("fresh")),
    "SELECT project_id, category, count(*) AS total, count(*) FILTER (stale) AS stale, count(*) FILTER (NOT stale) AS fresh FROM observations GROUP BY 1, 2")
query("agg_token_usage", lambda c: c.usage.where("ts >= timestamp_ntz'2024-01-10'").groupBy("task_id").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.sum("total_tokens").alias("total")), """SELECT task_id, sum(prompt_tokens)::BIGINT AS prompt, sum(completion_tokens)::BIGINT AS completion, sum(total_tokens)::BIGINT AS total FROM usage
    WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
query("agg_audit_tokens", lambda c: op.usage_sets(c.usage),
    "SELECT provider, model, task_id, sum(total_tokens)::BIGINT AS tokens, count(*) AS n FROM usage GROUP BY GROUPING SETS ((provider), (model), (task_id), ())")
query("agg_audit_count", lambda c: c.events.where("event_type = 'click' AND ts >= timestamp_ntz'2024-01-03'").agg(F.count("*").alias("n")),
    "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03'")
PRICES = [("model0", 0.15, 0.6), ("model1", 2.5, 10.0), ("model2", 0.0, 0.0)]
query("agg_cost", lambda c: c.usage.groupBy("model").agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("q"))
    .join(c.spark.createDataFrame(PRICES, "model string, a double, b double"), "model", "left")
    .select("model", F.round(F.col("p") / 1e6 * F.col("a") + F.col("q") / 1e6 * F.col("b"), 6).alias("cost")),
      """SELECT model, round(p / 1000000.0::DOUBLE * a + q / 1000000.0::DOUBLE * b, 6) AS cost
          FROM (SELECT model, sum(prompt_tokens) AS p, sum(completion_tokens) AS q FROM usage GROUP BY 1) LEFT
          JOIN (VALUES ('model0', 0.15::DOUBLE, 0.6::DOUBLE), ('model1', 2.5::DOUBLE, 10.0::DOUBLE), ('model2', 0.0::DOUBLE, 0.0::DOUBLE)) v(model, a,
          b) USING (model)""")
query("agg_budget", lambda c: c.usage.where("date_trunc('month', ts) = timestamp'2024-01-01'").groupBy("project_id").agg(F.sum("total_tokens").alias("used")).select("project_id", "used", F.when(F.col("used") >= 40000, "blocked").when(F.col("used") >= 32000, "warning").otherwise("ok").alias("state")), """SELECT project_id, sum(total_tokens)::BIGINT AS used, CASE WHEN sum(total_tokens) >= 40000 THEN 'blocked'
    WHEN sum(total_tokens) >= 32000 THEN 'warning' ELSE 'ok' END AS state FROM usage WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01' GROUP BY 1""")
#: A concept's score in six shapes of JSON, one of them broken, one of them text.
SHAPES = """CASE id % 7 WHEN 0 THEN '{"quality": {"confidence": ' || score || '}}' WHEN 1 THEN '{"id": ' || id || ', "meta": {"confidence": ' || score || '}}'
    WHEN 2 THEN '{"quality": null, "b": {"confidence": "high"}, "c": {"confidence": ' || score || '}}' WHEN 3 THEN '{"quality": {"confidence": "' || score || '"}}' WHEN 4 THEN '{"quality": {"confidence": ' || score
    WHEN 5 THEN '{"quality": 3, "meta": {"confidence": ' || score || '}}' ELSE '{"quality": {"confidence": null, "other": 1}, "z": {"confidence": true}}' END AS line"""
query(
    "agg_quality",
    lambda c: semi.quality(c.concepts.selectExpr("category", "id", "cast(cast(confidence as decimal(4, 2)) as string) AS score").selectExpr("category", SHAPES), "quality.confidence", ["category"]),
    """SELECT category, count(*) AS total, count(ok) AS valid, count(*) - count(ok) AS parse_errors, round(count(ok) / count(*)::DOUBLE, 3) AS success_rate, round(avg(ok), 3) AS mean, round(min(ok), 3) AS low, round(max(ok), 3) AS high
    FROM (SELECT category, CASE WHEN id % 7 IN (0, 1, 2) THEN confidence::DECIMAL(4, 2)::DOUBLE WHEN id % 7 = 6 THEN 1.0::DOUBLE END AS ok FROM concepts) GROUP BY 1""",
)
query("agg_epistemic_quality", lambda c: c.concepts.where("status = 'active'").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean")),
    "SELECT count(*) AS n, round(avg(confidence::DOUBLE), 3) AS mean FROM concepts WHERE status = 'active'")
query("agg_models", lambda c: c.usage.groupBy("model", "provider").agg(F.count("*").alias("n")),
    "SELECT model, provider, count(*) AS n FROM usage GROUP BY 1, 2")
query("agg_throughput", lambda c: c.usage.groupBy("task_id")
    .agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"),
    ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("s"))
    .select("task_id", F.round(F.try_divide("n", "s"), 8).alias("items_per_s"), F.round(F.try_divide("tokens", "s"), 6).alias("tokens_per_s")),
      """SELECT task_id, round(n / s, 8) AS items_per_s, round(t / s, 6) AS tokens_per_s
          FROM (SELECT task_id, count(*) AS n, sum(total_tokens)::DOUBLE AS t, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS s
          FROM usage GROUP BY 1)""")
query("agg_spaghetti", lambda c: op.file_scores(raw(c)),
      f"WITH {RAW_SQL}, s AS (SELECT path, round(0.25 * {APR('lines')} + 0.20 * {APR('fan_in')} + 0.10 * {APR('fan_out')} + 0.10 * {APR('symbols')} + 0.10 * circular::INT + 0.15 * {APR('tech_debt')} + 0.10 * (1 - {APR('confidence')}), 6) AS score FROM raw) SELECT path, score, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.5 THEN 'warning' ELSE 'info' END AS severity FROM s WHERE score >= 0.45")
query("agg_hub_zscore", lambda c: op.hub_outliers(degree(c), 1.5, 3),
      """WITH d AS (SELECT target AS id, count(*) AS in_degree FROM edges WHERE kind = 'imports'
          GROUP BY 1), s AS (SELECT avg(in_degree) AS m, stddev_samp(in_degree) AS sd, count(*) AS n FROM d)
          SELECT id, in_degree, round((in_degree - m) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END, 4) AS z FROM d, s WHERE n >= 5 AND (in_degree - m) / CASE
          WHEN sd > 1e-9 THEN sd ELSE 1 END >= 1.5 AND in_degree >= 3""")
query("agg_coupling", lambda c: op.coupling_hotspots(degree(c).join(c.nodes.where("kind = 'file'"), "id").select("file_path", "in_degree"), 1.0, 3),
      """WITH d AS (SELECT file_path, count(*) AS in_degree FROM edges JOIN nodes ON nodes.id = target WHERE edges.kind = 'imports'
          AND nodes.kind = 'file' GROUP BY 1), s AS (SELECT avg(in_degree) AS m, stddev_samp(in_degree) AS sd, count(*) AS n
          FROM d), k AS (SELECT *, (in_degree - m) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END AS z, (rank() OVER (ORDER BY in_degree) - 1) / n::DOUBLE AS p
          FROM d, s) SELECT file_path, in_degree, round(z, 4) AS z, round(least(1.0::DOUBLE, 0.4::DOUBLE * p), 4) AS risk FROM k WHERE z >= 1 AND in_degree >= 3""")
query("agg_risk", lambda c: c.concepts.select("id", F.round(op.risk(F.col("confidence"), F.col("category") == "constraint", F.col("category") == "architecture", (F.col("id") % 10) / 10.0, (F.col("id") % 4) / 4.0), 6).alias("risk")), """SELECT id, round(least(1.0::DOUBLE, 0.4 * confidence::DOUBLE + 0.3 * CASE category WHEN 'constraint' THEN 1.0::DOUBLE
    WHEN 'architecture' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.2 * (id % 10) / 10.0::DOUBLE + 0.1 * (id % 4) / 4.0::DOUBLE), 6) AS risk FROM concepts""")
query("agg_structural", lambda c: op.best_findings([degree(c)
    .select(F.lit("coupling").alias("finding_type"), F.col("id").alias("file_path"), F.round(F.col("in_degree") / 200.0, 4).alias("risk")),
    c.commits.groupBy("path").agg(F.count("*").alias("n"))
    .select(F.lit("churn").alias("finding_type"), F.col("path").alias("file_path"), F.round(F.col("n") / 300.0, 4).alias("risk"))]),
      """SELECT finding_type, file_path, risk FROM (SELECT 'coupling' AS finding_type, target AS file_path, round(count(*) / 200.0::DOUBLE, 4) AS risk
          FROM edges WHERE kind = 'imports' GROUP BY 2 UNION ALL SELECT 'churn', path, round(count(*) / 300.0::DOUBLE, 4) FROM commits GROUP BY 2)
          ORDER BY risk DESC, finding_type, file_path LIMIT 20""")
query(
    "agg_api_surface",
    lambda c: c.concepts.groupBy("module")
        .agg(F.count("*").alias("public"), F.count_if(F.col("status") == "active").alias("documented"),
        F.round(100.0 * F.count_if(F.col("status") == "active") / F.count("*"), 2).alias("pct")),
    """SELECT module, count(*) AS public, count(*) FILTER (status = 'active') AS documented,
    round(100.0::DOUBLE * count(*) FILTER (status = 'active') / count(*), 2) AS pct FROM concepts GROUP BY 1""",
)
query(
    "agg_tech_debt",
    lambda c: c.items.where("category = 'debt' AND NOT dismissed").groupBy(F.col("file_path").alias("module")).agg(F.count("*").alias("items"))
        .where("items >= 3"),
    "SELECT file_path AS module, count(*) AS items FROM items WHERE category = 'debt' AND NOT dismissed GROUP BY 1 HAVING count(*) >= 3",
)
query("agg_large_files", lambda c: c.nodes.where("kind = 'file' AND size >= 40000")
    .select("id", F.when(F.col("size") >= 80000, "critical").otherwise("warning").alias("severity")),
    "SELECT id, CASE WHEN size >= 80000 THEN 'critical' ELSE 'warning' END AS severity FROM nodes WHERE kind = 'file' AND size >= 40000")
query(
    "agg_staleness",
    lambda c: c.vectors.select(F.col("vec_id").alias("doc_id")).join(c.documents, "doc_id", "left_anti")
        .select(F.col("doc_id").cast("string").alias("path"), F.lit("orphan").alias("kind"))
    .unionByName(c.files.join(c.vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("path", F.lit("gap").alias("kind"))),
    """SELECT vec_id::VARCHAR AS path, 'orphan' AS kind FROM vectors WHERE vec_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT path, 'gap' FROM files WHERE doc_id NOT IN (SELECT vec_id FROM vectors)""",
)
query("agg_summary", lambda c: op.summary(c.items), """SELECT priority, category, source, analyzer, severity, count(*) AS n FROM items WHERE NOT dismissed
    GROUP BY GROUPING SETS ((priority), (category), (source), (analyzer), (severity))""")
GROUPED = """g AS (SELECT label, category, count(*) AS n, min(priority) AS p FROM k GROUP BY 1, 2)
    SELECT label, sum(n)::BIGINT AS n, min(p) AS priority, (SELECT category FROM g h WHERE h.label = g.label ORDER BY n DESC, category LIMIT 1) AS category
    FROM g GROUP BY label"""


def label():
    return F.when(F.col("category").isin("quality", "debt"), "Code Quality").otherwise(F.initcap("category"))


LABEL = "CASE WHEN category IN ('quality', 'debt') THEN 'Code Quality' ELSE upper(substr(category, 1, 1)) || substr(category, 2) END"
query("agg_consolidate_cat", lambda c: op.consolidated(c.items, label()), f"WITH k AS (SELECT *, {LABEL} AS label FROM items), {GROUPED}")
query(
    "agg_consolidate_file",
    lambda c: op.by_root_file(c.items),
    f"""WITH k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY file_path) >= 2 THEN 'Improve: ' || replace(file_path, 'part/', '')
        ELSE category END AS label FROM items), {GROUPED}""",
)
query("agg_consolidate_sev", lambda c: op.consolidated(c.items,
    F.when(F.col("priority").isin("P0", "P1"), F.concat(F.lit("item-"), F.col("id").cast("string"))).otherwise(label())),
    f"WITH k AS (SELECT *, CASE WHEN priority IN ('P0', 'P1') THEN 'item-' || id::VARCHAR ELSE {LABEL} END AS label FROM items), {GROUPED}")
query("agg_score_calibration", lambda c: op.node_scores(c.nodes.where("kind = 'file'")
    .select("id", (F.col("size") % 1000 / 1000.0).alias("confidence"), (F.col("size") % 3 == 0).alias("validated"), (F.col("size") % 7).alias("refs")),
    c.edges, c.nodes.where("kind = 'file' AND size % 4000 = 0").select("id", (F.col("size") / 2000 % 5).cast("int").alias("depth"))),
      """WITH b AS (SELECT source AS s, target AS t FROM edges UNION SELECT target, source FROM edges), e AS (SELECT id, ((size / 2000) % 5)::INT AS depth FROM nodes WHERE kind = 'file' AND size % 4000 = 0),
      c3 AS (SELECT s AS id, count(e.id) / count(*)::DOUBLE AS c3 FROM b LEFT JOIN e ON e.id = b.t WHERE t LIKE 'file:%' GROUP BY 1)
      SELECT n.id, round(0.2353::DOUBLE * coalesce((size % 1000) / 1000.0::DOUBLE, 0) + 0.1765::DOUBLE * CASE WHEN depth IS NOT NULL THEN 1.0::DOUBLE WHEN size % 3 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + 0.2353::DOUBLE * coalesce(c3, 0.5::DOUBLE) + 0.1765::DOUBLE * least(1.0::DOUBLE, (size % 7) / 4.0::DOUBLE) + 0.1764::DOUBLE * CASE WHEN depth IS NULL THEN 0.0::DOUBLE WHEN depth >= 4 THEN 1.0::DOUBLE WHEN depth >= 3 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END, 3) AS composite FROM nodes n LEFT JOIN c3 USING (id) LEFT JOIN e USING (id) WHERE kind = 'file'""")
query(
    "agg_convergence",
    lambda c: op.convergence(
        c.concepts.where("status = 'active'").select("id", (F.col("confidence") * 0.9).alias("score")),
            c.concepts.select("id", F.col("confidence").alias("score")), 0.6),
    """SELECT round(avg((confidence >= 0.6)::INT), 6) AS settled_ratio, round(avg(confidence::DOUBLE), 6) AS mean,
    round(max(CASE WHEN status = 'active' THEN abs(confidence::DOUBLE - confidence::DOUBLE * 0.9::DOUBLE) ELSE confidence::DOUBLE END), 6) AS max_residual FROM concepts""",
)
query(
    "agg_segments",
    lambda c: op.segments(c.files, 26, 5, 0.2),
    """WITH f AS (SELECT split_part(path, '/', 1) AS top, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS sub FROM files),
    g AS (SELECT CASE WHEN count(*) OVER (PARTITION BY top) > 0.2 * count(*) OVER () THEN sub ELSE top END AS s FROM f), n AS (SELECT s, count(*) AS n FROM g GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, s) AS r FROM n)
    SELECT CASE WHEN n >= 26 AND r <= 5 THEN s ELSE 'root' END AS segment, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
)
query("agg_routing_desc", lambda c: op.segment_descriptors(c.part_paths.select(F.col("p_brand").alias("segment"), F.col("p_type").alias("tag")),
    c.commits.groupBy("path").agg(F.count("*").alias("degree")).join(c.modules, "path").select(F.col("module").alias("segment"), "path", "degree")),
      """WITH t AS (SELECT p_brand AS segment, p_type AS tag, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r
          FROM part_paths GROUP BY 1, 2), h AS (SELECT module AS segment, path, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, path) AS r
          FROM commits JOIN modules USING (path) GROUP BY 1, 2) SELECT coalesce(a.segment, b.segment) AS segment, tags, hubs
          FROM (SELECT segment, string_agg(tag, ',' ORDER BY r) AS tags FROM t WHERE r <= 3 GROUP BY 1) a FULL
          JOIN (SELECT segment, string_agg(path, ',' ORDER BY r) AS hubs FROM h WHERE r <= 2 GROUP BY 1) b ON a.segment = b.segment""")
query("agg_exec_tags", lambda c: c.files.orderBy(F.desc("size"), "path").limit(50).select(F.explode(content.path_tags(F.col("path"))).alias("tag")).groupBy("tag")
    .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(8), f"""WITH t AS (SELECT path, tags FROM ({TAGS_SQL})), f AS (SELECT path FROM files ORDER BY size DESC, path LIMIT 50)
    SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter(string_split(tags, ','), lambda x: x <> '')) AS tag FROM f JOIN t USING (path)) GROUP BY 1 ORDER BY n DESC, tag LIMIT 8""")
query("agg_velocity", lambda c: op.velocity(c.items.where("status = 'F'").select("priority", F.col("created_at").alias("completed_at")), "1996-01-01"), """SELECT w AS window, count(p) AS completed, count(*) FILTER (p = 'P0') AS p0, count(*) FILTER (p = 'P1') AS p1 FROM range(6) g(w) LEFT
    JOIN (SELECT priority AS p, (epoch_us(TIMESTAMP '1996-01-01') - epoch_us(created_at) - 1) // (14 * 86400000000) AS k FROM items WHERE status = 'F'
    AND created_at < TIMESTAMP '1996-01-01') ON k = w GROUP BY 1""")
query("agg_avg_velocity", lambda c: op.velocity(c.items.where("status = 'F'").select("priority", F.col("created_at").alias("completed_at")), "1996-01-01", windows=4).agg(F.avg("completed").alias("velocity")), """SELECT count(*) / 4.0::DOUBLE AS velocity FROM items WHERE status = 'F' AND created_at < TIMESTAMP '1996-01-01'
    AND created_at >= TIMESTAMP '1996-01-01' - INTERVAL 56 DAY""")
query("agg_concept_coverage", lambda c: c.modules.select("module").distinct()
    .join(c.concepts.where("confidence > 0.97").select("module").distinct().withColumn("hit", F.lit(1)), "module", "left")
    .agg(F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("pct")),
    "SELECT round(100.0::DOUBLE * count(DISTINCT CASE WHEN confidence > 0.97 THEN module END) / count(DISTINCT module), 2) AS pct FROM concepts")
query("agg_cluster_hist", lambda c: op.size_histogram(c.commits.groupBy("author").agg(F.countDistinct("commit_id").alias("n"))), """SELECT CASE WHEN n <= 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25'
    ELSE '26+' END AS band, count(*) AS clusters FROM (SELECT author, count(DISTINCT commit_id) AS n FROM commits GROUP BY 1) GROUP BY 1""")
query(
    "agg_repo_profile",
    lambda c: op.repository_profile(c.files.select("path")),
    """WITH f AS (SELECT * FROM (SELECT path, regexp_extract(regexp_replace(path, '^.*/', ''), '(\\.[^.]+)$', 1) AS ext, CASE WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE '%.md' OR path LIKE 'docs/%' THEN 'docs'
      WHEN regexp_matches(path, '[.](py|ts|tsx|rs)$') OR path LIKE 'src/%' OR path LIKE '%/lib/%' THEN 'code' ELSE 'other' END AS role FROM files WHERE len(string_split(path, '/')) <= 4) ORDER BY path LIMIT 5000),
    l AS (SELECT ext, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.md' THEN 'markdown' WHEN '.rs' THEN 'rust' END AS language FROM f WHERE path NOT LIKE 'node_modules/%')
    SELECT 'language' AS kind, language AS name, count(*)::DOUBLE AS value FROM l WHERE language IS NOT NULL GROUP BY 2 UNION ALL SELECT 'include', '**/*' || ext, count(*)::DOUBLE FROM l WHERE language IS NOT NULL GROUP BY ext
    UNION ALL SELECT 'exclude', '**/node_modules/**', count(*)::DOUBLE FROM f WHERE path LIKE 'node_modules/%' GROUP BY 2 UNION ALL SELECT 'role', role, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE FROM f GROUP BY 2""".replace("\\\\", "\\"),
)
query("agg_rebuild_duration", lambda c: c.items.where("status = 'F'").groupBy("category").agg(F.max_by("value", F.struct("created_at", "id")).alias("last")).rollup("category").agg(F.round(F.sum("last"), 2).alias("seconds")), """SELECT category, round(sum(last), 2) AS seconds FROM (SELECT category, value AS last FROM (SELECT *, row_number() OVER (PARTITION BY category
    ORDER BY created_at DESC, id DESC) AS r FROM items WHERE status = 'F') WHERE r = 1) GROUP BY ROLLUP (category)""")
#: Every file names the largest file of its source in backticks; what names a file is a link to it.
LINKED_SQL = """big AS (SELECT source, max_by(path, (size, path)) AS target FROM files GROUP BY 1), i AS (SELECT target AS path, count(*) AS links FROM files JOIN big USING (source) GROUP BY 1),
    d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, avg((path LIKE '%.md')::INT) AS ratio FROM files GROUP BY 1),
    z AS (SELECT f.path, coalesce(links, 0) AS links, (SELECT max(links) FROM i) AS most, ratio FROM files f JOIN d ON d.dir = regexp_replace(f.path, '/[^/]*$', '') LEFT JOIN i USING (path)),
    c AS (SELECT path, round(least(1.0::DOUBLE, 0.5::DOUBLE * links / most + CASE WHEN regexp_matches(path, '/(test_)?doc_[0-9]*0[.]') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN ratio >= 0.6 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN path LIKE 'docs/%' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM z)"""


def scored_docs(c):
    """score of every file: links to it found in the texts, the share of markdown in its folder, its name and place."""
    big = c.files.groupBy("source").agg(F.max_by("path", F.struct("size", "path")).alias("target"))
    texts = c.files.join(big, "source").select("path", F.concat("text", F.lit("\nSee `"), "target", F.lit("`.")).alias("text"))
    links = markdown.mentions(texts, c.files).groupBy("path").agg(F.count("*").alias("links"))
    folder = paths.directory(F.col("path"))
    ratio = c.files.groupBy(folder.alias("folder")).agg(F.avg(F.col("path").endswith(".md").cast("int")).alias("ratio"))
    most = links.agg(F.max("links").alias("most"))
    rows = c.files.select("path").withColumn("folder", folder).join(ratio, "folder").join(links, "path", "left").join(F.broadcast(most))  # one row
    named = F.col("path").rlike("/(?:test_)?doc_[0-9]*0[.]")
    return rows.select("path", F.round(op.document_score(F.coalesce("links", F.lit(0)), F.col("most"), named, F.col("ratio"), F.col("path").startswith("docs/")), 6).alias("score"))


query("agg_doc_score", scored_docs, f"WITH {LINKED_SQL} SELECT path, score FROM c")
query(
    "agg_role_overlap",
    lambda c: op.overlaps(c.commits.select(F.concat(F.lit("r"), F.col("author") % 12).alias("role"), "path"), "role", "path", 0.01),
    """WITH m AS (SELECT DISTINCT 'r' || (author % 12)::VARCHAR AS role, path FROM commits), n AS (SELECT role, count(*) AS n FROM m GROUP BY 1),
    s AS (SELECT x.role AS a, y.role AS b, count(*) AS c FROM m x JOIN m y ON x.path = y.path AND x.role < y.role GROUP BY 1, 2)
    SELECT a, b, round(c / (p.n + q.n - c)::DOUBLE, 6) AS jaccard FROM s JOIN n p ON p.role = a JOIN n q ON q.role = b WHERE c / (p.n + q.n - c)::DOUBLE > 0.01""",
)
TOPIC_WORDS = [w for words in patterns.TOPICS.values() for w in words]


def topic_files(c):
    """Files named after two words of topics."""
    words = F.array(*map(F.lit, TOPIC_WORDS))
    pick = lambda n: F.element_at(words, (F.col("doc_id") * n % len(TOPIC_WORDS) + 1).cast("int"))
    return c.documents.select(F.concat(F.lit("src/"), "source", F.lit("/"), pick(7), F.lit("_"), F.initcap(pick(11)), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))


query(
    "agg_hi_topics",
    lambda c: patterns.topics(topic_files(c)),
    f"""WITH k AS (SELECT {TOPIC_WORDS!r} AS w), t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}', '{w}')" for i, (t, ws) in enumerate(patterns.TOPICS.items()) for w in ws)}) v(place, topic, word)),
    f AS (SELECT 'src/' || source || '/' || w[doc_id * 7 % len(w) + 1] || '_' || upper(substr(w[doc_id * 11 % len(w) + 1], 1, 1)) || substr(w[doc_id * 11 % len(w) + 1], 2) || doc_id || '.py' AS path FROM documents, k),
    m AS (SELECT DISTINCT path, place, topic, word FROM (SELECT path, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', ''), '[a-z]+|[A-Z][a-z]*|\\d+'))) AS word FROM f) JOIN t USING (word) WHERE length(word) > 1)
    SELECT topic, count(DISTINCT word)::INT AS matches, string_agg(DISTINCT word, ' ' ORDER BY word) AS words,
    (SELECT string_agg(regexp_replace(path, '^.*/', ''), ' ' ORDER BY path) FROM (SELECT DISTINCT path FROM m b WHERE b.place = m.place ORDER BY path LIMIT 8)) AS files
    FROM m GROUP BY place, topic HAVING count(DISTINCT word) >= 2 ORDER BY matches DESC, place LIMIT 5""",
)
query("agg_role_fitness", lambda c: c.concepts.withColumn("r", F.expr("row_number() OVER (PARTITION BY category ORDER BY confidence DESC, id)")).where("r <= 30").groupBy("category").agg(F.round(0.6 * F.avg((F.col("status") == "active").cast("double")) + 0.2 + 0.2 * F.avg(F.when(F.col("r") <= 10, F.col("confidence"))), 6).alias("fitness")), """SELECT category, round(0.6::DOUBLE * avg((status = 'active')::INT) + 0.2::DOUBLE + 0.2::DOUBLE * avg(confidence::DOUBLE) FILTER (r <= 10),
    6) AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, id) AS r FROM concepts) WHERE r <= 30 GROUP BY 1""")
query("agg_role_fitness_fb", lambda c: c.concepts.groupBy("module").agg(F.round(0.5 * F.least(F.count_if(F.col("kind").contains("STEEL")) / F.count("*"), F.lit(0.3)) / 0.3 + 0.3 * F.least(F.count_if(F.col("title").contains("1")) / F.count("*"), F.lit(0.3)) / 0.3 + 0.2, 6).alias("fitness")), """SELECT module, round(0.5::DOUBLE * least(count(*) FILTER (contains(kind, 'STEEL')) / count(*)::DOUBLE,
    0.3::DOUBLE) / 0.3::DOUBLE + 0.3::DOUBLE * least(count(*) FILTER (contains(title, '1')) / count(*)::DOUBLE, 0.3::DOUBLE) / 0.3::DOUBLE + 0.2::DOUBLE,
    6) AS fitness FROM concepts GROUP BY 1""")
query("agg_provenance", lambda c: c.items.groupBy("category").agg(F.max("created_at").alias("latest"), F.max_by("id", F.struct("created_at", "id")).alias("run")).select("category", "run", F.datediff(F.lit("2000-01-01").cast("date"), F.col("latest").cast("date")).alias("age_days")), """SELECT category, run, date_diff('day', l::DATE, DATE '2000-01-01')::INT AS age_days
    FROM (SELECT category, id AS run, created_at AS l, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id DESC) AS r FROM items) WHERE r = 1""")
query("agg_integrity", lambda c: op.integrity(c.events.where("ts < timestamp_ntz'2024-01-15' AND user_id % 5 != 0").groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("name")).agg(F.count("*").alias("n")), c.events.where("ts >= timestamp_ntz'2024-01-15' AND user_id % 7 != 0").groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("name")).agg(F.count("*").alias("n"))).groupBy("state").agg(F.count("*").alias("n")), """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 5 <> 0
    GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 7 <> 0 GROUP BY 1) SELECT CASE
    WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'deleted' WHEN b.n / a.n::DOUBLE < 0.5 THEN 'major_shrink' WHEN b.n / a.n::DOUBLE > 1.5 THEN 'growth'
    ELSE 'ok' END AS state, count(*) AS n FROM a FULL JOIN b USING (user_id) GROUP BY 1""")
query("agg_jsonl_count", lambda c: c.documents.select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    .agg(F.count("*").alias("lines")),
    "SELECT count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0")
query("agg_doc_folder_ratio", lambda c: c.files.groupBy(paths.directory(F.col("path")).alias("folder"))
    .agg(F.round(F.avg(F.col("path").endswith(".md").cast("double")), 6).alias("md_ratio")),
    "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, round(avg((path LIKE '%.md')::INT), 6) AS md_ratio FROM files GROUP BY 1")
