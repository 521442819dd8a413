"""Registered filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import filters as op
from .registry import query

query("flt_glob_any", lambda c: c.files.where(paths.any_glob(F.col("path"), ["**/*.py", "docs/**", "*.lock"])).select("doc_id", "path"),
      r"SELECT doc_id, path FROM files WHERE path LIKE '%.py' OR path LIKE 'docs/%' OR path LIKE '%.lock'")
query("flt_included", lambda c: op.by_globs(c.files, ["src/**"], ["**/*.lock", "**/test_*"]).select("doc_id", "path"),
      r"SELECT doc_id, path FROM files WHERE path LIKE 'src/%' AND path NOT LIKE '%.lock' AND NOT regexp_matches(path, '(^|/)test_[^/]*$')")
query("flt_relevant", lambda c: op.by_globs(c.files, ["*.ts", "**/*.rs"], ["node_modules/**"]).select("doc_id", "path"),
      r"SELECT doc_id, path FROM files WHERE (path LIKE '%.ts' OR path LIKE '%.rs') AND path NOT LIKE 'node_modules/%'")
query("flt_scope", lambda c: op.in_scopes(c.files, c.spark.createDataFrame([("src/core",), ("docs/src1",)], "scope string")).select("doc_id", "path"),
      r"SELECT doc_id, path FROM files WHERE path LIKE 'src/core/%' OR path = 'src/core' OR path LIKE 'docs/src1/%' OR path = 'docs/src1'")
query("flt_scope_mask", lambda c: c.files.withColumn("label",
    F.coalesce(F.when(paths.under(F.col("path"), F.lit("src/api")), "api"), F.when(paths.layer(F.col("path")) == "testing", "role:testing"), F.lit("global")))
    .groupBy("label").agg(F.count("*").alias("n")),
      r"""SELECT CASE WHEN path LIKE 'src/api/%' THEN 'api' WHEN path LIKE 'tests/%' THEN 'role:testing' ELSE 'global' END AS label, count(*) AS n
          FROM files GROUP BY 1""")
query("flt_dlp", lambda c: op.blocked(c.files.withColumn("path", F.upper("path")), ["**/*.LOCK", "Deploy/**"]).select("doc_id", "path"),
      r"SELECT doc_id, upper(path) AS path FROM files WHERE lower(path) LIKE '%.lock' OR path LIKE 'deploy/%'")
query("flt_noise_churn", lambda c: c.files.where(~paths.noise(F.col("path"))).select("doc_id", "path"),
      r"SELECT doc_id, path FROM files WHERE path NOT LIKE '%.lock' AND path NOT LIKE 'node_modules/%'")
query("flt_generated", lambda c: c.files.where(paths.generated(F.regexp_replace("path", "^config/", "dist/"))).select("doc_id", "path"),
    "SELECT doc_id, path FROM files WHERE path LIKE 'config/%'")
query("flt_test_file", lambda c: c.files.where(paths.test_file(F.col("path"))).select("doc_id", "path"),
      r"SELECT doc_id, path FROM files WHERE path LIKE 'tests/%' OR regexp_matches(path, '/test_[^/]*$')")
query("flt_opportunities", lambda c: op.opportunities(c.items, ["quality", "security"], ["audit", "roadmap"], "P1")
    .select("id", "priority", "severity", "category"),
      """SELECT id, priority, severity, category FROM items WHERE NOT dismissed AND category IN ('quality', 'security') AND source IN ('audit', 'roadmap')
          AND priority IN ('P0', 'P1')""")
query("flt_audit_query", lambda c: op.log_page(c.events, "view", "2024-01-05", "2024-01-20", 50, 10).select("event_id", "ts", "user_id"),
      """SELECT event_id, ts, user_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
          ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10""")
query("flt_min_score", lambda c: c.concepts.where("confidence >= 0.6").orderBy(F.desc("confidence"), "id").limit(25).select("id", "confidence"),
      "SELECT id, confidence::DOUBLE AS confidence FROM concepts WHERE p_score >= 0.6 ORDER BY confidence DESC, id LIMIT 25".replace("p_score", "confidence"))
query("prj_node_normalize", lambda c: c.nodes.select("id", F.coalesce("name", F.lit("unnamed")).alias("name"), F.coalesce("size", F.lit(0)).alias("size"),
    F.coalesce("language", F.lit("unknown")).alias("language")),
      "SELECT id, coalesce(name, 'unnamed') AS name, coalesce(size, 0) AS size, coalesce(language, 'unknown') AS language FROM nodes")
query("prj_classify_path", lambda c: c.files.select("doc_id", paths.role(F.col("path")).alias("role")),
      r"""SELECT doc_id, CASE WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE 'docs/%' OR path LIKE '%.md' THEN 'docs'
          WHEN regexp_matches(path, '\.(py|ts|tsx|rs)$') OR path LIKE 'src/%' OR path LIKE '%/lib/%' THEN 'code' ELSE 'other' END AS role FROM files""")
query("prj_language", lambda c: c.files.select("doc_id", paths.language(F.col("path")).alias("language")),
      """SELECT doc_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript'
          WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.rs' THEN 'rust' END AS language FROM files""")
query("prj_content_class", lambda c: c.files.select("doc_id", F.when(~F.col("path").endswith(".md"), "structured_code")
    .when((F.regexp_count("text", F.lit(r"\.")) >= 3) & (F.size(F.split("text", "\n")) >= 5), "structured_docs")
    .otherwise("unstructured_narrative").alias("class")),
      r"""SELECT doc_id, CASE WHEN path NOT LIKE '%.md' THEN 'structured_code' WHEN length(text) - length(replace(text, '.', '')) >= 3
          AND length(text) - length(replace(text, chr(10), '')) >= 4 THEN 'structured_docs' ELSE 'unstructured_narrative' END AS class FROM files""")
query("prj_context_tier", lambda c: c.items.select("id", op.context_tier(F.col("value")).alias("tier")),
    "SELECT id, CASE WHEN value >= 40000 THEN 1.0::DOUBLE WHEN value >= 22000 THEN 2.0::DOUBLE ELSE 2.5::DOUBLE END AS tier FROM items")
query("prj_lod", lambda c: c.concepts.select("id", op.level_of_detail(F.col("confidence"), F.col("id") % 9 == 0).alias("lod")),
      """SELECT id, CASE WHEN id % 9 = 0 THEN 4 WHEN confidence >= 0.5 THEN 0 WHEN confidence >= 0.35 THEN 2 WHEN confidence >= 0.2 THEN 4
          ELSE 5 END AS lod FROM concepts""")
query("prj_normalize_weights", lambda c: c.concepts.select(F.trim(F.regexp_replace(F.concat(F.lit(" /"), "a1", F.lit("/ ")), "(^[ /]+)|([ /]+$)",
    "")).alias("path"), F.round(F.least(F.greatest(F.col("confidence") * 3 - 0.5, F.lit(0.0)), F.lit(2.0)), 2).alias("weight")).groupBy("path")
    .agg(F.max("weight").alias("weight")),
      "SELECT a1 AS path, max(round(least(greatest(confidence::DOUBLE * 3 - 0.5, 0.0), 2.0), 2))::DOUBLE AS weight FROM concepts GROUP BY a1")
query("prj_priority", lambda c: op.finding_ids(c.items.select("id", "analyzer", "category", "severity", F.array("file_path", "source").alias("paths")))
    .select("id", "priority", "finding_id"),
      """SELECT id, CASE severity WHEN 'critical' THEN 'P0' WHEN 'warning' THEN 'P1' WHEN 'info' THEN 'P2'
          ELSE 'P3' END AS priority, 'f-' || substr(sha256(analyzer || '|' || category || '|' || least(file_path, source) || ',' || greatest(file_path,
          source)), 1, 8) AS finding_id FROM items""")
query("prj_role_drift", lambda c: c.concepts.select("id", op.drift(F.col("confidence")).alias("state")), """SELECT id, CASE WHEN confidence > 0.8 THEN 'healthy' WHEN confidence > 0.6 THEN 'minor' WHEN confidence > 0.4 THEN 'significant'
    ELSE 'critical' END AS state FROM concepts""")
query("prj_significance", lambda c: c.items.select("id",
    op.significance(F.col("category"), F.col("value") / 500000, F.col("id") % 3, F.when(F.col("id") % 2 == 0, "low")
    .otherwise("normal")).alias("significance")),
      """SELECT id, CASE WHEN category = 'security' OR value / 500000 > 0.5 THEN 'mandatory' WHEN id % 2 = 0 AND id % 3 = 0 THEN 'informational'
          ELSE 'recommended' END AS significance FROM items""")
query("prj_hub_severity", lambda c: c.edges.where("kind = 'imports'").groupBy("target").agg(F.count("*").alias("degree"))
    .select("target", "degree", op.hub_severity(F.col("degree"), F.lit(0.0)).alias("severity")),
      """SELECT target, count(*) AS degree, CASE WHEN count(*) >= 20 THEN 'critical' WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 8 THEN 'moderate'
          ELSE 'low' END AS severity FROM edges WHERE kind = 'imports' GROUP BY target""")
query("prj_hub_label", lambda c: c.part_paths.select("path")
    .join(c.commits.where("ts >= timestamp_ntz'1995-01-01'").groupBy("path")
    .agg(F.countDistinct("commit_id").alias("n"), F.countDistinct("author").alias("a")), "path", "left")
    .select("path", op.churn_class(F.col("n"), F.col("a")).alias("label")),
      """SELECT path, CASE WHEN n IS NULL THEN 'unknown' WHEN n < 3 THEN 'stable' WHEN n <= 15 THEN 'evolving' WHEN a >= 3 THEN 'fragile'
          ELSE 'evolving' END AS label FROM part_paths LEFT JOIN (SELECT path, count(DISTINCT commit_id) AS n, count(DISTINCT author) AS a FROM commits
          WHERE ts >= TIMESTAMP '1995-01-01' GROUP BY path) USING (path)""")
query("prj_antibody", lambda c: c.concepts.where("category = 'constraint' AND status = 'active'")
    .select("id", F.concat(F.lit("ab-"), F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "kind"), 256), 1, 12)).alias("antibody_id"),
    F.concat(F.lit("**/"), "a1", F.lit("/**")).alias("path_glob"), F.regexp_extract("kind", r"(\w+)$", 1).alias("pattern")),
      """SELECT id, 'ab-' || substr(sha256(id::VARCHAR || '|' || kind), 1, 12) AS antibody_id, '**/' || a1 || '/**' AS path_glob, regexp_extract(kind,
          '(\\w+)$', 1) AS pattern FROM concepts WHERE category = 'constraint' AND status = 'active'""".replace("\\\\w", "\\w"))
query("prj_pass2", lambda c: op.triage(c.concepts.select("id", "confidence", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>"))
    .otherwise(F.array("a1")).alias("anchors")), c.concepts.where("id % 3 = 0").groupBy("kind").agg(F.min("id").alias("representative"))
    .join(c.concepts.where("id % 3 = 0").select("kind", "id"), "kind").select("id", "representative"), 0.3).groupBy("action").agg(F.count("*").alias("n")),
      """SELECT CASE WHEN r IS NOT NULL AND id <> r THEN 'shadow' WHEN r IS NULL AND confidence < 0.3 AND id % 4 = 0 THEN 'archive'
          ELSE 'keep' END AS action, count(*) AS n FROM (SELECT id, confidence, CASE
          WHEN id % 3 = 0 THEN min(id) OVER (PARTITION BY kind, id % 3 = 0) END AS r FROM concepts) GROUP BY 1""")
query("prj_pass4", lambda c: c.concepts.select("id", op.gate(F.col("confidence"), 0.7, 0.3).alias("status")),
    "SELECT id, CASE WHEN confidence >= 0.7 THEN 'active' WHEN confidence >= 0.3 THEN 'triage' ELSE 'archive' END AS status FROM concepts")
