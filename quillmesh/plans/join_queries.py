"""Registered joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..operators import graphs as gr
from ..operators import globs
from ..operators import joins as op
from .registry import query

HALF = "timestamp_ntz'1996-06-01'"


def hubs(c, until: str):
    n = c.commits.where(f"ts < {until}").groupBy("path").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "path").limit(40).selectExpr("path", "n", "row_number() OVER (ORDER BY n DESC, path) AS rank")


def hub_sql(name: str, until: str) -> str:
    return f"""{name} AS (SELECT path, n, row_number() OVER (ORDER BY n DESC, path) AS rank FROM (SELECT path, count(*) AS n FROM commits
        WHERE ts < TIMESTAMP '{until}' GROUP BY path ORDER BY n DESC, path LIMIT 40))"""


def old_files(c):
    return c.files.where("doc_id % 10 != 3").select("path", F.when(F.col("doc_id") % 7 == 2, F.md5(F.col("path").cast("binary")))
        .otherwise(F.col("hash")).alias("hash"))


def new_files(c):
    return c.files.where("doc_id % 11 != 5").select("path", "hash")


CHANGES = """o AS (SELECT path, CASE WHEN doc_id % 7 = 2 THEN md5(path) ELSE hash END AS hash FROM files WHERE doc_id % 10 <> 3), n AS (SELECT path, hash FROM files WHERE doc_id % 11 <> 5),
changes AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n ON o.path = n.path)"""

query("join_edge_nodes", lambda c: op.neighbours(c.edges, c.nodes, c.nodes.where("kind = 'file' AND language = 'typescript'").select("id"), ["imports"], 20),
      """SELECT probe, direction, neighbour, kind, file_path FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY direction, neighbour, kind) AS r FROM (
      SELECT source AS probe, 'out' AS direction, target AS neighbour, kind FROM edges WHERE kind = 'imports' UNION ALL SELECT target, 'in', source, kind FROM edges WHERE kind = 'imports') e
      JOIN nodes ON nodes.id = e.neighbour WHERE probe IN (SELECT id FROM nodes WHERE language = 'typescript' AND kind = 'file')) WHERE r <= 20""".replace("SELECT *, row_number()", "SELECT e.*, file_path, row_number()").replace("ORDER BY direction, neighbour, kind)", "ORDER BY direction, neighbour, e.kind)"))
query(
    "join_fts_obs",
    lambda c: op.search_notes(c.observations, "any error or purchase").withColumn("leg", F.lit("words"))
        .unionByName(op.search_notes(c.observations, "nup se").withColumn("leg", F.lit("whole"))),
    r"""WITH t AS (SELECT id, content, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM observations),
    k AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'error')) AS a, len(list_filter(w, lambda x: x = 'purchase')) AS b FROM t),
    s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS fa, count(*) FILTER (b > 0) AS fb FROM k)
    SELECT id, round(ln(1 + (n - fa + 0.5::DOUBLE) / (fa + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))
        + ln(1 + (n - fb + 0.5::DOUBLE) / (fb + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score, 'words' AS leg
    FROM k, s WHERE a + b > 0 UNION ALL SELECT id, 0.0::DOUBLE, 'whole' FROM t WHERE contains(content, 'nup se')""",
)
query("join_enrich_findings", lambda c: op.enriched_findings(c.items.select("id", "file_path", "severity"),
    c.commits.groupBy(F.concat(F.lit("part/"), F.col("author") % 30, F.lit(".py")).alias("file_path")).agg((F.count("*") % 25).alias("dependents"))),
      """SELECT id, i.file_path, severity, coalesce(d, 0) AS dependents, round(least(CASE severity WHEN 'critical' THEN 1.0::DOUBLE
          WHEN 'warning' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * (1 + coalesce(d, 0) / 20.0::DOUBLE), 1.0::DOUBLE), 4) AS risk FROM items i LEFT
          JOIN (SELECT 'part/' || (author % 30)::VARCHAR || '.py' AS file_path, count(*) % 25 AS d FROM commits GROUP BY 1) x ON i.file_path = x.file_path""")
MOD = """m AS (SELECT id, file_path, coalesce(module, CASE WHEN file_path LIKE 'supplier/%' THEN 'supplier' || (length(file_path) % 5)::VARCHAR END) AS module
    FROM nodes LEFT JOIN modules ON path = file_path)"""


def mods(c):
    return c.modules.unionByName(c.nodes.where("language = 'typescript'")
        .select(F.concat(F.lit("supplier"), F.length("file_path") % 5).alias("module"), F.col("file_path").alias("path")))


query("join_cross_module", lambda c: op.cross_module(c.edges, c.nodes, mods(c), 5),
      f"""WITH {MOD}, x AS (SELECT a.module AS source_module, b.module AS target_module, b.file_path AS p, count(*) AS n FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE e.kind = 'imports' AND a.module <> b.module GROUP BY 1, 2, 3),
      y AS (SELECT *, sum(n) OVER (PARTITION BY source_module, target_module)::BIGINT AS imports, row_number() OVER (PARTITION BY source_module, target_module ORDER BY n DESC, p) AS r FROM x)
      SELECT source_module, target_module, imports, p AS bottleneck, n AS bottleneck_imports, CASE WHEN n > imports * 0.6 AND n >= 3 THEN CASE WHEN n >= 5 THEN 'critical' ELSE 'warning' END WHEN imports >= 10 THEN 'warning' ELSE 'info' END AS severity FROM y WHERE r = 1 AND imports >= 5""")
query("join_module_edges", lambda c: op.module_edges(c.edges, c.nodes, mods(c)),
      f"""WITH {MOD} SELECT a.module AS source_module, b.module AS target_module, count(*) AS n FROM edges e JOIN m a ON a.id = e.source
          JOIN m b ON b.id = e.target WHERE e.kind = 'imports' AND a.module <> b.module GROUP BY 1, 2""")
query("join_dead_code", lambda c: op.unused_files(c.nodes, c.edges.where("weight > 1")).select("id", "file_path"),
      "SELECT id, file_path FROM nodes WHERE kind = 'file' AND id NOT IN (SELECT target FROM edges WHERE kind = 'imports' AND weight > 1)")
query("join_orphan_modules", lambda c: op.isolated_modules(mods(c), op.module_edges(c.edges.where("weight > 2"), c.nodes, mods(c))),
      f"""WITH {MOD}, l AS (SELECT a.module AS s, b.module AS t FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target
          WHERE e.kind = 'imports' AND weight > 2 AND a.module <> b.module), g AS (SELECT module, count(*) AS files FROM m JOIN nodes USING (id)
          WHERE nodes.kind = 'file' GROUP BY 1 HAVING count(*) > 1) SELECT module, files FROM g WHERE module NOT IN (SELECT s FROM l)
          AND module NOT IN (SELECT t FROM l)""")
query("join_delta_overlay", lambda c: op.overlay(c.files.where("doc_id % 3 != 0").select("path", "hash"), c.files.where("doc_id % 4 = 0")
    .select("path", F.upper("hash").alias("hash")), "path", c.files.where("doc_id % 13 = 1").select("path")),
      """SELECT path, hash FROM files WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 13 <> 1 UNION ALL SELECT path, upper(hash) FROM files
          WHERE doc_id % 4 = 0""")
def paired(c):
    return c.files.select("path").unionByName(c.files.where("path LIKE 'tests/%'")
        .select(F.regexp_replace(F.regexp_replace("path", "tests/unit", "src/impl"), "/test_", "/").alias("path")))


TESTED = """f2 AS (SELECT path FROM files UNION ALL SELECT replace(replace(path, 'tests/unit', 'src/impl'), '/test_', '/') FROM files WHERE path LIKE 'tests/%'),
t AS (SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') AS stem, path LIKE 'tests/%' OR path LIKE '%/test_%' AS is_test FROM f2),
pairs AS (SELECT a.path AS test, b.path AS source FROM t a JOIN t b ON regexp_replace(a.stem, '^test_', '') = b.stem WHERE a.is_test AND NOT b.is_test)"""
query("join_test_source", lambda c: op.tested_sources(paired(c)), f"WITH {TESTED} SELECT test, source FROM pairs")
query("join_test_edges", lambda c: op.with_untested(paired(c), op.tested_sources(paired(c))),
      f"""WITH {TESTED} SELECT split_part(path, '/', 1) AS module, count(*) AS files, count(*) FILTER (path IN (SELECT source
          FROM pairs)) AS tested, round(100.0::DOUBLE * count(*) FILTER (path IN (SELECT source FROM pairs)) / count(*), 2) AS pct FROM t
          WHERE NOT is_test GROUP BY 1""")
query(
    "join_duplicate_pairs",
    lambda c: op.jaccard_pairs(
        c.files.select(F.col("doc_id").alias("id"), paths.directory(F.col("path")).alias("folder"), tx.identifier_tokens(F.col("text")).alias("tokens"))
            .where(F.size("tokens") >= 3), 0.65, apart="folder"
    ).select("a", "b", F.round("jaccard", 6).alias("jaccard")),
    r"""WITH t AS (SELECT doc_id AS id, regexp_replace(path, '/[^/]*$', '') AS folder,
        list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'this', 'that', 'with', 'from', 'are', 'was', 'not'))) AS w FROM files),
    u AS (SELECT id, unnest(w) AS g FROM t WHERE len(w) >= 3), p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, round(c / (len(x.w) + len(y.w) - c)::DOUBLE, 6) AS jaccard FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b
    WHERE c / (len(x.w) + len(y.w) - c)::DOUBLE >= 0.65 AND x.folder <> y.folder""",
)
ANCH = "SELECT id, a1 AS anchor FROM concepts UNION SELECT id, a2 FROM concepts UNION SELECT id, module FROM concepts WHERE id % 3 = 0"


def anchors(c):
    return c.concepts.select("id", F.col("a1").alias("anchor")).union(c.concepts.select("id", "a2")).union(c.concepts.where("id % 3 = 0")
        .select("id", "module")).distinct()


query("join_anchor_overlap", lambda c: op.anchor_pairs(anchors(c), c.concepts.select("id", tx.word_set(F.col("title")).alias("tokens")), 2, 0.6),
      rf"""WITH h AS ({ANCH}), t AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda w: true)) AS w FROM concepts),
      p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM h x JOIN h y ON x.anchor = y.anchor AND x.id < y.id GROUP BY 1, 2),
      j AS (SELECT p.*, len(list_intersect(x.w, y.w)) AS i, len(list_distinct(list_concat(x.w, y.w))) AS u FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b)
      SELECT a, b, shared, round(CASE WHEN u > 0 THEN i / u::DOUBLE ELSE 0.0::DOUBLE END, 6) AS title_jaccard FROM j WHERE shared >= 2 OR (u > 0 AND i / u::DOUBLE >= 0.6)""")
query("join_conflicts", lambda c: op.concept_conflicts(c.concepts.select("id", "status", "category", F.col("a1").alias("anchor"),
    (F.col("id") % 17).alias("created"))),
      """SELECT a1 AS anchor, w AS winner, id AS loser FROM (SELECT id, a1, first_value(id) OVER (PARTITION BY a1 ORDER BY id % 17, id) AS w
          FROM concepts WHERE status = 'active' AND category IN ('constraint', 'architecture')) WHERE w <> id""")
query(
    "join_agent_conflicts",
    lambda c: op.agent_conflicts(c.observations),
    """WITH l AS (SELECT file_path, agent, id AS last FROM (SELECT *, row_number() OVER (PARTITION BY file_path, agent ORDER BY created_at DESC, id DESC) AS r FROM observations) WHERE r = 1)
    SELECT x.file_path, x.agent AS a, x.last AS last_a, y.agent AS b, y.last AS last_b FROM l x JOIN l y ON x.file_path = y.file_path AND x.agent < y.agent""",
)
query("join_asof_snapshot", lambda c: op.as_of(c.events.where("event_type = 'error'").select("event_id", "user_id", "ts"),
    c.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id")).groupBy("user_id", "seen_at")
    .agg(F.max("seen_id").alias("seen_id")).withColumn("at", F.col("seen_at")), ["user_id"], "ts", "at", ["seen_at", "seen_id"]),
      """SELECT e.event_id, e.user_id, e.ts, v.seen_at, v.seen_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT
          JOIN (SELECT user_id, ts AS seen_at, max(event_id) AS seen_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON e.user_id = v.user_id
          AND e.ts >= v.seen_at""")
query("join_hub_diff", lambda c: op.ranking_diff(hubs(c, HALF), hubs(c, "timestamp_ntz'2100-01-01'"), "path"),
      f"""WITH {hub_sql('o', '1996-06-01')}, {hub_sql('n', '2100-01-01')} SELECT *
          FROM (SELECT coalesce(o.path, n.path) AS path, o.rank::INT AS old_rank, n.rank::INT AS new_rank, CASE WHEN o.path IS NULL THEN 'new'
          WHEN n.path IS NULL THEN 'removed' WHEN abs(o.rank - n.rank) > 1 THEN 'rank_changed' END AS change FROM o FULL JOIN n ON o.path = n.path)
          WHERE change IS NOT NULL""")
query("join_module_diff", lambda c: op.size_diff(c.modules.where(F.length("path") % 2 == 0).groupBy("module").agg(F.count("*").alias("n")),
    c.modules.groupBy("module").agg(F.count("*").alias("n")), "module"),
      """WITH o AS (SELECT module, count(*) AS n FROM modules WHERE length(path) % 2 = 0 GROUP BY 1), n AS (SELECT module, count(*) AS n FROM modules
          GROUP BY 1) SELECT * FROM (SELECT coalesce(o.module, n.module) AS module, o.n AS old_n, n.n AS new_n, CASE WHEN o.n IS NULL THEN 'new'
          WHEN n.n IS NULL THEN 'removed' WHEN abs(n.n - o.n) > 0.2 * greatest(o.n, 1) THEN 'size_changed' END AS change FROM o FULL
          JOIN n ON o.module = n.module) WHERE change IS NOT NULL""")
query("join_changeset", lambda c: op.changeset(old_files(c), new_files(c)), f"WITH {CHANGES} SELECT path, status FROM changes")
query("join_coverage", lambda c: op.coverage(new_files(c), op.changeset(old_files(c), new_files(c)), c.files.where("doc_id % 2 = 0").select("path"),
    ["node_modules/**"]).groupBy("state").agg(F.count("*").alias("n")),
      f"""WITH {CHANGES} SELECT CASE WHEN n.path LIKE 'node_modules/%' THEN 'excluded' WHEN f.path IS NOT NULL AND status = 'modified' THEN 'stale'
          WHEN f.path IS NOT NULL THEN 'traced' WHEN status IN ('added', 'modified') THEN 'pending' ELSE 'untraced' END AS state, count(*) AS n FROM n
          JOIN changes ON changes.path = n.path LEFT JOIN (SELECT path FROM files WHERE doc_id % 2 = 0) f ON f.path = n.path GROUP BY 1""")
query("join_churn_gate", lambda c: c.part_paths.select("path", "p_size")
    .join(c.commits.where("ts >= timestamp_ntz'1998-06-01'").select("path").distinct().withColumn("active", F.lit(True)), "path", "left")
    .select("path", F.when(F.col("active").isNull(), F.lit("P3")).otherwise(F.lit("P1")).alias("priority")),
      "SELECT path, CASE WHEN path IN (SELECT path FROM commits WHERE ts >= TIMESTAMP '1998-06-01') THEN 'P1' ELSE 'P3' END AS priority FROM part_paths")
query("join_interval_asof", lambda c: c.observations.where("valid_from <= timestamp_ntz'2024-01-15' AND (valid_to IS NULL OR valid_to > timestamp_ntz'2024-01-15')").select("id", "agent", "file_path"),
      "SELECT id, agent, file_path FROM observations WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
query("join_prefix_dir", lambda c: c.observations.where(F.col("file_path").startswith("src/m3/")).select("id", "file_path"),
    "SELECT id, file_path FROM observations WHERE file_path LIKE 'src/m3/%'")
PRE = [("src", 1.2), ("src/core", 0.8), ("docs", 0.5), ("src/api/src1", 1.5)]
PRE_SQL = """p(prefix, value) AS (VALUES ('src', 1.2::DOUBLE), ('src/core', 0.8::DOUBLE), ('docs', 0.5::DOUBLE), ('src/api/src1', 1.5::DOUBLE)), best AS (SELECT path,
    prefix, value FROM (SELECT path, prefix, value, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS r FROM files
    JOIN p ON path = prefix OR starts_with(path, prefix || '/')) WHERE r = 1)"""
prefixes = lambda c: c.spark.createDataFrame(PRE, "prefix string, value double")
query("join_segment_prefix", lambda c: op.longest_prefix(c.files.select("path"), prefixes(c)).select("path", "prefix"),
    f"WITH {PRE_SQL} SELECT f.path, prefix FROM files f LEFT JOIN best ON best.path = f.path")
query("join_path_weight", lambda c: op.longest_prefix(c.files.select("path"), prefixes(c)).select("path", F.coalesce("value", F.lit(1.0)).alias("weight")),
    f"WITH {PRE_SQL} SELECT f.path, coalesce(value, 1.0::DOUBLE) AS weight FROM files f LEFT JOIN best ON best.path = f.path")
query(
    "join_missing_refs",
    lambda c: gr.decay(c.edges, c.nodes.select("id", F.lit(0.8).alias("score")), op.missing_references(c.edges, c.nodes).select("id"), 1)
        .join(op.missing_references(c.edges, c.nodes), "id", "left")
    .select("id", "score", F.coalesce("missing", F.lit(0)).alias("missing")),
    """WITH m AS (SELECT source AS id, count(*) AS missing FROM edges WHERE target NOT IN (SELECT id FROM nodes) GROUP BY 1),
    k AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), h AS (SELECT DISTINCT b AS id FROM k WHERE a IN (SELECT id FROM m) AND b IN (SELECT id FROM nodes) AND b NOT IN (SELECT id FROM m))
    SELECT id, 0.0::DOUBLE AS score, missing FROM m UNION ALL SELECT id, 0.76::DOUBLE, 0 FROM h""",
)
query(
    "join_edge_closure",
    lambda c: op.valid_edges(c.edges, c.nodes.where("size > 20000 OR language = 'typescript'")).select("source", "target", "kind")
        .orderBy("source", "target", "kind").limit(300),
    """SELECT DISTINCT source, target, kind FROM edges WHERE source IN (SELECT id FROM nodes WHERE size > 20000 OR language = 'typescript')
    AND target IN (SELECT id FROM nodes WHERE size > 20000 OR language = 'typescript') ORDER BY source, target, kind LIMIT 300""",
)
query("join_validate_edges", lambda c: op.valid_edges(c.edges, c.nodes).groupBy("kind", "origin").agg(F.count("*").alias("n")), """SELECT kind, origin, count(*) AS n FROM (SELECT DISTINCT source, target, kind, origin FROM edges WHERE source IN (SELECT id FROM nodes)
    AND target IN (SELECT id FROM nodes)) GROUP BY 1, 2""")
query("join_replace_origin", lambda c: op.replace_origin(c.edges.select("source", "target", "kind", "origin"),
    c.edges.where("origin IN ('static', 'inferred') AND weight > 1").select("source", "target", "kind", "origin").drop("origin"), "inferred"),
      """SELECT source, target, kind, origin FROM edges WHERE origin <> 'inferred' UNION ALL SELECT source, target, kind, 'inferred' FROM edges e
          WHERE origin IN ('static', 'inferred') AND weight > 1 AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.origin <> 'inferred' AND r.source = e.source
          AND r.target = e.target AND r.kind = e.kind)""")
query("join_inferred_validate",
    lambda c: op.judged_hypotheses(c.edges.where("origin IN ('inferred', 'external')").select("source", "target", "confidence"), c.nodes,
    c.edges.where("origin = 'static'"), 0.3).groupBy("verdict").agg(F.count("*").alias("n")),
      """SELECT CASE WHEN source NOT IN (SELECT id FROM nodes) THEN 'missing_source' WHEN target NOT IN (SELECT id FROM nodes) THEN 'missing_target'
          WHEN confidence < 0.3 THEN 'low_confidence' WHEN EXISTS (SELECT 1 FROM edges k WHERE k.origin = 'static' AND k.source = e.source
          AND k.target = e.target) THEN 'boosts_known' ELSE 'accepted' END AS verdict, count(*) AS n FROM edges e
          WHERE origin IN ('inferred', 'external') GROUP BY 1""")
#: Rules of all kinds, one a part: kind and target by its keys and size.
RULE_COLUMNS = [
    "p_partkey AS rule",
    "CASE p_partkey % 5 WHEN 0 THEN 'file_modified' WHEN 1 THEN 'file_created' WHEN 2 THEN 'import_added' WHEN 3 THEN 'pattern_match' ELSE 'coupling_threshold' END AS kind",
    "CASE p_partkey % 7 WHEN 0 THEN 'src/core/src' || (p_size % 20) || '/' WHEN 1 THEN 'docs/src' || (p_size % 20) || '/*' WHEN 2 THEN '*doc_' || p_size || '.*y' WHEN 3 THEN 'src/api/src' || (p_size % 20) "
    "WHEN 4 THEN '*' || p_size || '.rs' WHEN 5 THEN '*/src' || (p_size % 20) || '/*' ELSE 'config/src' || (p_size % 20) || '/doc_' || p_size || '.json' END AS target",
    "CASE p_partkey % 5 WHEN 2 THEN 'mod' || (p_size % 9) || '$' WHEN 3 THEN (p_size % 10) || ' [a-z]+' ELSE '' END AS pattern",
    "p_size % 7 AS max_dependents", "CASE WHEN p_size > 25 THEN 'warn' ELSE 'review' END AS severity", "CASE WHEN p_partkey % 11 = 0 THEN 'testing' ELSE 'active' END AS status",
]
RULES = f"SELECT {', '.join(RULE_COLUMNS)} FROM part"
#: A path against a target, as DuckDB writes it.
MET = """(path = target OR (target LIKE '%/' AND starts_with(path, target)) OR (target LIKE '%*%' AND path GLOB target)
      OR (target NOT LIKE '%*%' AND target LIKE '%/%' AND regexp_replace(target, '^.*/', '') NOT LIKE '%.%' AND starts_with(path, target || '/')))"""
rules = lambda c: c.part.selectExpr(*RULE_COLUMNS)


def changed_files(c):
    """Files with an import of their own, and the files of their folder as those that depend on them."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    many = c.files.groupBy(folder.alias("folder")).agg(F.count("*").alias("dependents"))
    text = F.concat(F.lit("import mod"), F.col("doc_id") % 9, F.lit("\n"), "text")
    return c.files.withColumn("folder", folder).join(many, "folder").select("path", text.alias("text"), "dependents")


query(
    "join_antibody",
    lambda c: globs.hits(changed_files(c), rules(c)),
    f"""WITH r AS ({RULES}), f AS (SELECT path, 'import mod' || (doc_id % 9) || chr(10) || text AS text, count(*) OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '')) AS dependents FROM files),
    m AS (SELECT * FROM f JOIN r ON status = 'active' AND {MET})
    SELECT path, rule, severity FROM m WHERE kind IN ('file_modified', 'file_created') OR (kind = 'coupling_threshold' AND max_dependents > 0 AND dependents > max_dependents)
    OR (kind = 'pattern_match' AND regexp_matches(text, pattern)) OR (kind = 'import_added' AND len(list_filter(string_split(text, chr(10)), lambda x: (starts_with(trim(x), 'import ') OR starts_with(trim(x), 'from ')) AND regexp_matches(trim(x), pattern))) > 0)""",
)
