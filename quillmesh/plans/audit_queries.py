"""Audits: eleven analyzers with one finding schema, the health scan over them, and the security checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.catalog import Catalog
from ..sources.scratch import kept
from . import registry
from .registry import query

#: Extension point: each analyzer is a query and how its rows are findings: severity, category, subject and value, as Spark and DuckDB both read it.
ANALYZERS = {
    "api_surface": ("agg_api_surface", "CASE WHEN pct < 50 THEN 'warning' ELSE 'info' END", "coverage", "module", "pct"),
    "circular_deps": ("gr_cycles", "CASE WHEN size >= 6 THEN 'critical' WHEN size >= 3 THEN 'warning' ELSE 'info' END", "architecture", "root", "size"),
    "dead_code": ("join_dead_code", "'info'", "quality", "file_path", "0"),
    "duplicate_logic": ("join_duplicate_pairs", "CASE WHEN jaccard >= 0.8 THEN 'warning' ELSE 'info' END", "quality", "concat(a, ' ', b)", "jaccard"),
    "hub_bottlenecks": ("agg_hub_zscore", "CASE WHEN z >= 3 THEN 'warning' ELSE 'info' END", "architecture", "id", "in_degree"),
    "large_files": ("agg_large_files", "severity", "size", "id", "0"),
    "misplaced_imports": ("join_cross_module", "severity", "architecture", "concat(source_module, ' ', target_module)", "imports"),
    "naming": ("agg_naming", "'info'", "naming", "rule", "n"),
    "staleness": ("agg_staleness", "CASE WHEN kind = 'orphan' THEN 'warning' ELSE 'info' END", "quality", "path", "0"),
    "tech_debt": ("agg_tech_debt", "CASE WHEN items >= 5 THEN 'warning' ELSE 'info' END", "quality", "module", "items"),
    "test_coverage": ("join_test_source", "'info'", "testing", "source", "1"),
}


def findings(c: Catalog, names: list[str] | None = None) -> DataFrame:
    """analyzer, severity, category, subject and value of the named analyzers, all by default."""

    def one(name: str) -> DataFrame:
        source, severity, category, subject, value = ANALYZERS[name]
        rows = registry.QUERIES[source](c.spark, c.dir)
        return rows.selectExpr(f"'{name}' AS analyzer", f"{severity} AS severity", f"'{category}' AS category", f"{subject} AS subject",
            f"round(cast({value} AS double), 4) AS value")

    return reduce(DataFrame.unionByName, map(one, names or sorted(ANALYZERS)))


def findings_sql(names: list[str] | None = None) -> str:
    def one(name: str) -> str:
        source, severity, category, subject, value = ANALYZERS[name]
        return f"""SELECT '{name}' AS analyzer, {severity} AS severity, '{category}' AS category, {subject} AS subject, round(cast({value} AS DOUBLE), 4) AS value
            FROM ({registry.ORACLE_SQL[source]})"""

    return "SELECT * FROM (" + " UNION ALL ".join(map(one, names or sorted(ANALYZERS))) + ")"


query("udf_analyzer", lambda c: findings(c, ["large_files", "dead_code"]), findings_sql(["large_files", "dead_code"]))
query("agg_audit", findings, findings_sql())
#: What a severity takes off a file's or module's score.
COST = "CASE severity WHEN 'critical' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END"
query(
    "agg_health_scan",
    lambda c: findings(c).groupBy("analyzer", "category", "severity").agg(F.count("*").alias("n"), F.sum(F.expr(COST)).alias("cost")),
    f"SELECT analyzer, category, severity, count(*) AS n, sum({COST})::BIGINT AS cost FROM ({findings_sql()}) GROUP BY 1, 2, 3",
)

SECRET = "|".join(p for n, p in tx.SECRETS.items() if n not in ("generic", "aws_secret"))
PLANTED = "|".join(tx.SUSPICIOUS[n] for n in ("ignore_previous", "disregard", "you_are_now", "new_instructions", "system_role"))
#: Security checks: of which table, which rows are against it (as Spark and DuckDB both read it; {match} is either's regular expression function), what share of the rows may be, and its weight.
CHECKS = {
    "secrets_in_texts": ("documents", f"{{match}}(text, '{SECRET}')", 0.0, 3),
    "passwords_in_texts": ("documents", "{match}(lower(text), 'password[ ]*[:=]')", 0.0, 2),
    "invisible_characters": ("documents", f"{{match}}(text, '{tx.INVISIBLE}')", 0.0, 2),
    "planted_instructions": ("documents", f"{{match}}(text, '{PLANTED}')", 0.0, 3),
    "shell_commands": ("documents", f"{{match}}(text, '{tx.SUSPICIOUS['code_call']}')", 0.0, 2),
    "addresses_in_texts": ("documents", "{match}(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+')", 0.05, 1),
    "texts_of_one_line_again_and_again": ("documents", "length(text) > 2000 AND length(replace(text, substring(text, 1, 40), '')) * 2 < length(text)", 0.01, 1),
    "vendored_files_indexed": ("files", "path LIKE 'node_modules/%'", 0.0, 2),
    "generated_files_indexed": ("files", "path LIKE '%.lock'", 0.1, 1),
    "files_too_large": ("files", "size > 100000", 0.01, 1),
    "edges_from_outside": ("edges", "origin = 'external'", 0.2, 1),
    "unsure_edges": ("edges", "origin = 'inferred' AND confidence < 0.3", 0.1, 1),
    "stale_knowledge": ("observations", "stale", 0.5, 1),
    "stale_knowledge_still_valid": ("observations", "stale AND valid_to IS NULL", 0.1, 2),
    "critical_items_open": ("items", "severity = 'critical' AND NOT dismissed", 0.2, 2),
    "unreviewed_concepts": ("concepts", "status = 'seed' AND confidence < 0.2", 0.1, 1),
}


def checks(c: Catalog) -> DataFrame:
    """name, found, rows, passed and weight of each check: each table is read once for all of its checks."""
    out = []
    for t in sorted({t for t, *_ in CHECKS.values()}):
        own = {n: x for n, x in CHECKS.items() if x[0] == t}
        counts = getattr(c, t).agg(F.count("*").alias("rows"), *(F.count_if(F.expr(x[1].replace("{match}", "regexp_like").replace("\\", "\\\\"))).alias(n) for n, x in own.items()))
        one = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("found"), F.lit(x[2]).alias("share"), F.lit(x[3]).alias("weight")) for n, x in own.items()))
        out.append(counts.select("rows", F.explode(one).alias("k")).select("k.name", "k.found", "rows", (F.col("k.found") <= F.col("k.share") * F.col("rows")).alias("passed"), "k.weight"))
    return reduce(DataFrame.unionByName, out)


def security_score(c: Catalog) -> DataFrame:
    """The checks and, as one more row, the weighted share of those that passed, of 100; 70 are wanted."""
    found = kept(checks(c), "security", small=True)  # a row a check
    score = found.agg(F.round(100.0 * F.sum(F.when(F.col("passed"), F.col("weight"))) / F.sum("weight")).cast("long").alias("found"))
    return found.unionByName(score.select(F.lit("score").alias("name"), "found", F.lit(None).cast("long").alias("rows"), (F.col("found") >= 70).alias("passed"), F.lit(None).cast("int").alias("weight")))


def checks_sql() -> str:
    one = lambda n, t, against, share, weight: (f"SELECT '{n}' AS name, count(*) FILTER ({against.replace("{match}", "regexp_matches")}) AS found, count(*) AS rows, "  # noqa: E731
        f"count(*) FILTER ({against.replace("{match}", "regexp_matches")}) <= {share}::DOUBLE * count(*) AS passed, {weight} AS weight FROM {t}")
    return " UNION ALL ".join(one(n, *x) for n, x in CHECKS.items())


query(
    "agg_security_score",
    security_score,
    f"WITH k AS ({checks_sql()}) SELECT * FROM k UNION ALL SELECT 'score', round(100.0 * sum(weight) FILTER (passed) / sum(weight))::BIGINT, NULL, round(100.0 * sum(weight) FILTER (passed) / sum(weight)) >= 70, NULL FROM k",
)
