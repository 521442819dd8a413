"""Logical tables of a code corpus, derived from the relational tables, lazily.

Each is a DataFrame here and a SQL text in ``TABLES`` with the same columns, so
that a query can be compared with plain SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Logical tables as SQL; names of others may be used in them.
TABLES = {
    "part_paths": "SELECT p_partkey, 'part/' || replace(p_brand, '#', '') || '/' || CAST(p_partkey AS VARCHAR) || '.py' AS path, p_brand, p_name, p_type, p_size FROM part",
    "nodes": """SELECT 'file:' || path AS id, 'file' AS kind, CAST(p_partkey AS VARCHAR) || '.py' AS name, path AS file_path, 'python' AS language, CAST(p_size AS BIGINT) * 2000 AS size FROM part_paths
        UNION ALL SELECT 'file:supplier/' || CAST(s_suppkey AS VARCHAR) || '.ts', 'file', CAST(s_suppkey AS VARCHAR) || '.ts', 'supplier/' || CAST(s_suppkey AS VARCHAR) || '.ts', 'typescript', s_suppkey * 100 FROM supplier
        UNION ALL SELECT 'sym:' || c_name || '@' || path, 'symbol', c_name, path, 'python', CAST(NULL AS BIGINT) FROM customer JOIN part_paths ON p_partkey = c_custkey""",
    "edges": """SELECT 'file:supplier/' || CAST(l_suppkey AS VARCHAR) || '.ts' AS source, 'file:' || path AS target, 'imports' AS kind, 'static' AS origin, count(*) AS weight, CAST(1.0 AS DOUBLE) AS confidence FROM lineitem JOIN part_paths ON l_partkey = p_partkey WHERE l_quantity > 25 GROUP BY 1, 2
        UNION ALL SELECT 'file:' || path, 'file:supplier/' || CAST(l_suppkey AS VARCHAR) || '.ts', 'imports', 'inferred', count(*), max(l_discount) * 10 FROM lineitem JOIN part_paths ON l_partkey = p_partkey WHERE l_quantity <= 1 GROUP BY 1, 2
        UNION ALL SELECT 'sym:' || c_name || '@' || own.path, 'file:' || used.path, 'calls', 'lsp', count(*), CAST(1.0 AS DOUBLE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part_paths own ON own.p_partkey = c_custkey JOIN part_paths used ON used.p_partkey = l_partkey WHERE l_linenumber = 1 GROUP BY 1, 2
        UNION ALL SELECT 'file:' || path, 'sym:' || c_name || '@' || path, 'contains', 'static', 1, CAST(1.0 AS DOUBLE) FROM customer JOIN part_paths ON p_partkey = c_custkey
        UNION ALL SELECT 'file:supplier/' || CAST(s_suppkey AS VARCHAR) || '.ts', 'ext:nation' || CAST(s_nationkey AS VARCHAR), 'imports', 'external', 1, CAST(0.5 AS DOUBLE) FROM supplier""",
    "files": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'src/core' WHEN 1 THEN 'tests/unit' WHEN 2 THEN 'docs' WHEN 3 THEN 'src/api' WHEN 4 THEN 'node_modules/lib' WHEN 5 THEN 'src/ui' WHEN 6 THEN 'deploy' ELSE 'config' END || '/' || source || '/' ||
        CASE doc_id % 5 WHEN 1 THEN 'test_' ELSE '' END || 'doc_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.rs' WHEN 4 THEN '.lock' WHEN 5 THEN '.test.tsx' ELSE '.json' END AS path,
        n_chars AS size, md5(text) AS hash, text, lang, source FROM documents""",
    "commits": """SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts, path, CAST(l_quantity AS BIGINT) AS added,
        CAST(l_linenumber AS BIGINT) AS removed FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part_paths ON l_partkey = p_partkey""",
    "observations": """SELECT event_id AS id, 'project' || CAST(user_id % 3 AS VARCHAR) AS project_id, user_id AS agent, event_type AS category, ts AS created_at, 'src/m' || CAST(event_id % 7 AS VARCHAR) || '/f' || CAST(event_id % 97 AS VARCHAR) || '.py' AS file_path,
        event_type || ' seen with ' || props AS content, value > 150 AS stale, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_id % 97 ORDER BY ts, event_id) AS valid_to FROM events""",
    "usage": """SELECT event_id AS id, ts, 'project' || CAST(user_id % 3 AS VARCHAR) AS project_id, event_type AS task_id, 'model' || CAST(event_id % 4 AS VARCHAR) AS model, 'provider' || CAST(event_id % 2 AS VARCHAR) AS provider,
        CAST(floor(value) AS BIGINT) AS prompt_tokens, event_id % 50 AS completion_tokens, CAST(floor(value) AS BIGINT) + event_id % 50 AS total_tokens FROM events""",
    "items": """SELECT o_orderkey AS id, 'P' || CAST(least(CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1, 3) AS VARCHAR) AS priority, CASE o_orderkey % 4 WHEN 0 THEN 'quality' WHEN 1 THEN 'security' WHEN 2 THEN 'structure' ELSE 'debt' END AS category,
        CASE o_orderkey % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'scorer' ELSE 'roadmap' END AS source, 'analyzer' || CAST(o_custkey % 6 AS VARCHAR) AS analyzer, CASE WHEN o_totalprice > 300000 THEN 'critical' WHEN o_totalprice > 150000 THEN 'warning' ELSE 'info' END AS severity,
        'part/' || CAST(o_custkey % 40 AS VARCHAR) || '.py' AS file_path, o_orderkey % 7 = 0 AS dismissed, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS value FROM orders""",
    "concepts": """SELECT p_partkey AS id, p_name AS title, p_size / 50.0 AS confidence, 'part' || CAST(p_partkey % 53 AS VARCHAR) AS a1, 'area' || CAST(p_partkey % 47 AS VARCHAR) AS a2, p_type AS kind,
        CASE p_partkey % 3 WHEN 0 THEN 'constraint' WHEN 1 THEN 'architecture' ELSE 'technical' END AS category, CASE WHEN p_partkey % 5 = 0 THEN 'seed' ELSE 'active' END AS status, p_brand AS module FROM part""",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
    "modules": "SELECT p_brand AS module, path FROM part_paths",
}


def sql(body: str) -> str:
    """body with the logical tables that it names, as one WITH statement that DuckDB runs."""
    need: dict[str, str] = {}

    def add(text: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(TABLES[name])
                need[name] = TABLES[name]

    add(body)
    lead = ", ".join(f"{k} AS ({v})" for k, v in need.items())
    if not lead:
        return body
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    return f"WITH {(m[1] or '') if m else ''}{lead}{', ' + body[m.end():] if m else ' ' + body}"


class Catalog:
    """Tables of one folder. Base tables by name; logical ones as properties."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def part_paths(self) -> DataFrame:
        path = F.concat(F.lit("part/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py"))
        return self.part.select("p_partkey", path.alias("path"), "p_brand", "p_name", "p_type", "p_size")

    @cached_property
    def nodes(self) -> DataFrame:
        def file(key: str, path, language: str, size):
            return [F.concat(F.lit("file:"), path).alias("id"), F.lit("file").alias("kind"),
                F.concat(F.col(key).cast("string"), F.lit(".py" if language == "python" else ".ts")).alias("name"), path.alias("file_path"),
                F.lit(language).alias("language"), size.cast("long").alias("size")]

        supplier = F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"), F.lit(".ts"))
        parts = self.part_paths.select(*file("p_partkey", F.col("path"), "python", F.col("p_size") * 2000))
        suppliers = self.supplier.select(*file("s_suppkey", supplier, "typescript", F.col("s_suppkey") * 100))
        own = self.customer.join(self.part_paths, F.col("p_partkey") == F.col("c_custkey"))
        symbols = own.select(self._symbol().alias("id"), F.lit("symbol").alias("kind"), F.col("c_name").alias("name"), F.col("path").alias("file_path"),
            F.lit("python").alias("language"), F.lit(None).cast("long").alias("size"))
        return parts.unionByName(suppliers).unionByName(symbols)

    @staticmethod
    def _symbol():
        return F.concat(F.lit("sym:"), F.col("c_name"), F.lit("@"), F.col("path"))

    @cached_property
    def edges(self) -> DataFrame:
        supplier = F.concat(F.lit("file:supplier/"), F.col("l_suppkey").cast("string"), F.lit(".ts"))
        lines = self.lineitem.join(self.part_paths, F.col("l_partkey") == F.col("p_partkey"))
        part = F.concat(F.lit("file:"), F.col("path"))

        def counted(rows: DataFrame, source, target, kind: str, origin: str, confidence) -> DataFrame:
            return rows.groupBy(source.alias("source"), target.alias("target")).agg(F.count("*").alias("weight"),
                confidence.alias("confidence")).select("source", "target", F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), "weight", "confidence")

        one = F.max(F.lit(1.0))
        static = counted(lines.where("l_quantity > 25"), supplier, part, "imports", "static", one)
        inferred = counted(lines.where("l_quantity <= 1"), part, supplier, "imports", "inferred", F.max("l_discount") * 10)
        own = self.customer.join(self.part_paths, F.col("p_partkey") == F.col("c_custkey")).select("c_custkey", self._symbol().alias("symbol"), "path")
        used = self.lineitem.where("l_linenumber = 1").join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(own.drop("path"),
            F.col("o_custkey") == F.col("c_custkey")).join(self.part_paths, F.col("l_partkey") == F.col("p_partkey"))
        calls = counted(used, F.col("symbol"), part, "calls", "lsp", one)
        contains = own.select(F.concat(F.lit("file:"), F.col("path")).alias("source"), F.col("symbol").alias("target"), F.lit("contains").alias("kind"),
            F.lit("static").alias("origin"), F.lit(1).cast("long").alias("weight"), F.lit(1.0).alias("confidence"))
        external = self.supplier.select(F.concat(F.lit("file:supplier/"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("source"),
            F.concat(F.lit("ext:nation"), F.col("s_nationkey").cast("string")).alias("target"), F.lit("imports").alias("kind"),
            F.lit("external").alias("origin"), F.lit(1).cast("long").alias("weight"), F.lit(0.5).alias("confidence"))
        return static.unionByName(inferred).unionByName(calls).unionByName(contains).unionByName(external)

    @cached_property
    def files(self) -> DataFrame:
        pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
        folder = pick(8, ["src/core", "tests/unit", "docs", "src/api", "node_modules/lib", "src/ui", "deploy", "config"])
        end = pick(7, [".py", ".ts", ".md", ".rs", ".lock", ".test.tsx", ".json"])
        path = F.concat(folder, F.lit("/"), F.col("source"), F.lit("/"), pick(5, ["", "test_", "", "", ""]), F.lit("doc_"), F.col("doc_id").cast("string"), end)
        return self.documents.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), F.md5(F.col("text").cast("binary")).alias("hash"), "text",
            "lang", "source")

    @cached_property
    def commits(self) -> DataFrame:
        rows = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.part_paths, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), "path",
            F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("removed"))

    @cached_property
    def observations(self) -> DataFrame:
        return self.events.selectExpr("event_id AS id", "concat('project', user_id % 3) AS project_id", "user_id AS agent", "event_type AS category",
            "ts AS created_at", "concat('src/m', event_id % 7, '/f', event_id % 97, '.py') AS file_path",
            "concat(event_type, ' seen with ', props) AS content", "value > 150 AS stale", "ts AS valid_from",
            "lead(ts) OVER (PARTITION BY user_id, event_id % 97 ORDER BY ts, event_id) AS valid_to")

    @cached_property
    def usage(self) -> DataFrame:
        return self.events.selectExpr("event_id AS id", "ts", "concat('project', user_id % 3) AS project_id", "event_type AS task_id",
            "concat('model', event_id % 4) AS model", "concat('provider', event_id % 2) AS provider", "cast(floor(value) AS bigint) AS prompt_tokens",
            "event_id % 50 AS completion_tokens", "cast(floor(value) AS bigint) + event_id % 50 AS total_tokens")

    @cached_property
    def items(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS id", "concat('P', least(cast(substr(o_orderpriority, 1, 1) AS bigint) - 1, 3)) AS priority",
                "element_at(array('quality', 'security', 'structure', 'debt'), cast(o_orderkey % 4 AS int) + 1) AS category",
            "element_at(array('audit', 'scorer', 'roadmap'), cast(o_orderkey % 3 AS int) + 1) AS source", "concat('analyzer', o_custkey % 6) AS analyzer",
                "CASE WHEN o_totalprice > 300000 THEN 'critical' WHEN o_totalprice > 150000 THEN 'warning' ELSE 'info' END AS severity",
            "concat('part/', o_custkey % 40, '.py') AS file_path", "o_orderkey % 7 = 0 AS dismissed", "o_orderdate AS created_at", "o_orderstatus AS status",
                "o_totalprice AS value")

    @cached_property
    def concepts(self) -> DataFrame:
        return self.part.selectExpr("p_partkey AS id", "p_name AS title", "cast(p_size / 50.0D AS double) AS confidence",
            "concat('part', p_partkey % 53) AS a1", "concat('area', p_partkey % 47) AS a2", "p_type AS kind",
            "element_at(array('constraint', 'architecture', 'technical'), cast(p_partkey % 3 AS int) + 1) AS category",
            "CASE WHEN p_partkey % 5 = 0 THEN 'seed' ELSE 'active' END AS status", "p_brand AS module")

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", "embedding", "label")

    @property
    def modules(self) -> DataFrame:
        return self.part_paths.select(F.col("p_brand").alias("module"), "path")
