"""Registered chunking, parsing, levels of detail, vector, role and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, replies, roles
from ..functions import vectors as vf
from ..operators import content, parsing
from ..operators import joins as jo
from .registry import query


def code_text():
    return F.concat(F.lit("# a note\nimport os\nclass A"), F.col("doc_id").cast("string"), F.lit(":\n  def run(self):\n    pass\n"), F.col("text"))


code = lambda c: c.files.withColumn("text", code_text())
md = lambda c: c.documents.select("doc_id", F.concat(F.lit("intro\n# Top\n"), F.col("text"), F.lit("\n## Sub\nbody\n# Next\nend")).alias("text"))

def module_text():
    """A Python module a document, its text as comments at the end."""
    n = F.col("doc_id").cast("string")
    head = ['"""Module ', n, '."""\nimport os\nfrom pkg.m', (F.col("doc_id") % 5).cast("string"), " import thing\nLIMIT = 3\nclass A", n,
        '(Base):\n    """Class doc."""\n    def run(self, x):\n        """Runs."""\n        y = helper', n]
    tail = ["(x)\n        return y\ndef helper", n, "(v):\n    return os.path.join(v)\n# "]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in [*head, *tail]),
        F.regexp_replace("text", r"[\n\r\f\x0b\x1c-\x1e\x85\u2028\u2029]", "\n# "))


modules = lambda c: c.files.withColumn("text", module_text())
#: The same module as DuckDB writes its rows: part, kind, name, target, start_line, end_line.
MODULE_ROWS = """(VALUES ('edge', 'imports', '', 'os', 2, NULL), ('edge', 'imports', '', 'pkg.m' || (doc_id % 5), 3, NULL), ('node', 'class', 'A' || doc_id, NULL, 5, 10), ('edge', 'contains', '', 'A' || doc_id, 5, NULL),
    ('edge', 'inherits', 'A' || doc_id, 'Base', 5, NULL), ('node', 'method', 'A' || doc_id || '.run', NULL, 7, 10), ('edge', 'contains', 'A' || doc_id, 'A' || doc_id || '.run', 7, NULL),
    ('edge', 'calls', 'A' || doc_id || '.run', 'helper' || doc_id, 9, NULL), ('node', 'function', 'helper' || doc_id, NULL, 11, 12), ('edge', 'contains', '', 'helper' || doc_id, 11, NULL),
    ('edge', 'calls', 'helper' || doc_id, 'os.path.join', 12, NULL)) v(part, kind, name, target, start_line, end_line)"""
HEAD2 = """'\"\"\"Module ' || doc_id || '.\"\"\"' || chr(10) || 'import os' || chr(10) || 'from pkg.m' || (doc_id % 5) || ' import thing'"""
CLASS2 = """'class A' || doc_id || '(Base):' || chr(10) || '    \"\"\"Class doc.\"\"\"' || chr(10) || '    def run(self, x):' || chr(10) || '        \"\"\"Runs.\"\"\"' || chr(10) || '        ...'"""
BARE = """regexp_replace(text, '[\\n\\r\\f\\x0b\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10) || '# ', 'g')"""

query("gen_chunk_code", lambda c: content.chunks(c.files).select("path", "chunk_index", "chunk_id", F.md5("content").alias("digest"), "start_line", "end_line"),
      """WITH k AS (SELECT path, text, unnest(CASE WHEN length(text) <= 2000 THEN [0] ELSE range(0, length(text), 1800) END) AS s FROM files)
      SELECT path, (s // 1800)::INT AS chunk_index, substr(sha256(path || ':' || (s // 1800)::VARCHAR), 1, 16) AS chunk_id, md5(substr(text, s + 1, 2000)) AS digest,
      (length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1)::INT AS start_line,
      greatest(length(substr(text, 1, s + 2000)) - length(replace(substr(text, 1, s + 2000), chr(10), '')) + 1 - CASE WHEN substr(text, least(s + 2000, length(text)), 1) = chr(10) THEN 1 ELSE 0 END, 1)::INT AS end_line FROM k""")
query("gen_rust_chunk_code", lambda c: content.chunks(c.files, 1000, 100).select("path", "chunk_index", "chunk_id", F.md5("content").alias("digest"), "start_line"),
      """WITH k AS (SELECT path, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 900) END) AS s FROM files)
      SELECT path, (s // 900)::INT AS chunk_index, substr(sha256(path || ':' || (s // 900)::VARCHAR), 1, 16) AS chunk_id, md5(substr(text, s + 1, 1000)) AS digest,
      (length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1)::INT AS start_line FROM k""")
query("gen_sentences", lambda c: content.sentences(c.documents),
    r"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|' || chr(10) || chr(10) || '+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS sentence, generate_subscripts(list_filter(list_transform(string_split_regex(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|' || chr(10) || chr(10) || '+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), 1) - 1 AS i FROM documents) SELECT doc_id, i::INT AS i, sentence FROM p""")
query("gen_split_long", lambda c: content.packed_paragraphs(c.documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")), 900)
    .select("doc_id", "i", F.length("part").alias("chars")))
query("gen_md_sections", lambda c: content.markdown_sections(md(c)).select("doc_id", "i", "section", "start_line", F.md5("text").alias("digest")))
query("gen_chunk_md", lambda c: content.markdown_chunks(md(c)).select("doc_id", "i", "section", "start_line", "end_line", F.length("content").alias("chars")))
query("gen_rust_chunk_md", lambda c: content.markdown_chunks(md(c), 1000, 200).select("doc_id", "i", "section", "start_line", "end_line", F.md5("content").alias("digest")))
query("gen_semantic_split", lambda c: content.semantic_parts(c.documents).select("doc_id", "i", F.length("part").alias("chars"), F.md5("part").alias("digest")))
query(
    "gen_parse_python",
    lambda c: parsing.python_graph(modules(c)),
    f"SELECT path, part, kind, name, target, start_line::INT AS start_line, end_line::INT AS end_line FROM files, LATERAL (SELECT * FROM {MODULE_ROWS})",
)
query(
    "gen_parse_js",
    lambda c: parsing.script_imports(
        c.files.where("path LIKE '%.ts'")
            .select("path", F.concat(F.lit("import {a} from './doc_"), "doc_id",
            F.lit("'\nconst b = require(\"../../core/src0/doc_0.py\")\nimport c from '@/api/src3/doc_3'\nimport React from 'react'\n"), "text").alias("text")),
        c.files, {"@/": "src/"}),
    """WITH i AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, unnest(['./doc_' || doc_id, '../../core/src0/doc_0.py', '@/api/src3/doc_3', 'react']) AS specifier, doc_id FROM files WHERE path LIKE '%.ts'),
    p AS (SELECT path, specifier, CASE WHEN specifier LIKE './%' THEN dir || '/doc_' || doc_id WHEN specifier LIKE '..%' THEN regexp_replace(dir, '/[^/]*/[^/]*$|^[^/]*/[^/]*$', '') || '/core/src0/doc_0.py'
        WHEN specifier LIKE '@/%' THEN 'src/api/src3/doc_3' END AS place FROM i),
    t AS (SELECT p.path, specifier, f.path AS target FROM p JOIN files f ON f.path = trim(place, '/') OR f.path = trim(place, '/') || '.ts' OR f.path = trim(place, '/') || '.tsx')
    SELECT p.path, p.specifier, min(t.target) AS target FROM p LEFT JOIN t ON t.path = p.path AND t.specifier = p.specifier GROUP BY 1, 2""",
)
query("lod_extract", lambda c: parsing.skeletons(modules(c), "3").select("path", F.md5("skeleton").alias("digest")),
      f"SELECT path, md5({HEAD2} || chr(10) || 'LIMIT = 3' || chr(10) || {CLASS2} || chr(10) || '# ' || {BARE}) AS digest FROM files")
query("lod_strip_comments", lambda c: c.documents.select("doc_id", F.md5(content.level(F.concat(F.lit("// x\na\n  # y\n"), "text"), 1)).alias("d")), """SELECT doc_id, md5(list_aggregate(list_filter(string_split('// x' || chr(10) || 'a' || chr(10) || '  # y' || chr(10) || text, chr(10)),
    lambda x: NOT regexp_matches(x, '^\\s*(#|//|\\*|/\\*)')), 'string_agg', chr(10))) AS d FROM documents""")
query("lod_signatures", lambda c: parsing.skeletons(modules(c), "2").select("path", F.md5("skeleton").alias("digest")),
      f"SELECT path, md5({HEAD2} || chr(10) || 'LIMIT = 3' || chr(10) || {CLASS2} || chr(10) || 'def helper' || doc_id || '(v):' || chr(10) || '    ...' || chr(10) || '# ' || {BARE}) AS digest FROM files")
query("lod_25", lambda c: parsing.skeletons(modules(c), "2.5"),
      f"SELECT path, 'import os' || chr(10) || 'from pkg.m' || (doc_id % 5) || ' import thing' || chr(10) || {CLASS2} || chr(10) || 'def helper' || doc_id || '(v):' || chr(10) || '    ...' AS skeleton FROM files")
query(
    "lod_names",
    lambda c: parsing.skeletons(modules(c), "4"),
    """SELECT path, 'import os' || chr(10) || 'from pkg.m' || (doc_id % 5) || ' import thing' || chr(10) || 'class A' || doc_id || '(Base):' || chr(10) || '    def run(self, x):' || chr(10)
    || 'def helper' || doc_id || '(v):' AS skeleton FROM files""",
)
query(
    "lod_summary",
    lambda c: parsing.summaries(parsing.python_graph(modules(c)),
        c.files.select("path", F.concat(F.lit("about "), "source").alias("summary"), F.when(F.col("lang") == "en", "english").alias("role"))),
    """SELECT path, '# ' || path || chr(10) || '## about ' || source || CASE WHEN lang = 'en' THEN chr(10) || 'Role: english' ELSE '' END || chr(10)
    || 'Exports: A' || doc_id || ', A' || doc_id || '.run, helper' || doc_id AS summary FROM files""",
)
query("lod_skeleton", lambda c: c.nodes.where("kind = 'symbol'").groupBy("file_path")
    .agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 20), "\n").alias("skeleton")),
    "SELECT file_path, string_agg(DISTINCT name, chr(10) ORDER BY name) AS skeleton FROM nodes WHERE kind = 'symbol' GROUP BY 1")
query("vec_embed_fake", lambda c: c.documents.select("doc_id", vf.fake(F.col("text")).alias("embedding")))


def embedded_sql(dims: int) -> str:
    """Signed counts of words by their CRC-32, at unit length, component by component."""
    return f"""WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark), b AS (SELECT item_id, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM w),
    h AS (SELECT item_id, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS h FROM b, t),
    v AS (SELECT item_id, h % {dims} AS i, sum(CASE WHEN (h >> 20) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM h GROUP BY 1, 2),
    n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1)
    SELECT b.item_id, g.i::INT AS i, round(coalesce(v / nullif(n, 0), 0.0::DOUBLE), 6) + 0.0::DOUBLE AS value FROM benchmark b CROSS JOIN range({dims}) g(i) LEFT JOIN v ON v.item_id = b.item_id AND v.i = g.i LEFT JOIN n ON n.item_id = b.item_id"""


embedded = lambda c, embed: c.benchmark.select("item_id", F.posexplode(embed(F.col("text"))).alias("i", "value")).withColumn("value", F.round("value", 6) + 0.0)
query("vec_embed_native", lambda c: embedded(c, lambda t: vf.hashed(t, 32)), embedded_sql(32))
query("vec_matryoshka", lambda c: c.vectors.select("vec_id", F.round(vf.norm(vf.shortened(F.col("embedding"), 16)), 6).alias("n"), F.round(F.element_at(vf.shortened(F.col("embedding"), 16), 1), 6).alias("x")), """WITH h AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS h FROM vectors)
    SELECT vec_id, 1.0::DOUBLE AS n, round(h[1] / sqrt(list_inner_product(h, h)), 6) AS x FROM h""")
NEAR = lambda c: c.vectors.join(F.broadcast(c.vectors.where("vec_id = 0").select(F.col("embedding").alias("q")))).where("vec_id != 0").select("vec_id",
    "label", "embedding", vf.dot(F.col("embedding"), F.col("q")).alias("score"))
query("vec_mmr", lambda c: vf.diverse(NEAR(c).orderBy(F.desc("score"), "vec_id").limit(50)
    .select(F.lit(0).alias("q"), F.col("vec_id").alias("id"), "score", F.col("embedding").alias("vec")), "q", 10, 0.7))
SC = """WITH s AS (SELECT v.vec_id, v.label, list_inner_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding,
    lambda x: x::DOUBLE)) AS score FROM vectors v, vectors q WHERE q.vec_id = 0 AND v.vec_id <> 0)"""
#: Neighbours of a file: those of its source and language.
query(
    "vec_trace_expand",
    lambda c: vf.within_budget(
        vf.expanded(NEAR(c).orderBy(F.desc("score"), "vec_id").limit(10).select(F.col("vec_id").alias("id"), "score"),
            c.files.select(F.col("doc_id").alias("a"), "source", "lang").join(c.files.select(F.col("doc_id").alias("b"), "source", "lang"), ["source", "lang"]).where("a != b").select("a", "b"))
        .join(c.files.select(F.col("doc_id").alias("id"), "size"), "id").withColumn("q", F.lit(0)), "q", [F.desc("score"), "id"], "size", 60_000)
            .select("id", "why", F.round("score", 6).alias("score"), "taken"),
    f"""{SC}, t AS (SELECT vec_id AS id, score FROM s ORDER BY score DESC, vec_id LIMIT 10),
    n AS (SELECT g.doc_id AS id, max(score) * 0.5::DOUBLE AS score FROM t JOIN files f ON f.doc_id = t.id JOIN files g ON g.source = f.source AND g.lang = f.lang AND g.doc_id <> f.doc_id
      WHERE g.doc_id NOT IN (SELECT id FROM t) GROUP BY 1),
    a AS (SELECT id, score, 'found' AS why FROM t UNION ALL SELECT id, score, 'neighbour' FROM n), z AS (SELECT a.*, size, sum(size) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS e FROM a JOIN files ON doc_id = id)
    SELECT id, why, round(score, 6) AS score, CASE WHEN e <= 60000 THEN size ELSE 60000 - (e - size) END::BIGINT AS taken FROM z WHERE e <= 60000 OR 60000 - (e - size) > 200""",
)
query("vec_budget", lambda c: vf.within_budget(c.files.select("source", "doc_id", "size"), "source", [F.desc("size"), "doc_id"], "size", 6000).select("source", "doc_id", "taken"), """SELECT source, doc_id, CASE WHEN e <= 6000 THEN size ELSE 6000 - (e - size) END::BIGINT AS taken
    FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING) AS e FROM files)
    WHERE e <= 6000 OR 6000 - (e - size) > 200""")
query("vec_boosts", lambda c: c.files.select("path", F.round(F.when(F.col("path").contains("core"), 0.15).otherwise(0.0) + F.when(paths.base_name(F.col("path")).contains("1"), 0.1).otherwise(0.0) + F.when(F.col("text").contains("The "), 0.05).otherwise(0.0), 4).alias("boost")), """SELECT path, round(CASE WHEN contains(path, 'core') THEN 0.15::DOUBLE ELSE 0 END + CASE
    WHEN contains(regexp_replace(path, '^.*/', ''), '1') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(text, 'The ') THEN 0.05::DOUBLE
    ELSE 0 END, 4) AS boost FROM files""")
query("vec_primer", lambda c: c.concepts.select("id",
    F.least(F.lit(1.0), F.col("confidence") + F.when(F.lower("a1") == "part7", 0.25).otherwise(0.0)).alias("score")),
    "SELECT id, least(1.0::DOUBLE, confidence::DOUBLE + CASE WHEN a1 = 'part7' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM concepts")
LAYERS, WORDS = {"testing": 0.9, "presentation": 0.7, "documentation": 0.4}, ["frontend", "api", "docs"]


def audiences():
    return F.create_map(F.lit("ui"), F.array(F.lit("design")), F.lit("api"), F.array(F.lit("dev")))


query("arr_role_relevance", lambda c: c.files.select("path",
    roles.relevance(paths.layer(F.col("path")), content.path_tags(F.col("path")), F.lit(0.0), F.col("doc_id") % 40, F.lit(100), (F.col("doc_id") % 10) / 10.0,
    LAYERS, ["backend"], 0.5).alias("score")),
      """SELECT path, round(least(1.0::DOUBLE, 0.25::DOUBLE * CASE WHEN path LIKE 'tests/%' THEN 0.9::DOUBLE WHEN path LIKE 'docs/%' THEN 0.4::DOUBLE WHEN path LIKE 'src/api%' OR path LIKE 'src/ui%' THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END + 0.3::DOUBLE * CASE WHEN regexp_matches(path, '\\.(py|ts|rs)$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.2::DOUBLE * least(1.0::DOUBLE, (doc_id % 40) / 30.0::DOUBLE) * 0.5::DOUBLE + 0.15::DOUBLE * ((doc_id % 10) / 10.0::DOUBLE)), 4) AS score FROM files""")
query(
    "arr_role_relevance_rs",
    lambda c: c.files.select("path",
        F.round(roles.relevance(paths.layer(F.col("path")), content.path_tags(F.col("path")), F.lit(0.0), F.col("doc_id") % 40, F.lit(100), F.lit(0.0), LAYERS,
        ["backend"], 0.5).cast("float").cast("double"), 3).alias("score")),
    """SELECT path, round(least(1.0::DOUBLE, 0.25::DOUBLE * CASE WHEN path LIKE 'tests/%' THEN 0.9::DOUBLE WHEN path LIKE 'docs/%' THEN 0.4::DOUBLE WHEN path LIKE 'src/api%' OR path LIKE 'src/ui%' THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END
    + 0.3::DOUBLE * CASE WHEN regexp_matches(path, '\\.(py|ts|rs)$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.2::DOUBLE * least(1.0::DOUBLE, (doc_id % 40) / 30.0::DOUBLE) * 0.5::DOUBLE)::FLOAT::DOUBLE, 3) AS score FROM files""",
)
query("arr_audience", lambda c: c.files.select("path", F.round(roles.audience(content.path_tags(F.col("path")), audiences(), "dev"), 6).alias("share"))
    .where("share > 0").select("path"), "SELECT path FROM files WHERE path LIKE 'src/api/%'")
query("arr_tag_affinity", lambda c: c.files.select("path", roles.affinity(content.path_tags(F.col("path")), F.array(F.lit("testing"), F.lit("doc"))).alias("a")), """SELECT path, CASE WHEN path LIKE '%.md' OR path LIKE 'docs/%' OR path LIKE 'tests/%' OR path LIKE '%.test.tsx' THEN 0.7::DOUBLE
    ELSE 0.0::DOUBLE END AS a FROM files""")


def path_words(c, name: str):
    """The few words that folders are called by."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return c.files.select(F.explode(F.regexp_extract_all(folder, F.lit("([a-z]+)"), F.lit(1))).alias(name)).where(F.length(name) > 1).distinct()


WORDS_OF = [(w, i) for i, words in enumerate(roles.SYNONYMS) for w in words]
#: What the words of folders' names also mean.
query(
    "arr_synonyms",
    lambda c: path_words(c, "a").join(c.spark.createDataFrame(WORDS_OF, "a string, i int"), "a").join(c.spark.createDataFrame(WORDS_OF, "b string, i int"), "i").where("a != b")
        .select("a", "b", roles.synonyms(F.col("a"), F.col("b")).alias("same")),
    f"""WITH g AS (SELECT * FROM (VALUES {", ".join(map(str, WORDS_OF))}) v(w, i)), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY w ORDER BY i DESC) = 1),
    p AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(path, '/[^/]*$', ''), '[a-z]+')) AS w FROM files)
    SELECT p.w AS a, y.w AS b, m.i = n.i AS same FROM p JOIN g x USING (w) JOIN g y ON y.i = x.i AND y.w <> p.w JOIN k m ON m.w = p.w JOIN k n ON n.w = y.w""",
)
query("arr_blend", lambda c: roles.blended(c.concepts.select(F.col("category").alias("role"), F.when(F.col("category") == "technical", 2.0).otherwise(1.0).alias("share"), F.col("module").alias("layer"), "confidence").groupBy("role", "share", "layer").agg(F.max("confidence").alias("weight"))), """WITH w AS (SELECT category AS role, CASE WHEN category = 'technical' THEN 2.0::DOUBLE
    ELSE 1.0::DOUBLE END AS share, module AS layer, max(confidence::DOUBLE) AS weight FROM concepts GROUP BY 1, 2, 3)
    SELECT layer, round(sum(share * weight) / (SELECT sum(share) FROM (SELECT DISTINCT role, share FROM w)), 6) AS weight FROM w GROUP BY layer""")
query(
    "arr_modifier",
    lambda c: c.concepts.select("id",
        F.round(roles.modified(F.col("confidence"), "category", {"constraint": (1.3, -0.2), "architecture": (0.8, 0.1)}), 6).alias("weight")),
    """SELECT id, round(least(greatest(CASE category WHEN 'constraint' THEN confidence::DOUBLE * 1.3::DOUBLE + -0.2::DOUBLE WHEN 'architecture' THEN confidence::DOUBLE * 0.8::DOUBLE + 0.1::DOUBLE
    ELSE confidence::DOUBLE END, 0.0), 1.0), 6) AS weight FROM concepts""",
)
query(
    "arr_resolve_role",
    lambda c: roles.resolved(c.concepts.select("id", "a1", "module"), c.concepts.where("status = 'seed'").groupBy("a1").agg(F.min("category").alias("role")),
        c.concepts.where("category != 'technical'").groupBy("module").agg(F.min("category").alias("role"))),
    """WITH o AS (SELECT a1, min(category) AS role FROM concepts WHERE status = 'seed' GROUP BY 1), m AS (SELECT module, min(category) AS role FROM concepts WHERE category <> 'technical' GROUP BY 1)
    SELECT id, coalesce(o.role, m.role, 'default') AS role, CASE WHEN o.role IS NOT NULL THEN 'anchor' WHEN m.role IS NOT NULL THEN 'module' ELSE 'default' END AS by
    FROM concepts c LEFT JOIN o ON o.a1 = c.a1 LEFT JOIN m ON m.module = c.module""",
)
query("arr_role_idf", lambda c: roles.term_idf(c.concepts.select(F.col("module").alias("role"), F.col("a1").alias("term")))
    .select("term", F.round("idf", 6).alias("idf")), "SELECT a1 AS term, round(1 / sqrt(count(DISTINCT module)), 6) AS idf FROM concepts GROUP BY 1")
query("arr_infer_role", lambda c: c.concepts.select("id", "a1").join(roles.term_idf(c.concepts.select(F.col("category").alias("role"), F.col("a1").alias("term"))), F.col("a1") == F.col("term")).select("id", F.when(F.col("idf") >= 0.6, "sure").otherwise("unsure").alias("verdict")), """SELECT id, CASE WHEN 1 / sqrt(n) >= 0.6 THEN 'sure' ELSE 'unsure' END AS verdict FROM concepts JOIN (SELECT a1, count(DISTINCT category) AS n
    FROM concepts GROUP BY 1) USING (a1)""")
query("arr_atlas_budget", lambda c: c.concepts.select("id", roles.atlas_budget(F.col("id") * 7).alias("budget")), """SELECT id, least(4000, CASE WHEN id * 7 < 2 THEN 0 WHEN id * 7 <= 50 THEN 1200 WHEN id * 7 <= 200 THEN 1200 + (id * 7 - 50) * 6
    WHEN id * 7 <= 1000 THEN floor(2100 + (id * 7 - 200) * 1.5::DOUBLE) ELSE floor(3300 + (id * 7 - 1000) * 0.35::DOUBLE) END)::BIGINT AS budget FROM concepts""")
query("arr_root_budget", lambda c: c.concepts.select("id", roles.root_budget(F.col("id") * 7).alias("budget")), """WITH b AS (SELECT id, least(4000, CASE WHEN id * 7 < 2 THEN 0 WHEN id * 7 <= 50 THEN 1200 WHEN id * 7 <= 200 THEN 1200 + (id * 7 - 50) * 6
    WHEN id * 7 <= 1000 THEN floor(2100 + (id * 7 - 200) * 1.5::DOUBLE) ELSE floor(3300 + (id * 7 - 1000) * 0.35::DOUBLE) END)::BIGINT AS f
    FROM concepts) SELECT id, CASE WHEN f <= 0 THEN 0 ELSE greatest(1200, least(2500, floor(f * 0.55::DOUBLE)::BIGINT)) END::BIGINT AS budget FROM b""")
query("arr_decay", lambda c: c.concepts.select("id",
    roles.decayed(F.lit(0.5), F.element_at(F.array(F.lit("source_changed"), F.lit("neighbor_enriched"), F.lit("other")),
    (F.col("id") % 3 + 1).cast("int"))).alias("score")),
    "SELECT id, CASE id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.475::DOUBLE ELSE 0.5::DOUBLE END AS score FROM concepts")
REPLIES = """CASE event_id % 6 WHEN 0 THEN concat('{"results": [', props, ', ', props, ']}') WHEN 1 THEN concat('<think>hm</think>[', props, ', ', props, ']') WHEN 2 THEN concat(props, chr(10), props)
    WHEN 3 THEN concat('Here they are: ', props, ' and ', props, ' done') WHEN 4 THEN concat('{"results": [', props, ', {"k": 1, "x": "bro') ELSE concat('```json', chr(10), '[', props, ']', chr(10), '```') END"""
query(
    "json_batch_parse",
    lambda c: c.events.select("event_id", F.posexplode(replies.reply_items(F.expr(REPLIES))).alias("i", "item"))
        .select("event_id", "i", F.get_json_object("item", "$.k").cast("long").alias("k")),
    """SELECT event_id, unnest(CASE WHEN event_id % 6 >= 4 THEN [0] ELSE [0, 1] END)::INT AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
SARIF = "array<struct<ruleId:string,level:string,locations:array<struct<uri:string,line:int>>>>"
sarif = lambda c: c.items.select("id",
    F.to_json(F.array(F.struct(F.col("category").alias("ruleId"), F.lit("error").alias("level"),
    F.array(F.struct(F.concat(F.lit("file:///"), "file_path").alias("uri"), F.lit(3).alias("line"))).alias("locations")))).alias("results"))
query("json_sarif_simple", lambda c: content.sarif_findings(sarif(c)), "SELECT id, category AS rule, 'error' AS level, file_path, 3 AS line FROM items")
query(
    "json_sarif_enrich",
    lambda c: content.enriched_findings(content.sarif_findings(sarif(c)),
        c.part_paths.select(F.concat(F.lit("part/"), "p_partkey", F.lit(".py")).alias("file_path"), F.col("p_brand").alias("module"),
        F.col("p_size").alias("degree"))),
    """SELECT i.id, i.category AS rule, i.file_path, p_brand AS module, coalesce(p_size, 0)::INT AS degree,
    CASE WHEN coalesce(p_size, 0) >= 20 THEN 'critical' WHEN coalesce(p_size, 0) >= 10 THEN 'high' ELSE 'normal' END AS risk
    FROM items i LEFT JOIN part_paths ON i.file_path = 'part/' || p_partkey::VARCHAR || '.py'""",
)
query("scan_sarif", lambda c: content.sarif_findings(sarif(c)).groupBy("rule").agg(F.count("*").alias("n")),
    "SELECT category AS rule, count(*) AS n FROM items GROUP BY 1")
PRICES = [("model0", 2.5, 10.0), ("model1", 0.15, 0.6), ("model2", 3.0, 15.0)]
query(
    "num_cost",
    lambda c: c.usage.join(F.broadcast(c.spark.createDataFrame(PRICES, "model string, input double, output double")), "model", "left")
    .select("id", F.round(F.col("prompt_tokens") / 1e6 * F.coalesce("input", F.lit(1.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("output", F.lit(2.0)),
        8).alias("cost")),
    """SELECT id, round(prompt_tokens / 1000000.0::DOUBLE * CASE model WHEN 'model0' THEN 2.5::DOUBLE WHEN 'model1' THEN 0.15::DOUBLE WHEN 'model2' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END
    + completion_tokens / 1000000.0::DOUBLE * CASE model WHEN 'model0' THEN 10.0::DOUBLE WHEN 'model1' THEN 0.6::DOUBLE WHEN 'model2' THEN 15.0::DOUBLE ELSE 2.0::DOUBLE END, 8) AS cost FROM usage""",
)
query("date_month_start", lambda c: c.usage.select("id", F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month")),
    "SELECT id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month FROM usage")
query("date_heatmap", lambda c: c.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).selectExpr("cast(day as string) AS day", "n", """CASE WHEN n = 0 THEN ' ' WHEN n * 4 <= max(n) OVER () THEN '.' WHEN n * 2 <= max(n) OVER () THEN '-' WHEN n * 4 <= 3 * max(n) OVER () THEN '+'
    ELSE '#' END AS glyph"""), """SELECT day::VARCHAR AS day, n, CASE WHEN n = 0 THEN ' ' WHEN n * 4 <= max(n) OVER () THEN '.' WHEN n * 2 <= max(n) OVER () THEN '-'
    WHEN n * 4 <= 3 * max(n) OVER () THEN '+' ELSE '#' END AS glyph FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)""")
