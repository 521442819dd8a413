"""Registered parsers of brace languages, their levels of detail, and the graph of markdown documents.

Each file gets a piece of code with its id in the names (written once, here), its own text behind it as comments. ROWS has the nodes and edges
of that piece as a reader would list them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import braces, markdown, parsing
from ..operators import joins as jo
from ..sources.scratch import kept
from .content_queries import MODULE_ROWS, modules
from .registry import query

#: Code by language; § stands for the file's id.
CODE = {
    "rust": """use std::fmt;
/* { nested /* } */ { */
pub struct S§ { x: u8 }
impl fmt::Debug for S§ {
    pub fn run(&self) -> u8 {
        let s = "}} {{"; let c = '{'; let r = r#"{ " }"#;
        helper§(s)
    }
}
fn helper§<'a>(v: &'a str) -> u8 { v.len() as u8 }
trait T§ { fn act(&self); }
""",
    "go": """package x
import "fmt"
// func no() {
type T§ struct { A int }
func (s *T§) Run(x int) string {
	y := `raw { " }`
	if x > 1 {
		return fmt.Sprint("}", y, '{')
	}
	return helper§(y)
}
func helper§(v string) string { return v }
""",
    "typescript": """import { a } from "./lib";
export class A§ extends B {
  private x = /[}{"]/g;
  run(v: string): string {
    if (v) { return `x ${go§(v + "}")} } {`; }
    return '{';
  }
}
export const go§ = (v: string) => {
  return v;
};
function plain§() { /* } */ }
""",
    "java": """package p;
import java.util.List;
public class A§ {
  private String s = "{";
  public String run(List<String> v) {
    for (String x : v) { helper§(x); }
    return \"\"\"
      } text { block\"\"\";
  }
  static void helper§(String x) { char c = '}'; }
}
interface I§ { void act(); }
""",
    "c": """#include <stdio.h>
#define OPEN {
struct s§ { int a; };
/* { */
static int helper§(const char *v) { return v[0] == '{'; }
int run§(struct s§ *p)
{
  if (helper§("}")) { printf("%d", p->a); }
  return 0;
}
""",
    "swift": """import UIKit
public struct S§ {
  var s = "{ \\(go("}")) }"
  func run(_ x: Int) -> String {
    return helper§("}")
  }
}
extension S§ { func more() {} }
func helper§(_ v: String) -> String { return v } /* { /* } */ */
""",
}
#: (part, kind, name, target, start_line, end_line, body_line, public, definition); a definition is the line of the symbol that a call means.
ROWS = {
    "rust": """('edge','imports','','std::fmt',1,NULL,NULL,NULL,NULL), ('node','struct','S§',NULL,3,3,3,true,NULL), ('edge','contains','','S§',3,NULL,NULL,NULL,NULL),
        ('node','method','S§.run',NULL,5,8,5,true,NULL), ('edge','contains','S§','S§.run',5,NULL,NULL,NULL,NULL), ('edge','calls','S§.run','helper§',7,NULL,NULL,NULL,'helper§:10'),
        ('node','function','helper§',NULL,10,10,10,false,NULL), ('edge','contains','','helper§',10,NULL,NULL,NULL,NULL), ('edge','calls','helper§','v.len',10,NULL,NULL,NULL,NULL),
        ('node','trait','T§',NULL,11,11,11,false,NULL), ('edge','contains','','T§',11,NULL,NULL,NULL,NULL), ('node','method','T§.act',NULL,11,11,NULL,false,NULL),
        ('edge','contains','T§','T§.act',11,NULL,NULL,NULL,NULL)""",
    "go": """('edge','imports','','fmt',2,NULL,NULL,NULL,NULL), ('node','struct','T§',NULL,4,4,4,true,NULL), ('edge','contains','','T§',4,NULL,NULL,NULL,NULL),
        ('node','method','T§.Run',NULL,5,11,5,true,NULL), ('edge','contains','','T§.Run',5,NULL,NULL,NULL,NULL), ('edge','calls','T§.Run','fmt.Sprint',8,NULL,NULL,NULL,NULL),
        ('edge','calls','T§.Run','helper§',10,NULL,NULL,NULL,'helper§:12'), ('node','function','helper§',NULL,12,12,12,false,NULL), ('edge','contains','','helper§',12,NULL,NULL,NULL,NULL)""",
    "typescript": """('edge','imports','','./lib',1,NULL,NULL,NULL,NULL), ('node','class','A§',NULL,2,8,2,true,NULL), ('edge','contains','','A§',2,NULL,NULL,NULL,NULL),
        ('node','method','A§.run',NULL,4,7,4,false,NULL), ('edge','contains','A§','A§.run',4,NULL,NULL,NULL,NULL), ('edge','calls','A§.run','go§',5,NULL,NULL,NULL,'go§:9'),
        ('node','function','go§',NULL,9,11,9,true,NULL), ('edge','contains','','go§',9,NULL,NULL,NULL,NULL), ('node','function','plain§',NULL,12,12,12,false,NULL),
        ('edge','contains','','plain§',12,NULL,NULL,NULL,NULL)""",
    "java": """('edge','imports','','java.util.List',2,NULL,NULL,NULL,NULL), ('node','class','A§',NULL,3,11,3,true,NULL), ('edge','contains','','A§',3,NULL,NULL,NULL,NULL),
        ('node','method','A§.run',NULL,5,9,5,true,NULL), ('edge','contains','A§','A§.run',5,NULL,NULL,NULL,NULL), ('edge','calls','A§.run','helper§',6,NULL,NULL,NULL,'A§.helper§:10'),
        ('node','method','A§.helper§',NULL,10,10,10,false,NULL), ('edge','contains','A§','A§.helper§',10,NULL,NULL,NULL,NULL), ('node','interface','I§',NULL,12,12,12,false,NULL),
        ('edge','contains','','I§',12,NULL,NULL,NULL,NULL), ('node','method','I§.act',NULL,12,12,NULL,false,NULL), ('edge','contains','I§','I§.act',12,NULL,NULL,NULL,NULL)""",
    "c": """('edge','imports','','stdio.h',1,NULL,NULL,NULL,NULL), ('node','struct','s§',NULL,3,3,3,true,NULL), ('edge','contains','','s§',3,NULL,NULL,NULL,NULL),
        ('node','function','helper§',NULL,5,5,5,false,NULL), ('edge','contains','','helper§',5,NULL,NULL,NULL,NULL), ('node','function','run§',NULL,6,10,7,true,NULL),
        ('edge','contains','','run§',6,NULL,NULL,NULL,NULL), ('edge','calls','run§','helper§',8,NULL,NULL,NULL,'helper§:5'), ('edge','calls','run§','printf',8,NULL,NULL,NULL,NULL)""",
    "swift": """('edge','imports','','UIKit',1,NULL,NULL,NULL,NULL), ('node','struct','S§',NULL,2,7,2,true,NULL), ('edge','contains','','S§',2,NULL,NULL,NULL,NULL),
        ('edge','calls','S§','go',3,NULL,NULL,NULL,NULL), ('node','method','S§.run',NULL,4,6,4,false,NULL), ('edge','contains','S§','S§.run',4,NULL,NULL,NULL,NULL),
        ('edge','calls','S§.run','helper§',5,NULL,NULL,NULL,'helper§:9'), ('node','method','S§.more',NULL,8,8,8,false,NULL), ('edge','contains','S§','S§.more',8,NULL,NULL,NULL,NULL),
        ('node','function','helper§',NULL,9,9,9,false,NULL), ('edge','contains','','helper§',9,NULL,NULL,NULL,NULL)""",
}
COLUMNS = "part, kind, name, target, start_line, end_line, body_line, public, definition"
ORDER = list(CODE)


def filled(code: str) -> Column:
    """A piece of code with the file's id, and the file's own text behind it as comments."""
    parts = code.split("§")
    own = [x for p in parts for x in (F.lit(p), F.col("doc_id").cast("string"))][:-1]
    return F.concat(*own, F.lit("// "), F.regexp_replace("text", "\n", "\n// "))


def coded(c, languages: list[str]) -> DataFrame:
    """All files, each with code of one of the languages by turns."""
    turn = F.col("doc_id") % len(languages)
    pick = reduce(lambda out, i: out.when(turn == i, filled(CODE[languages[i]])), range(1, len(languages)), F.when(turn == 0, filled(CODE[languages[0]])))
    named = F.element_at(F.array(*map(F.lit, languages)), (turn + 1).cast("int"))
    return c.files.select("doc_id", "path", named.alias("language"), pick.alias("text"))


def rows_sql(languages: list[str], columns: str = "path, language, part, kind, name, target, start_line, end_line, body_line, public") -> str:
    """The rows of all files' code, one query a language."""
    one = [f"""SELECT {columns} FROM (SELECT *, '{lang}' AS language FROM files WHERE doc_id % {len(languages)} = {i}),
        LATERAL (SELECT * FROM (VALUES {ROWS[lang].replace("§", "' || doc_id || '")}) v({COLUMNS}))""" for i, lang in enumerate(languages)]
    return " UNION ALL ".join(one)


query("gen_parse_rust", lambda c: braces.graph(coded(c, ["rust"])), rows_sql(["rust"]))
query("gen_parse_swift", lambda c: braces.graph(coded(c, ["swift"])), rows_sql(["swift"]))
query("gen_parse_generic", lambda c: braces.graph(coded(c, ["go", "typescript", "java", "c"])), rows_sql(["go", "typescript", "java", "c"]))
CALLED = "path, name, target, start_line, CASE WHEN definition IS NOT NULL THEN 'sym:' || replace(definition, ':', '@' || path || ':') END AS definition"


def parallel(c) -> DataFrame:
    """Nodes of Python and six other languages with their ids, and the calls of those with what they mean."""
    rows = kept(braces.graph(coded(c, ORDER)), "parsed")  # read four times below, parsed once
    python = parsing.python_graph(modules(c).where("path LIKE '%.py'")).withColumn("language", F.lit("python"))
    nodes = braces.identified(rows.select("path", "language", "part", "kind", "name", "start_line").unionByName(python.select("path", "language", "part", "kind",
        "name", "start_line")))
    calls = braces.calls(rows)
    return nodes.select("path", "language", "kind", "id", F.lit(None).cast("string").alias("definition")).unionByName(calls.select("path",
        F.lit(None).cast("string").alias("language"), F.lit("calls").alias("kind"), F.concat("name", F.lit(">"), "target", F.lit(":"), "start_line").alias("id"), "definition"))


query(
    "gen_parse_parallel",
    parallel,
    f"""WITH r AS ({rows_sql(ORDER, "path, language, part, kind, name, target, start_line, definition")})
    SELECT path, language, kind, 'sym:' || name || '@' || path || ':' || start_line AS id, NULL::VARCHAR AS definition FROM r WHERE part = 'node'
    UNION ALL SELECT path, 'python', kind, 'sym:' || name || '@' || path || ':' || start_line, NULL FROM files, LATERAL (SELECT * FROM {MODULE_ROWS}) WHERE path LIKE '%.py' AND part = 'node'
    UNION ALL SELECT path, NULL, 'calls', name || '>' || target || ':' || start_line, CASE WHEN definition IS NOT NULL THEN 'sym:' || replace(definition, ':', '@' || path || ':') END FROM r WHERE kind = 'calls'""",
)


def shown(lang: str, lines: list[int]) -> str:
    """SQL of the code's lines of those numbers."""
    all_lines = CODE[lang].split("\n")
    return " || chr(10) || ".join("'" + all_lines[i - 1].replace("'", "''").replace("§", "' || doc_id || '") + "'" for i in lines)


def levels(c) -> DataFrame:
    files = coded(c, ["rust", "go"])
    rows = kept(braces.graph(files), "parsed")
    one = [braces.details(files, rows, k).select("path", F.lit(k).alias("level"), F.md5("skeleton").alias("digest")) for k in (2, 3, 4)]
    return one[0].unionByName(one[1]).unionByName(one[2])


TAILED = " || chr(10) || '// ' || replace(text, chr(10), chr(10) || '// ')"
query(
    "lod_rust",
    levels,
    " UNION ALL ".join(
        f"SELECT path, {level} AS level, md5({shown(lang, lines)}{'' if level == 4 else TAILED}) AS digest FROM files WHERE doc_id % 2 = {i}"
        for i, (lang, by_level) in enumerate({"rust": {2: [1, 2, 3, 4, 5, 8, 9, 10, 11], 3: [1, 2, 3, 4, 5, 8, 9, 11], 4: [1, 3, 5, 10, 11]},
            "go": {2: [1, 2, 3, 4, 5, 11, 12], 3: [1, 2, 3, 4, 5, 11], 4: [2, 4, 5, 12]}}.items())
        for level, lines in by_level.items()),
)


def notes(c) -> DataFrame:
    """Every document as a guide with sections, references and links of its own before its text."""
    head = ["See `src/core/a.py`, `1.5`, `x y` and [the [next]](../api/b.md)\n# Guide ", "\n## Part one ✅ ⏳\n[self](./doc_", ".md) [web](http://a.b/c.md) `util.rs`\n### Deep\n**Status**: done ** x\n",
        "# Other\n#### Far\n`part/x.py` ```a.py```\n## Part two\n"]
    n = F.col("doc_id").cast("string")
    return c.files.select("path", F.concat(F.lit(head[0]), n, F.lit(head[1]), n, F.lit(head[2]), F.lit(head[3]), "text").alias("text"))


#: Lines of the same documents, and what each holds, by DuckDB's own functions.
NOTES_SQL = r"""
n AS (SELECT path, 'See `src/core/a.py`, `1.5`, `x y` and [the [next]](../api/b.md)' || chr(10) || '# Guide ' || doc_id || chr(10) || '## Part one ✅ ⏳' || chr(10) || '[self](./doc_' || doc_id
      || '.md) [web](http://a.b/c.md) `util.rs`' || chr(10) || '### Deep' || chr(10) || '**Status**: done ** x' || chr(10) || '# Other' || chr(10) || '#### Far' || chr(10) || '`part/x.py` ```a.py```' || chr(10)
      || '## Part two' || chr(10) || text AS text FROM files),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM n),
h AS (SELECT path, line, length(regexp_extract(x, '^\s*(#{1,6}) +(.*?\S)\s*$', 1))::INT AS depth, regexp_extract(x, '^\s*(#{1,6}) +(.*?\S)\s*$', 2) AS name FROM l WHERE regexp_matches(x, '^\s*(#{1,6}) +(.*?\S)\s*$')),
k AS (SELECT *, 'sec:' || lower(regexp_replace(name, '[^\p{L}\p{N}_-]', '_', 'g')) || '@' || path || ':' || line AS id FROM h),
t AS (SELECT path, line, 'references' AS kind, NULL AS text, unnest(regexp_extract_all(split_part(x, '```', 1), '`([^`]*)`', 1)) AS target FROM l
      UNION ALL SELECT path, line, 'links_to', unnest(regexp_extract_all(x, '\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^)]*)\)', 1)), unnest(regexp_extract_all(x, '\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^)]*)\)', 2)) FROM l),
v AS (SELECT path, line, kind, text, regexp_replace(trim(target), '^\./', '') AS target, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM t
      WHERE length(trim(target)) <= 200 AND regexp_matches(trim(target), '\.[\p{L}\p{N}]{1,10}$') AND NOT regexp_matches(trim(target), '^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$')
      AND NOT (trim(target) LIKE '% %' AND NOT regexp_matches(trim(target), '[/\\]')) AND NOT (kind = 'links_to' AND starts_with(trim(target), 'http'))),
r AS (SELECT path, line, kind, text, CASE WHEN starts_with(target, '../') THEN regexp_replace(dir, '/?[^/]*$', '') || '/' || substr(target, 4) WHEN target LIKE '%/%' THEN target ELSE dir || '/' || target END AS target FROM v),
s AS (SELECT path, line, 'mark' AS kind, unnest(list_filter(['✅', '⏳', '❌', '⚠', '🚧', CASE WHEN trim(split_part(regexp_extract(x, '(?i)\*\*status\*\*[^:]*:(.*)$', 1), '**', 1)) <> ''
      THEN 'status:' || trim(split_part(regexp_extract(x, '(?i)\*\*status\*\*[^:]*:(.*)$', 1), '**', 1)) END], lambda m: m IS NOT NULL AND (contains(x, m) OR starts_with(m, 'status:')))) AS text FROM l),
i AS (SELECT m.*, max_by(k.id, k.line) AS section FROM (SELECT path, line, kind, text FROM r UNION ALL SELECT path, line, kind, text FROM s) m JOIN k ON k.path = m.path AND k.line <= m.line GROUP BY ALL)
"""
query(
    "gen_parse_md",
    lambda c: markdown.sections(notes(c)).withColumn("marks", F.array_join("marks", ",")),
    f"""WITH {NOTES_SQL} SELECT a.path, a.id, a.name, a.depth, (SELECT max_by(b.id, b.line) FROM k b WHERE b.path = a.path AND b.line < a.line AND b.depth < a.depth) AS parent, a.line AS start_line,
    coalesce((SELECT min(b.line) - 1 FROM k b WHERE b.path = a.path AND b.line > a.line), (SELECT max(line) FROM l WHERE l.path = a.path))::INT AS end_line,
    coalesce((SELECT min(b.line) - 1 FROM k b WHERE b.path = a.path AND b.line > a.line AND b.depth <= a.depth), (SELECT max(line) FROM l WHERE l.path = a.path))::INT AS tree_end,
    (SELECT count(*) FROM r WHERE r.path = a.path AND (SELECT max_by(b.id, b.line) FROM k b WHERE b.path = r.path AND b.line <= r.line) = a.id AND kind = 'references') AS refs,
    (SELECT count(*) FROM r WHERE r.path = a.path AND (SELECT max_by(b.id, b.line) FROM k b WHERE b.path = r.path AND b.line <= r.line) = a.id AND kind = 'links_to') AS links,
    coalesce((SELECT string_agg(DISTINCT text, ',' ORDER BY text) FROM i WHERE i.section = a.id AND i.kind = 'mark'), '') AS marks FROM k a""",
)
query(
    "gen_md_edges",
    lambda c: markdown.edges(notes(c), c.files),
    f"""WITH {NOTES_SQL} SELECT 'contains' AS kind, 'file:' || a.path AS source, (SELECT max_by(b.id, b.line) FROM k b WHERE b.path = a.path AND b.line < a.line AND b.depth < a.depth) AS section, a.id AS target, a.line, NULL AS text, true AS known FROM k a
    UNION ALL SELECT kind, 'file:' || path, (SELECT max_by(b.id, b.line) FROM k b WHERE b.path = r.path AND b.line <= r.line), 'file:' || target, line, text, target IN (SELECT path FROM files) FROM r""",
)


def guides(c) -> DataFrame:
    """Documents that name files of modules in backticks, by their ids."""
    keys = F.array_distinct(F.array(*(F.col("doc_id") % n + 1 for n in (97, 53, 31))))
    used = c.files.select("path", F.explode(keys).alias("key")).join(c.part_paths.select(F.col("p_partkey").alias("key"), F.col("path").alias("used")), "key")
    lists = used.groupBy("path").agg(F.array_join(F.transform(F.collect_list("used"), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), " and ").alias("used"))
    return c.files.join(lists, "path").select("path", F.concat("text", F.lit("\nUses "), "used", F.lit(".\n")).alias("text"))


GUIDES_SQL = """d AS (SELECT DISTINCT f.path AS doc, p.path FROM (SELECT path, unnest([doc_id % 97 + 1, doc_id % 53 + 1, doc_id % 31 + 1]) AS key FROM files) f JOIN part_paths p ON p.p_partkey = key)"""
query(
    "join_doc_segment",
    lambda c: jo.documents_of_segments(markdown.mentions(guides(c), c.modules).withColumnRenamed("doc", "doc_id"), c.modules.withColumnRenamed("module", "segment")),
    f"""WITH {GUIDES_SQL} SELECT segment, doc_id, overlap FROM (SELECT module AS segment, doc AS doc_id, count(DISTINCT path) AS overlap, row_number() OVER (PARTITION BY module ORDER BY count(DISTINCT path) DESC, doc) AS r
    FROM d JOIN modules USING (path) GROUP BY 1, 2) WHERE r <= 5""",
)
query(
    "join_docs_module",
    lambda c: markdown.documents_of_module(markdown.mentions(guides(c), c.modules), c.modules.where("module LIKE '%2'")),
    f"WITH {GUIDES_SQL} SELECT doc, count(DISTINCT path) AS overlap FROM d WHERE path IN (SELECT path FROM modules WHERE module LIKE '%2') GROUP BY 1",
)
