"""Nodes, edges and levels of detail of files in languages whose blocks are in braces.

A row's text is read once, by a helper of three small steps: ``masked`` blanks out comments and strings by the language's table (nested
comments, raw strings, templates with code inside), ``statements`` cuts what is left at braces and ends of statements, and ``declared`` keeps a
stack of scopes. All else is Spark's: ids, edges from calls to the definitions they mean (joins by name, in the file first, then by what is
unique in the language), and levels of detail, which are arrays of lines without the spans that a level hides.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import parts


class Language(NamedTuple):
    """What is skipped whole (comments, plain strings), which comments nest, which strings hold code, and how declarations and imports are written."""

    skip: str
    declared: str  # groups kind, name, and where the language has them vis, owner, type, function, method, impl (a scope that is no symbol)
    imported: str
    nested: bool = False
    template: tuple[str, str, str] | None = None  # the string's delimiter, what opens code in it, the brackets around that code
    lines: bool = False  # a line's end ends a statement
    headed: str | None = None  # functions are a type, a name and brackets, without a word of their own; this word shows or hides them


# The lexical rules and declaring words of each language.
CHAR = r"'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]*\}|.)|[^'\\\n])'"
QUOTED = r'"(?:\\.|[^"\\\n])*"'
BLOCK = r"/\*(?:.|\n)*?(?:\*/|\Z)"
ROUND = r"\((?:[^()\n]|\([^()\n]*\))*\)"
LANGUAGES = {
    "rust": Language(r'//[^\n]*|b?r(?P<hash>#*)"(?:.|\n)*?"(?P=hash)|b?"(?:\\(?:.|\n)|[^"\\])*"|' + CHAR,
        r"(?P<vis>pub\b(?:[ \t]*\([^)\n]*\))?[ \t]+)?(?:(?:async|unsafe|const|default|extern)[ \t]+)*\b(?P<kind>fn|struct|enum|trait|mod|union|type)[ \t]+(?P<name>\w+)"
        r"|\bimpl\b(?:[ \t]*<[^{;\n]*?>)?[ \t]+(?:[\w:<>&', ]+?[ \t]for[ \t]+)?(?:\w+::)*(?P<impl>\w+)", r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)", nested=True),
    "go": Language("//[^\n]*|" + BLOCK + "|" + QUOTED + "|`[^`]*`|" + CHAR,
        r"^[ \t]*func[ \t]+(?:\([ \t]*(?:\w+[ \t]+)?\*?(?P<owner>\w+)[^)]*\)[ \t]*)?(?P<name>\w+)|^[ \t]*type[ \t]+(?P<type>\w+)(?:\[[^\]]*\])?[ \t]+(?P<kind>struct|interface)?",
        r'^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$', lines=True),
    "typescript": Language("//[^\n]*|" + BLOCK + "|" + QUOTED + r"|'(?:\\.|[^'\\\n])*'|(?<=[(,=:\[!&|?{;+*%<>~^])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*",
        r"(?P<vis>export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?\b(?P<kind>function|class|interface|enum|namespace)\b\*?[ \t]+(?P<name>[\w$]+)"
        r"|^[ \t]*(?P<vis2>export[ \t]+)?(?:const|let|var)[ \t]+(?P<function>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:" + ROUND + r"|[\w$]+)[^=\n]*=>"
        r"|^[ \t]*(?:(?:public|private|protected|static|async|get|set|override)[ \t]+)*(?P<method>[\w$]+)[ \t]*(?:<[^>\n]*>)?" + ROUND,
        r"""^[ \t]*(?:import|export)\b[^'"\n;]*['"]([^'"\n]+)['"]|\brequire\([ \t]*['"]([^'"\n]+)['"]""", template=("`", "${", "{}"), lines=True),
    "java": Language("//[^\n]*|" + BLOCK + r'|"""(?:\\(?:.|\n)|[^\\])*?"""|' + QUOTED + "|" + CHAR,
        r"(?P<vis>public[ \t]+)?(?:(?:private|protected|static|final|abstract|sealed)[ \t]+)*\b(?P<kind>class|interface|enum|record)[ \t]+(?P<name>\w+)",
        r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)", headed="public"),
    "c": Language(r"^[ \t]*#(?:\\\n|[^\n])*|//[^\n]*|" + BLOCK + "|" + QUOTED + "|" + CHAR,
        r"\b(?P<kind>struct|enum|union|class|namespace)[ \t]+(?P<name>\w+)[ \t]*(?=\Z|\n|:[^:])",
        r'^[ \t]*#[ \t]*include[ \t]+[<"]([^>"\n]+)[>"]', headed="static"),
    "swift": Language(r'//[^\n]*|#"(?:.|\n)*?"#|"""(?:\\(?:.|\n)|[^\\])*?"""',
        r"(?P<vis>(?:public|open)[ \t]+)?(?:(?:private|internal|fileprivate|static|final|override|mutating)[ \t]+)*\b(?P<kind>func|class|struct|enum|protocol|actor)[ \t]+(?P<name>\w+)"
        r"|\bextension[ \t]+(?P<impl>\w+)|^[ \t]*(?:(?:public|override|required|convenience)[ \t]+)*(?P<method>init|deinit)\b",
        r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+([\w.]+)", nested=True, template=('"', "\\(", "()"), lines=True),
}
KINDS = {"fn": "function", "func": "function", "mod": "module", "namespace": "module"}
#: Owners inside which a function is a method.
TYPES = {"struct", "class", "interface", "trait", "enum", "impl", "protocol", "actor", "record", "union"}
CONTROL = {
    "if", "for", "while", "switch", "match", "loop", "do", "try", "catch", "else", "return", "guard", "case", "unsafe", "with", "function",
    "finally", "synchronized", "new", "throw", "await", "sizeof",
}
CALL = re.compile(r"(?<![\w.:>])([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)!?\(")
EDGE = re.compile(r"[{};()\[\]\n]")


def masked(text: str, lang: Language) -> str:
    """The text without comments and strings; line ends kept."""
    return both_masked(text, lang)[0]


def both_masked(text: str, lang: Language) -> tuple[str, str]:
    """The text without comments and strings, and that without comments alone, from one reading; line ends kept."""
    quote, opens, pair = lang.template or ("\0", "\0", "\0\0")
    start = "|".join(["(?P<nest>/\\*)"] * lang.nested + ["(?P<text>" + re.escape(quote) + ")"] * bool(lang.template))
    special = re.compile("(?m)" + "|".join(["(?P<skip>" + lang.skip + ")", *([start] if start else []), "(?P<code>[" + re.escape(pair) + "])"]))
    inside = re.compile(r"\\[^(]|" + re.escape(opens) + "|" + re.escape(quote))
    out, bare, at, open_, in_text = [], [], 0, [], False

    def add(code: str, with_strings: str) -> None:
        out.append(code)
        bare.append(with_strings)

    while at < len(text):
        if in_text:  # to the string's end, or to code in it
            m = inside.search(text, at)
            end = m.end() if m else len(text)
            add("\n" * text.count("\n", at, end), text[at:end])
            at = end
            if m and m[0] == opens:
                open_.append(0)
                in_text = False
            elif not m or m[0] == quote:
                in_text = False
            continue
        m = special.search(text, at)
        if not m:
            add(text[at:], text[at:])
            break
        add(text[at : m.start()], text[at : m.start()])
        at = m.end()
        if m["skip"] is not None:
            gap = " " + "\n" * m[0].count("\n")
            add(gap, gap if m[0].lstrip()[:2] in ("//", "/*") else m[0])
        elif lang.nested and m["nest"]:
            depth = 1
            for n in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
                if not depth:
                    break
            at = at if not depth else len(text)
            add("\n" * text.count("\n", m.start(), at), "\n" * text.count("\n", m.start(), at))
        elif lang.template and m["text"]:
            in_text = True
        elif open_ and m[0] == pair[1] and not open_[-1]:  # the code in a string ends
            open_.pop()
            in_text = True
        else:
            if open_:
                open_[-1] += 1 if m[0] == pair[0] else -1
            add(m[0], m[0])
    return "".join(out), "".join(bare)


def statements(code: str, lang: Language) -> Iterator[tuple[str, int, int, tuple[int, int]]]:
    """(mark, start, end, its last round brackets) of each stretch of code up to a brace, or to the end of a statement outside of brackets."""
    start, blank, depth, round_ = 0, 0, [0], (0, 0)  # blank: the stretch is known to be so up to there, and isn't read again at each line's end
    for m in EDGE.finditer(code):
        c, at = m[0], m.start()
        if c in "([":
            round_ = (at, 0) if c == "(" and not depth[-1] else round_
            depth[-1] += 1
        elif c in ")]":
            depth[-1] = max(0, depth[-1] - 1)
            round_ = (round_[0], at) if c == ")" and not depth[-1] else round_
        elif c in "{}" or depth[-1] == 0 and (c == ";" or c == "\n" and lang.lines and code[blank:at].strip()):
            yield c, start, at, round_
            start, blank, round_ = at + 1, at + 1, (0, 0)
            if c == "{":
                depth.append(0)
            elif c == "}" and len(depth) > 1:
                depth.pop()
        elif depth[-1] == 0 and lang.lines:
            blank = at
    yield ";", start, len(code), round_


class Symbol(NamedTuple):
    kind: str
    name: str
    public: bool
    owner: str | None
    at: int  # where it begins, and where its name and brackets end
    end: int


def worded(head: str, mark: str, scope: str, pattern: re.Pattern) -> Symbol | None:
    """The last declaration by a word of its own in a stretch of code."""
    found = [m for m in pattern.finditer(head) if m.lastgroup]
    if not found:
        return None
    m, g = found[-1], {k: v for k, v in found[-1].groupdict().items() if v is not None}
    at = m.start() + len(m[0]) - len(m[0].lstrip())
    if "impl" in g:
        return Symbol("impl", g["impl"], False, None, at, m.end())
    if mark == "{" and any(w[0] in CONTROL for x in head[m.end() :].split("\n")[1:] if (w := re.findall(r"\w+", x)[:1])):
        return None  # the block is that of a statement behind it
    short = g.get("name") or g.get("type") or g.get("function") or g["method"]
    if short in CONTROL or "method" in g and (scope not in TYPES or mark not in "{;"):
        return None
    sort = KINDS.get(g.get("kind", ""), g.get("kind")) or ("type" if "type" in g else "function")
    sort = "method" if sort == "function" and (scope in TYPES or "owner" in g) else sort
    shown = short[:1].isupper() if "type" in pattern.groupindex else True
    public = "vis" in g or "vis2" in g if "vis" in pattern.groupindex else shown
    return Symbol(sort, short, public, g.get("owner"), at, m.end())


def headed(head: str, mark: str, scope: str, brackets: tuple[int, int], lang: Language) -> Symbol | None:
    """A function written as a type, a name and brackets, where such a thing can be declared."""
    before = head[: brackets[0]].rstrip()
    m = re.search(r"(?:(\w+)::)?(~?\w+)\Z", before[-200:])
    static = lang.headed == "static"
    inside = scope in TYPES or (static and scope in ("file", "module"))
    if not m or brackets[1] <= brackets[0] or not inside or m[2] in CONTROL or mark not in ("{" if static else "{;"):
        return None
    lead = re.sub(r"@\w+(?:\([^()]*\))?", "", before[: len(before) - len(m[0])])  # annotations
    if not re.fullmatch(r"[\w<>\[\],.?&*:~@()\s]*", lead) or not re.fullmatch(r"[\w\s,.]*", head[brackets[1] + 1 :]) or (mark == ";" and not lead.strip()):
        return None
    shown = bool(re.search(rf"\b{lang.headed}\b", lead)) != static
    return Symbol("method" if scope in TYPES or m[1] else "function", m[2], shown, m[1], len(head) - len(head.lstrip()), brackets[0] + 1)


def declared(text: str | None, lang: Language) -> list[list]:
    """Rows (part, kind, name, target, start_line, end_line, body_line, public) of a file, in order of their lines."""
    code, bare = both_masked(text or "", lang)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    pattern, rows = re.compile("(?m)" + lang.declared), []
    for m in re.finditer("(?m)" + lang.imported, bare):
        rows.append(["edge", "imports", "", m[m.lastindex], bare.count("\n", 0, m.start(m.lastindex)) + 1, None, None, None])
    scopes, waiting = [["file", "", None]], None  # a scope: kind of owner, its name, its row; waiting: a declaration whose block may open on the next line
    for mark, start, end, brackets in statements(code, lang):
        head, (kind, name, _) = code[start:end], scopes[-1]
        some = bool(head.strip())
        own = worded(head, mark, kind, pattern) if some else None
        if some and not own and lang.headed:
            own = headed(head, mark, kind, (brackets[0] - start, brackets[1] - start), lang)
        if own and own.kind == "impl":
            waiting = ["impl", own.name, None]
        elif own:
            prefix = own.owner or name
            full, at = f"{prefix}.{own.name}" if prefix else own.name, line(start + own.at)
            rows.append(["node", own.kind, full, None, at, line(end), None, own.public])
            waiting = [own.kind, full, rows[-1]]
            rows.append(["edge", "contains", name, full, at, None, None, None])
        for c in CALL.finditer(head) if some else ():
            if re.split(r"\.|::|->", c[1])[0] not in CONTROL and not (own and own.at <= c.start() < own.end):
                rows.append(["edge", "calls", waiting[1] if own else name, c[1], line(start + c.start()), None, None, None])
        if mark == "{":
            scopes.append(waiting if own or (waiting and not head.strip()) else ["block", name, None])
            if scopes[-1][2]:
                scopes[-1][2][6] = line(end)
        elif mark == "}" and len(scopes) > 1:
            shut = scopes.pop()
            if shut[2]:
                shut[2][5] = line(end)
        waiting = waiting if mark == "\n" and own else None
    return sorted(rows, key=lambda r: r[4])


GRAPH = "path string, language string, part string, kind string, name string, target string, start_line int, end_line int, body_line int, public boolean"


def graph(files: DataFrame) -> DataFrame:
    """Nodes and edges of files (path, language, text); an edge's name is its source, empty for the file itself. Other languages have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int32()] * 3 + [pa.bool_()]
        for b in parts(batches, text=2):
            rows = [(path, lang, *r) for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in declared(text, LANGUAGES[lang])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in GRAPH.split(", ")])

    return files.where(F.col("language").isin(list(LANGUAGES))).select("path", "language", "text").mapInArrow(run, GRAPH)


def identified(rows: DataFrame) -> DataFrame:
    """Nodes with ids that stay while their line does."""
    return rows.where("part = 'node'").withColumn("id", F.concat(F.lit("sym:"), "name", F.lit("@"), "path", F.lit(":"), "start_line"))


def calls(rows: DataFrame) -> DataFrame:
    """(path, name, target, start_line, definition, reach) of each call: the one symbol of that last name in the file, or else the one of all files of the language; null where there is none or more."""
    last = F.regexp_extract("target", r"(\w+)$", 1)
    short = identified(rows).withColumn("short", F.regexp_extract("name", r"(\w+)$", 1))
    one = F.when(F.count("*") == 1, F.first("id"))
    near = short.groupBy("path", "short").agg(F.count("*").alias("k"), one.alias("near"))
    far = short.groupBy("language", "short").agg(one.alias("far")).where("far IS NOT NULL")
    asked = rows.where("kind = 'calls'").withColumn("short", last)
    met = asked.join(near, ["path", "short"], "left").join(far, ["language", "short"], "left")
    found = F.when(F.col("k").isNotNull(), F.col("near")).otherwise(F.col("far"))
    return met.select("path", "name", "target", "start_line", found.alias("definition"),
        F.when(found.isNull(), "none").when(F.col("k").isNotNull(), "file").otherwise("language").alias("reach"))


def details(files: DataFrame, rows: DataFrame, level: int) -> DataFrame:
    """(path, skeleton) of files at a level of detail: 2 without the bodies of functions, 3 types alone, without bodies of their methods, 4 imports and first lines of symbols; files without symbols whole."""
    function, type_ = F.col("kind").isin("function", "method"), F.col("kind").isin(sorted(TYPES | {"module", "type"}))
    body = F.struct(F.col("body_line").alias("a"), F.col("end_line").alias("b"))
    whole = F.struct(F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    spans = rows.groupBy("path").agg(F.collect_list(F.when((F.col("part") == "node") & function & (F.col("end_line") > F.col("body_line") + 1), body)).alias("bodies"),
        F.collect_list(F.when((F.col("part") == "node") & (F.col("kind") == "function"), whole)).alias("functions"),
        F.collect_set(F.when((F.col("part") == "node") | (F.col("kind") == "imports"), F.col("start_line"))).alias("heads"),
        F.sum(F.when((F.col("part") == "node") & (type_ | function), 1).otherwise(0)).alias("symbols"))
    lines = F.split("text", "\n")
    inner = F.flatten(F.transform("bodies", lambda s: F.sequence(s["a"] + 1, s["b"] - 1)))
    cut = F.flatten(F.transform("functions", lambda s: F.sequence(s["a"], s["b"])))
    every = F.sequence(F.lit(1), F.size(lines))
    kept = {2: F.array_except(every, inner), 3: F.array_except(every, F.concat(inner, cut)), 4: F.sort_array("heads")}[level]
    text = F.array_join(F.transform(kept, lambda i: F.rtrim(F.element_at(lines, i)) if level == 4 else F.element_at(lines, i)), "\n")
    both = files.select("path", "text").join(spans, "path", "left")
    return both.select("path", F.when(F.coalesce("symbols", F.lit(0)) > 0, text).otherwise(F.col("text")).alias("skeleton"))
