"""Nodes and edges of source files, and levels of detail by the spans of their symbols.

Python is read by the standard library's parser, a file at a time inside mapInArrow; a file that doesn't parse gives no rows and keeps its
whole text at every level. Other languages go by declaration patterns in column functions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.batches import parts

GRAPH = "path string, part string, kind string, name string, target string, start_line int, end_line int"
DEFINED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def named(node: ast.AST) -> str:
    """The dotted name of a name or attribute, empty for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    return f"{head}.{node.attr}" if isinstance(node, ast.Attribute) and (head := named(node.value)) else ""


def python_rows(text: str | None) -> list[tuple]:
    """(part, kind, name, target, start_line, end_line): nodes for classes, functions and methods; edges contains, inherits, imports and calls."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []

    def walk(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, DEFINED):
                name = f"{owner}.{child.name}" if owner else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                rows.append(("node", kind, name, None, child.lineno, child.end_lineno))
                rows.append(("edge", "contains", owner, name, child.lineno, None))
                if isinstance(child, ast.ClassDef):
                    rows.extend(("edge", "inherits", name, base, child.lineno, None) for base in map(named, child.bases) if base)
                walk(child, name, isinstance(child, ast.ClassDef))
                continue
            if isinstance(child, ast.Import):
                rows.extend(("edge", "imports", owner, a.name, child.lineno, None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append(("edge", "imports", owner, "." * child.level + (child.module or ""), child.lineno, None))
            elif isinstance(child, ast.Call) and named(child.func):
                rows.append(("edge", "calls", owner, named(child.func), child.lineno, None))
            walk(child, owner, in_class)

    walk(tree, "", False)
    return rows


def python_graph(files: DataFrame) -> DataFrame:
    """Nodes and edges of Python files (path, text); an edge's name is its source, empty for the file itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in python_rows(t)]
            types = [pa.string()] * 5 + [pa.int32()] * 2
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["path", "part", "kind", "name", "target", "start_line", "end_line"])

    return files.select("path", "text").mapInArrow(run, GRAPH)


def normal_path(path: Column) -> Column:
    """Without . and .. steps."""
    empty = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
    steps = F.aggregate(F.split(path, "/"), empty, lambda done, x: F.when((x == ".") | (x == ""), done).when(x == "..", up(done))
        .otherwise(F.concat(done, F.array(x))))
    return F.array_join(steps, "/")


def script_imports(files: DataFrame, known: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(path, specifier, target) of the imports of scripts (path, text): relative ones and those under an alias get the known file they mean, packages none."""
    found = F.regexp_extract_all("text", F.lit(r"""(?:from\s+|import\s+|require\(\s*|import\(\s*)['"]([^'"\n]+)['"]"""), F.lit(1))
    rows = files.select("path", F.explode(F.array_distinct(found)).alias("specifier"))
    place = F.when(F.col("specifier").startswith("."), F.concat(paths.directory(F.col("path")), F.lit("/"), "specifier"))
    for alias, folder in aliases.items():
        place = place.when(F.col("specifier").startswith(alias), F.concat(F.lit(folder), F.substring("specifier", len(alias) + 1, 1 << 20)))
    rows = rows.withColumn("place", normal_path(place))
    tails = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
    tries = rows.where("place IS NOT NULL").select("path", "specifier",
        F.posexplode(F.array(*(F.concat("place", F.lit(t)) for t in tails))).alias("at", "target"))
    met = tries.join(known.select(F.col("path").alias("target")), "target").groupBy("path", "specifier").agg(F.min_by("target", "at").alias("target"))
    return rows.select("path", "specifier").join(met, ["path", "specifier"], "left")


def skeleton(text: str, lod: str) -> str:
    """Level 2: signatures and docstrings, bodies replaced by dots; 2.5: the same without module lines that are no imports; 3: classes only; 4: imports and first lines of symbols."""
    lines = text.splitlines()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text
    symbols = [n for n in ast.walk(tree) if isinstance(n, DEFINED)]
    if not symbols:
        return text
    imports = {i for i, line in enumerate(lines, 1) if re.match(r"\s*(?:import|from)\s", line)}
    if lod == "4":
        first = {n.lineno for n in symbols}
        return "\n".join(line.rstrip() for i, line in enumerate(lines, 1) if (i in imports or i in first) and line.strip())
    shown: dict[int, str | None] = {}
    classes = [n for n in symbols if isinstance(n, ast.ClassDef)]
    for n in sorted(symbols, key=lambda n: n.end_lineno - n.lineno):
        if isinstance(n, ast.ClassDef):
            continue
        body = n.body[0].lineno if not ast.get_docstring(n, clean=False) else n.body[0].end_lineno + 1
        if lod == "3" and not any(c.lineno <= n.lineno <= c.end_lineno for c in classes):
            shown.update((i, None) for i in range(n.lineno, n.end_lineno + 1))
        elif body <= n.end_lineno and n.body[0].lineno > n.lineno:
            indent = re.match(r"\s*", lines[n.body[0].lineno - 1])[0]
            shown.update((i, None) for i in range(body, n.end_lineno + 1) if i not in shown)
            shown[body] = f"{indent}..."
    inside = {i for n in symbols for i in range(n.lineno, n.end_lineno + 1)}
    out = []
    for i, line in enumerate(lines, 1):
        if lod == "2.5" and i not in inside and i not in imports:
            continue
        if (now := shown.get(i, line)) is not None:
            out.append(now)
    while out and not out[-1].strip():
        out.pop()
    return "\n".join(out)


def skeletons(files: DataFrame, lod: str) -> DataFrame:
    """(path, skeleton) of Python files at a level of detail."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else skeleton(t, lod) for t in b.column(1).to_pylist()], pa.string())],
                ["path", "skeleton"])

    return files.select("path", "text").mapInArrow(run, "path string, skeleton string")


def summaries(graph: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, summary) at the last level: the path, what is known of the file (path, summary, role), its public symbols."""
    public = graph.where("part = 'node' AND name NOT LIKE '\\_%' AND name NOT LIKE '%.\\_%'").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    lines = F.array(F.concat(F.lit("# "), "path"), F.concat(F.lit("## "), "summary"), F.concat(F.lit("Role: "), "role"), F.concat(F.lit("Exports: "), "names"))
    return notes.join(public, "path", "left").select("path", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("summary"))


def synopses(files: DataFrame, most: int = 1500) -> DataFrame:
    """(path, synopsis): the file, its purpose, its classes with the first line of their docstrings, its functions; column functions only."""
    quoted = r"""(?:'''|\"\"\")(.+?)(?:'''|\"\"\")"""
    first = lambda doc: F.trim(F.split_part(F.trim(doc), F.lit("\n"), F.lit(1)))
    purpose = first(F.regexp_extract("text", r"(?s)\A\s*" + quoted, 1))
    head = r"(?ms)^class\s+(\w+)[^:]*:\s*\n\s*" + quoted
    classes = F.zip_with(F.regexp_extract_all("text", F.lit(head), F.lit(1)), F.regexp_extract_all("text", F.lit(head), F.lit(2)), lambda n,
        d: F.when(first(d) != "", F.concat(n, F.lit(" — "), first(d))).otherwise(n))
    functions = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*def\s+([a-zA-Z]\w*)\s*\("), F.lit(1))))
    part = lambda name, text: F.when(text != "", F.concat(F.lit(f"{name}: "), text))
    lines = F.array(part("File", F.col("path")), part("Purpose", purpose), part("Classes", F.array_join(classes, "; ")),
        part("Functions", F.array_join(functions, ", ")))
    return files.select("path", F.substring(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), 1, most).alias("synopsis"))
