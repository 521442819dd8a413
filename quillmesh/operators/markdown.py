"""The graph of markdown documents: a tree of sections, and what each of them refers to, links to and marks.

Lines that hold nothing of interest are dropped before a row is made of a line. A document's rows in order of their lines are one window; in it,
a row's innermost section is the last heading before it, a section's parent is the last one of a smaller depth, and its part of the tree ends
where the next heading of its depth or less begins. Targets are resolved against the document's folder and joined with the files that exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from .parsing import normal_path

# Marks of state, and how a heading, a link, a name in backticks and a written state look.
MARKS = ["✅", "⏳", "❌", "⚠", "🚧"]
HEADING = r"^\s*(#{1,6}) +(.*?\S)\s*$"
LINK = r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^)]*)\)"
TICKED = r"`([^`]*)`"
STATE = r"(?i)\*\*status\*\*[^:]*:(.*)$"
ANY = rf"(?i){HEADING}|`|\]\(|\*\*status\*\*|{'|'.join(MARKS)}"
MARK = "struct<kind:string,text:string,target:string>"


def pathlike(s: Column) -> Column:
    """Whether something in backticks or behind a link names a file: an ending of letters or digits, no number, no phrase."""
    t = F.trim(s)
    number, phrase = t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.contains(" ") & ~t.rlike(r"[/\\]")
    return (F.length(t) <= 200) & t.rlike(r"\.[\p{L}\p{N}]{1,10}$") & ~number & ~phrase


def resolved(folder: Column, target: Column) -> Column:
    """The path that a target means: beside the document where it is a bare name or goes up, else from the root."""
    t = F.regexp_replace(F.trim(target), r"^\./", "")
    return F.when(t.contains("/") & ~t.startswith("../"), t).otherwise(normal_path(F.concat_ws("/", F.when(folder != "", folder), t)))


def marks(docs: DataFrame) -> DataFrame:
    """(path, line, kind, text, target, depth) of all headings, references, links and marks of state of documents (path, text)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x"))), lambda s: s["x"].rlike(ANY))
    rows = docs.select("path", F.explode(lines).alias("s")).select("path", "s.line", "s.x")
    x = F.col("x")

    def mark(kind: str, text: Column, target: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None) if target is None else target).cast("string").alias("target"))

    def some(condition: Column, one: Column) -> Column:
        return F.when(condition, F.array(one)).otherwise(F.array().cast(f"array<{MARK}>"))

    heading = some(x.rlike(HEADING), mark("section", F.regexp_extract(x, HEADING, 2)))
    ticked = F.regexp_extract_all(F.split_part(x, F.lit("```"), F.lit(1)), F.lit(TICKED), F.lit(1))
    references = F.transform(F.filter(ticked, pathlike), lambda t: mark("reference", t, t))
    links = F.filter(F.zip_with(F.regexp_extract_all(x, F.lit(LINK), F.lit(1)), F.regexp_extract_all(x, F.lit(LINK), F.lit(2)),
        lambda a, t: mark("link", a, t)), lambda s: pathlike(s["target"]) & ~F.trim(s["target"]).startswith("http"))
    state = F.trim(F.split_part(F.regexp_extract(x, STATE, 1), F.lit("**"), F.lit(1)))
    states = [some(F.contains(x, F.lit(m)), mark("mark", F.lit(m))) for m in MARKS] + [some(state != "", mark("mark", F.concat(F.lit("status:"), state)))]
    every = F.concat(heading, references, links, *states)
    out = rows.withColumn("depth", F.length(F.regexp_extract(x, HEADING, 1))).select("path", "line", "depth", F.posexplode(every).alias("i", "m"))
    return out.select("path", "line", "i", "m.kind", "m.text", "m.target", F.when(F.col("m.kind") == "section", F.col("depth")).alias("depth"))


def section_id(name: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("sec:"), F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")), F.lit("@"), path, F.lit(":"), line)


def placed(docs: DataFrame) -> DataFrame:
    """marks with the id of each section, and of the innermost one that every row is in (a section's own is itself)."""
    rows = marks(docs)
    own = F.when(F.col("kind") == "section", section_id(F.col("text"), F.col("path"), F.col("line")))
    before = W.partitionBy("path").orderBy("line", "i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("id", own).withColumn("section", F.last("id", ignorenulls=True).over(before))


def sections(docs: DataFrame) -> DataFrame:
    """path, id, name, depth, parent (null at the top), start_line, end_line (before the next heading), tree_end (before the next of its depth or less), refs, links, marks of every section."""
    rows = placed(docs)
    own = rows.groupBy("path", "section").agg(F.count_if(F.col("kind") == "reference").alias("refs"), F.count_if(F.col("kind") == "link").alias("links"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "mark", F.col("text")))).alias("marks"))
    length = docs.select("path", F.size(F.split("text", "\n")).alias("last"))
    w = W.partitionBy("path").orderBy("line")
    before, behind = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    heads = rows.where("kind = 'section'").join(length, "path")
    # of each smaller depth the last heading before, of each depth up to the own the first behind
    above = F.greatest(*(F.when(F.col("depth") > d, F.last(F.when(F.col("depth") == d, F.struct("line", "id")), ignorenulls=True).over(before)) for d in range(1, 6)),
        F.lit(None).cast("struct<line:int,id:string>"))
    next_ = reduce(F.least, [F.when(F.col("depth") >= d, F.min(F.when(F.col("depth") == d, F.col("line"))).over(behind)) for d in range(1, 7)])
    tree = heads.withColumn("above", above).withColumn("next", next_).withColumn("end_line", F.coalesce(F.lead("line").over(w) - 1, "last"))
    full = tree.select("path", "id", F.col("text").alias("name"), "depth", F.col("above.id").alias("parent"), F.col("line").alias("start_line"), "end_line",
        F.coalesce(F.col("next") - 1, "last").alias("tree_end"))
    return full.join(own.withColumnRenamed("section", "id"), ["path", "id"])


def edges(docs: DataFrame, files: DataFrame) -> DataFrame:
    """kind, source, section, target, line, text, known: contains from the section above or the file, references and links_to from the file and the innermost section of what names another file; known: whether that is one of files (path)."""
    file = lambda p: F.concat(F.lit("file:"), p)
    inside = sections(docs).select(F.lit("contains").alias("kind"), file(F.col("path")).alias("source"), F.col("parent").alias("section"), F.col("id").alias("target"),
        F.col("start_line").alias("line"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("known"))
    named = placed(docs).where("kind IN ('reference', 'link')").withColumn("to", resolved(paths.directory(F.col("path")), F.col("target")))
    known = files.select(F.col("path").alias("to"), F.lit(True).alias("known")).distinct()
    out = named.join(known, "to", "left").select(F.when(F.col("kind") == "link", "links_to").otherwise("references").alias("kind"), file(F.col("path")).alias("source"),
        "section", file(F.col("to")).alias("target"), "line", F.when(F.col("kind") == "link", F.col("text")).alias("text"), F.coalesce("known", F.lit(False)).alias("known"))
    return inside.unionByName(out)


def mentions(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, path): each document and each of files that it refers or links to."""
    named = placed(docs).where("kind IN ('reference', 'link')").withColumn("to", resolved(paths.directory(F.col("path")), F.col("target")))
    return named.select(F.col("path").alias("doc"), F.col("to").alias("path")).distinct().join(files.select("path"), "path", "left_semi").select("doc", "path")


def documents_of_module(found: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """(doc, overlap) of the documents that mention a member (path), those of the most first."""
    counted = found.join(members.select("path").distinct(), "path", "left_semi").groupBy("doc").agg(F.countDistinct("path").alias("overlap"))
    return counted.orderBy(F.desc("overlap"), "doc").limit(most) if most else counted
