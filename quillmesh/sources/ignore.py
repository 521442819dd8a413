"""Walking with ignore files: rules of every folder above a path, the last match wins, an ignored folder hides all below.

Rules are a table (one row a line of an ignore file); a folder or file meets the rules of its ancestors by equality of the folder. Folders
are decided first, once each; then a file is left out when a folder above it is, or by its own last match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.rank import running_sums

IGNORE_FILE = ".gitignore"


def ignore_regex(line: str | None) -> str | None:
    """A line of an ignore file as a regular expression on paths below its folder; null for blank lines and comments. Marks of negation and of folders are read apart."""
    rule = re.sub(r"(?<!\\) +$", "", line or "")
    if not rule or rule.startswith("#"):
        return None
    rule = rule.removeprefix("!").removesuffix("/")
    anchored = "/" in rule
    rule, out, i = rule.removeprefix("/"), "", 0
    if not rule:
        return None
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rule[i:] == "**" and (i == 0 or rule[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (shut := rule.find("]", i + 2)) > 0:
            body = rule[i + 1 : shut].replace("\\", "\\\\").replace("[", "\\[")
            out, i = f"{out}(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]", shut + 1
        elif c == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$"


def rules(files: DataFrame) -> DataFrame:
    """(folder, n, negated, folders, regex) of the ignore files among files (path, text)."""

    @F.pandas_udf("string")
    def regex(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in lines:
            yield x.map(ignore_regex, na_action="ignore")

    own = files.where(paths.base_name(F.col("path")) == IGNORE_FILE)
    lines = own.select(paths.directory(F.col("path")).alias("folder"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    bare = F.regexp_replace("line", r"(?<!\\) +$", "")
    made = lines.select("folder", "n", bare.startswith("!").alias("negated"), bare.endswith("/").alias("folders"), regex("line").alias("regex"))
    return made.where("regex IS NOT NULL")


def above(path: Column) -> Column:
    """The folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def matches(subjects: DataFrame, found: DataFrame, folders: bool) -> DataFrame:
    """(path, ignored) of subjects (path) that some rule of a folder above them matches: by the last one of the deepest folder."""
    met = subjects.select("path", F.posexplode(above(F.col("path"))).alias("depth", "folder")).join(found if folders else found.where("NOT folders"), "folder")
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substr(path, length(folder) + 2)"))
    hit = met.where(F.rlike(below, F.col("regex")))
    return hit.groupBy("path").agg((~F.max_by("negated", F.struct("depth", "n"))).alias("ignored"))


def visible(files: DataFrame) -> DataFrame:
    """files (path, text and more) that the ignore files among them don't hide."""
    found = rules(files)
    folders = files.select(F.explode(above(F.col("path"))).alias("path")).where("path <> ''").distinct()
    hidden = matches(folders, found, True).where("ignored").select(F.col("path").alias("gone"))
    under = files.select("path", F.explode(above(F.col("path"))).alias("gone")).join(hidden, "gone", "left_semi").select("path")
    own = matches(files.select("path"), found, False).where("ignored").select("path")
    return files.join(under.unionByName(own).distinct(), "path", "left_anti")


def walked(files: DataFrame, include: list[str], exclude: list[str], most_bytes: int, most_files: int | None = None, respect: bool = True) -> DataFrame:
    """path, size, hash of files (path, size, text): those that no ignore file hides, included and not excluded, of at most most_bytes; with most_files, the first so many of them in path order."""
    seen = visible(files) if respect else files
    kept = seen.where(paths.included(F.col("path"), include, exclude) & (F.col("size") <= most_bytes))
    rows = kept.select("path", "size", F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32).alias("hash"))
    return rows if most_files is None else running_sums(rows, [F.col("path")], {"place": F.lit(1)}).where(F.col("place") < most_files).drop("place")
