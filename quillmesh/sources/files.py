"""File and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths

# Never scanned, whatever else is excluded.
BASELINE = ["**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/*.lock"]
# Folders that package managers install into, and files that mark build output.
INSTALL_DIRS = [
    "node_modules", "bower_components", "jspm_packages", ".venv", "venv", "__pycache__", ".tox", ".nox", ".pytest_cache", ".mypy_cache", ".ruff_cache",
        "site-packages", "target", "vendor", "Pods", "Carthage", ".build", "DerivedData",
    ".gradle", ".bundle", "bazel-bin", "bazel-out", "third_party",
]
BUILD_MARKS = ["CMakeCache.txt", "build.ninja"]
# Marks of work left to do, with what they are about.
MARKS = {"TODO": "feature", "FIXME": "bug", "HACK": "debt", "XXX": "debt", "OPTIMIZE": "performance", "PERF": "performance", "BUG": "bug"}


def walk(spark: SparkSession, root: str, include: list[str], exclude: list[str], most_bytes: int) -> DataFrame:
    """path, size, modified, content of the files under a folder; names and sizes are filtered before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/").rsplit("/", 1)[-1]
    rel = F.regexp_replace("path", f"^.*?/{top}/", "")
    return raw.where(F.col("length") <= most_bytes).withColumn("rel",
        rel).where(paths.included(F.col("rel"), include, exclude)).select(F.col("rel").alias("path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), "content")


def source_files(files: DataFrame, user_excludes: list[str]) -> DataFrame:
    """User excludes add to the baseline, they never replace it."""
    return files.where(~paths.any_glob(F.col("path"), BASELINE + user_excludes))


def planning_docs(files: DataFrame, agent_dirs: bool = True) -> DataFrame:
    keep = F.col("path").rlike(r"\.(?:md|markdown)$")
    return files.where(keep if agent_dirs else keep & ~F.col("path").rlike(r"(?:^|/)\.[^/]+/"))


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, order: str | None = None) -> DataFrame:
    """Rows of JSON-lines files, malformed ones left out; with a key, the row of each that is last in order (a column), whatever file and line it is on."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if key is None:
        return df
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("row")).select("row.*")


def numstat(log: DataFrame) -> DataFrame:
    """commit_id, author, path, added, removed from log lines (i, line): each row of numbers belongs to the last header above it; ``-`` counts as 0.

    Lines are in blocks (column block) that begin with a header, so that a block is one window.
    """
    w = W.partitionBy("block").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.when(F.col("line").startswith("COMMIT "), F.col("line"))
    with_head = log.withColumn("head", F.last(head, ignorenulls=True).over(w)).where("line LIKE '%\t%\t%'")
    parts, h = F.split("line", "\t"), F.split(F.substring_index("head", "COMMIT ", -1), r"\|")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    return with_head.select(h[0].alias("commit_id"), h[1].alias("author"), parts[2].alias("path"), number(parts[0]).alias("added"),
        number(parts[1]).alias("removed"))


def todos(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, line, mark, note and a stable id of every mark of work left to do, without known ids."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    mark = rf"\b({'|'.join(MARKS)})\b[:\s]*(.*)$"
    hits = lines.where(F.col("text").rlike(mark)).select("path", (F.col("n") + 1).alias("line"), F.regexp_extract("text", mark, 1).alias("mark"),
        F.trim(F.regexp_extract("text", mark, 2)).alias("note"))
    out = hits.withColumn("id", F.substring(F.sha2(F.concat_ws(":", "path", "line", "note"), 256), 1, 12))
    return out.join(known, "id", "left_anti") if known is not None else out


def vendor_folders(files: DataFrame, ignored: list[str], members: list[str], most_bytes: int = 500 << 20, most_files: int = 25_000) -> DataFrame:
    """(folder, files, bytes, tier, reason) of the top folders of files (path, size) that look vendored: auto by name, by the ignore list or by marks of build output; proposed for a repository of its own or by sheer size. Members of the workspace are the user's own."""
    folder, rest = F.split_part("path", F.lit("/"), F.lit(1)), F.regexp_replace("path", "^[^/]*/", "")
    inside = files.where(F.col("path").contains("/")).select(folder.alias("folder"), rest.alias("rest"), "size")
    per = inside.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max(F.col("rest").isin(BUILD_MARKS)).alias("built"),
            F.max(F.col("rest").startswith(".git/") | (F.col("rest") == ".git")).alias("nested")
    )
    name = F.col("folder")
    reason = F.when(name.isin(INSTALL_DIRS), "install folder").when(name.isin(ignored), "ignored").when(F.col("built"), "build output").when(F.col("nested"),
        "repository inside")
    reason = reason.when((F.col("bytes") > most_bytes) | (F.col("files") > most_files), "size")
    own = name.isin(members) | (name.startswith(".") & ~name.isin(INSTALL_DIRS))
    found = per.withColumn("reason", reason).where(F.col("reason").isNotNull() & ~own)
    return found.select("folder", "files", "bytes", F.when(F.col("reason").isin("repository inside", "size"), "propose").otherwise("auto").alias("tier"),
        "reason")
