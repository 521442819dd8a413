"""Column functions on file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name endings and their languages.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".go": "go",
        ".rs": "rust", ".java": "java", ".kt": "kotlin", ".swift": "swift",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".scala": "scala", ".md": "markdown",
        ".sh": "shell", ".sql": "sql",
}

# Directory names that place a file in a layer; the first that matches wins.
LAYERS = [
    (("test", "tests", "spec", "fixture", "__test__", "__tests__", "e2e"), "testing"),
    (("api", "routes", "endpoint", "handler", "views", "controller"), "presentation"),
    (("ui", "component", "page", "layout", "widget", "screen"), "presentation"),
    (("core", "engine", "service", "logic", "domain", "usecase"), "business_logic"),
    (("db", "model", "schema", "migration", "orm", "repository"), "data_access"),
    (("auth", "security", "permission", "rbac", "crypto", "token"), "security"),
    (("deploy", "docker", "k8s", "infra", "ci", "terraform", "helm"), "infrastructure"),
    (("config", "settings", "env", "dotenv"), "configuration"),
    (("util", "helper", "lib", "shared", "common"), "utility"),
    (("cli", "cmd", "command"), "presentation"),
    (("plugin", "extension", "addon", "middleware"), "integration"),
    (("doc", "docs", "readme", "guide"), "documentation"),
]

# Generated content by name, ending and directory.
GENERATED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Cargo.lock", "poetry.lock", "Pipfile.lock"]
GENERATED_ENDS = [".d.ts", ".min.js", ".min.css", ".pb.go", "_pb2.py", ".generated.ts", ".generated.py"]
GENERATED_DIRS = ["__generated__", "generated", "dist", "build"]

# What change statistics leave out.
NOISE_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache", "htmlcov", "coverage",
    "dist", "build", "target", "out", "vendor"]
NOISE_ENDS = [".lock", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".bin", ".ico", ".webp", ".mp4", ".mov"]

# Marks of test files.
TEST_DIRS = ["test", "tests", "spec", "specs", "__tests__"]
TEST_STARTS, TEST_ENDS = ["test_", "tests_"], ["_test", "_spec", "_tests"]


def glob_regex(pattern: str) -> str:
    """A Java regular expression for whole strings: a star also spans slashes, as in shell-style matching of plain strings."""
    out, i = "", 0
    while i < len(pattern):
        c, shut = pattern[i], pattern.find("]", i + 2)
        if c == "[" and shut > 0:
            body = pattern[i + 1 : shut].replace("\\", r"\\")
            out, i = f"{out}[{'^' + body[1:] if body[0] == '!' else body}]", shut + 1
        else:
            out, i = out + {"*": ".*", "?": "."}.get(c, re.escape(c)), i + 1
    return f"(?s)^(?:{out})$"


def any_glob(path: Column, patterns: list[str]) -> Column:
    """One regular expression for all globs, on the whole path and on the base name; ``**/`` in front may also stand for nothing."""
    forms = [glob_regex(q) for p in patterns if p for q in ([p, p[3:]] if p.startswith("**/") else [p]) if q]
    if not forms:
        return F.lit(False)
    every = "|".join(f"(?:{f})" for f in forms)
    return path.rlike(every) | base_name(path).rlike(every)


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    return (any_glob(path, include) if include else F.lit(True)) & ~any_glob(path, exclude)


def under(path: Column, scope: Column) -> Column:
    return (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(pairs, F.lower(extension(path)))


def layer(path: Column) -> Column:
    folders = F.split(F.lower(directory(path)), "/")
    out = None
    for words, name in LAYERS:
        hit = F.arrays_overlap(folders, F.array(*map(F.lit, words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def generated(path: Column) -> Column:
    ends = "|".join(re.escape(e) for e in GENERATED_ENDS)
    dirs = "|".join(GENERATED_DIRS)
    return base_name(path).isin(*GENERATED_NAMES) | path.rlike(f"(?:{ends})$") | path.rlike(f"(?:^|/)(?:{dirs})(?:/|$)")


def noise(path: Column) -> Column:
    """Left out of change statistics: install and build folders, lock files, media."""
    dirs, ends = "|".join(map(re.escape, NOISE_DIRS)), "|".join(map(re.escape, NOISE_ENDS))
    return path.rlike(f"(?:^|/)(?:{dirs})(?:/|$)") | base_name(path).isin(*GENERATED_NAMES) | F.lower(path).rlike(f"(?:{ends})$")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def test_file(path: Column) -> Column:
    low, dirs = F.lower(path), "|".join(TEST_DIRS)
    return low.rlike(f"(?:^|/)(?:{dirs})/") | stem(low).rlike(f"^(?:{'|'.join(TEST_STARTS)})|(?:{'|'.join(TEST_ENDS)})$")


def role(path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    tests = low.rlike(r"/(?:tests?|__tests__|testing)/")
    docs = low.rlike(r"\.(?:md|markdown|rst|txt)/$") | low.rlike(r"/(?:docs?|documentation|design|specs?|architecture|arch|adrs?|decisions?|rfcs?)/")
    code = low.rlike(r"\.(?:py|jsx?|tsx?|go|rs|java|kts?|c|h|cc|cpp|hpp|cs|rb|php|swift|scala)/$") | low.rlike(r"/(?:src|lib|apps?|packages|pkg|server|client|ui|frontend|backend|cmd)/")
    return F.when(tests, "tests").when(docs, "docs").when(code, "code").otherwise("other")
