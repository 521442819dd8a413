"""Glob joins against plain matching, ignore files against git itself."""

from __future__ import annotations

import fnmatch
import random
import re
import subprocess

from quillmesh.operators import globs
from quillmesh.sources import ignore


def plain(path, target):
    if path == target or (target.endswith("/") and path.startswith(target)):
        return True
    if "*" in target:
        return fnmatch.fnmatchcase(path, target)
    return "/" in target and "." not in target.split("/")[-1] and path.startswith(target + "/")


def test_glob_join_equals_plain_matching_without_nested_loops(spark):
    r = random.Random(5)
    pick = lambda: r.choice(["src", "a", "b.c", "test_x", "lib", "é"])
    paths = sorted({"/".join(pick() for _ in range(r.randint(1, 4))) + r.choice(["", ".py", ".rs", "_long_ending_of_a_name.tsx"]) for _ in range(300)})
    targets = sorted({r.choice(["", "*/", "**/", "s[rx]c/*", "[!a]*/", "?rc/*"]) + "/".join(r.choice([pick(), "*", pick() + "*", "*" + pick()]) for _ in range(r.randint(1, 3)))
        + r.choice(["", "/", ".py", "*.py", "*name.tsx", "?.rs", "*test*"]) for _ in range(500)} | {"*", "*_*", "src"})
    rules = spark.createDataFrame(list(enumerate(targets)), "rule int, target string")
    got = globs.matched(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    want = {(p, i) for p in paths for i, t in enumerate(targets) if plain(p, t)}
    rows = [(x.path, x.rule) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 2000
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())


def test_rules_of_all_kinds(spark):
    changed = spark.createDataFrame([("src/a.py", "x = 1\n  from os import b\nkey = 1", 5), ("src/b.py", None, 2)], "path string, text string, dependents long")
    rows = [("modified", "file_modified", "src/*", "", 0, "active"), ("created", "file_created", "src/b.py", "", 0, "active"), ("import", "import_added", "*.py", r"\bos\b", 0, "active"),
        ("no import", "import_added", "*.py", "key", 0, "active"), ("pattern", "pattern_match", "src", "key = ", 0, "active"), ("under", "pattern_match", "src/", "key = ", 0, "active"),
        ("coupled", "coupling_threshold", "*", "", 3, "active"), ("never", "coupling_threshold", "*", "", 0, "active"), ("testing", "file_modified", "*", "", 0, "testing"),
        ("empty", "pattern_match", "*", "", 0, "active")]
    rules = spark.createDataFrame([(*x[:5], "warn", x[5]) for x in rows], "rule string, kind string, target string, pattern string, max_dependents int, severity string, status string")
    got = {(r.path, r.rule) for r in globs.hits(changed, rules).collect()}
    assert got == {("src/a.py", "modified"), ("src/b.py", "modified"), ("src/b.py", "created"), ("src/a.py", "import"), ("src/a.py", "under"), ("src/a.py", "coupled")}


IGNORES = {
    ".gitignore": "# note\n*.log\n!keep.log\n/top.txt\nbuild/\ndoc/*.txt\n**/deep/x\na/**/z\n\\#odd\nsp ace \nq?z\n[ab]c.py\nall/**\n\nfoo/bar\n*.d/\n",
    "sub/.gitignore": "*.py\n!good.py\n/only\n!*.log\nnest/keep\n",
    "sub/nest/.gitignore": "!*.py\n",
}


def test_ignore_files_as_git_reads_them(spark, tmp_path):
    names = ["x.log", "keep.log", "top.txt", "top2.txt", "x/y", "z", "#odd", "sp ace", "qaz", "ac.py", "cc.py", "good.py", "only", "keep", "bar", "x.d"]
    folders = ["", "sub/", "build/", "doc/", "sub/nest/", "sub/build/", "doc/in/", "deep/", "p/deep/", "a/", "a/m/", "all/", "foo/", "s/foo/", "h.d/"]
    made = {f + n: "t" for f in folders for n in names if not (n == "x.d" and f == "") } | {"w.d": "t"}
    made |= IGNORES
    made = {p: t for p, t in made.items() if not any(q.startswith(p + "/") for q in made)}
    for p, t in made.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    out = subprocess.run(["git", "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "ls-files", "-o", "--exclude-standard"], cwd=tmp_path, check=True, capture_output=True, text=True)
    files = spark.createDataFrame([(p, len(t), t) for p, t in made.items()], "path string, size long, text string")
    got = {r.path for r in ignore.visible(files).collect()}
    assert got == set(out.stdout.splitlines())


def test_walk_stops_in_path_order(spark):
    files = spark.createDataFrame([(f"f{i:03}", i, str(i)) for i in range(200)] + [("f0001", 10, None)], "path string, size long, text string").repartition(7)
    got = ignore.walked(files, ["f0*"], ["*9"], 50, 30)
    assert sorted(r.path for r in got.collect()) == sorted(p for p in [*(f"f{i:03}" for i in range(51)), "f0001"] if not p.endswith("9"))[:30]
    assert ignore.walked(files.limit(0), [], [], 1, 1).count() == 0


def test_walk_without_a_limit_keeps_every_file(spark):
    files = spark.range(300).selectExpr("concat('f', id) AS path", "id AS size", "cast(id AS string) AS text")
    assert ignore.walked(files, [], [], 1000).count() == 300


def test_a_target_of_many_rules_is_compared_once(spark):
    changed = spark.createDataFrame([("a/src1/x.rs",), ("a/src2/x.rs",)], "path string")
    rules = spark.range(5000).selectExpr("id AS rule", "concat('*/src', id % 2 + 1, '/*') AS target")
    met = globs.met_targets(changed, rules)
    assert sorted((r.path, r.target) for r in met.collect()) == [("a/src1/x.rs", "*/src1/*"), ("a/src2/x.rs", "*/src2/*")]
    got = globs.matched(changed, rules)
    assert got.columns == ["path", "rule", "target"] and got.count() == 5000 and got.select("rule").distinct().count() == 5000
    assert got.where("path LIKE concat('%src', rule % 2 + 1, '%')").count() == 5000


def test_a_text_is_read_once_for_each_pattern(spark):
    changed = spark.createDataFrame([("a/x.rs", "key = 1\nimport b", 2), ("a/y.rs", "none", 2)], "path string, text string, dependents long")
    rules = spark.range(400).selectExpr("id AS rule", "if(id % 2 = 0, 'pattern_match', 'import_added') AS kind", "if(id % 4 < 2, 'a/*', '*.rs') AS target", "if(id % 2 = 0, 'key', 'b$') AS pattern",
        "0 AS max_dependents", "'warn' AS severity", "'active' AS status")
    got = globs.hits(changed, rules)
    assert sorted((r.path, r.rule) for r in got.collect()) == [("a/x.rs", i) for i in range(400)]
