"""Scores in JSON of many shapes, many patterns at once, layers of folders: against plain versions."""

from __future__ import annotations

import random
import re

import pytest

from quillmesh.operators import graphs, patterns, semi

LINES = [("{\"q\": {\"c\": 0.5}}", 0.5), ("{\"q\": {\"c\": 2}}", 2.0), ("{\"q\": {\"c\": \"0.5\"}}", None), ("{\"q\": 1, \"m\": {\"c\": 0.5}}", None), ("{\"m\": {\"c\": 0.25}}", 0.25),
    ("{\"q\": {\"d\": 1}, \"m\": {\"c\": 0.25}}", 0.25), ("{\"q\": {\"c\": null}, \"m\": {\"c\": true}}", 1.0), ("{\"c\": 0.5}", None), ("{\"q\": {\"c\": [1]}}", None), ("{\"q\": ", None), ("", None), (None, None),
    ("[1]", None), ("3", None), ("null", None), ("{\"b\": {\"c\": \"x\"}, \"d\": {\"c\": 1e3}}", 1000.0), ("{\"m\": {\"x\": {\"c\": 1}}}", None), ("{}", None)]


def test_scores_are_found_in_many_shapes(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "id int, line string")
    got = [r.s for r in rows.select("id", semi.lookup(semi.F.try_parse_json("line"), "q.c").alias("s")).orderBy("id").collect()]
    assert got == [y for _, y in LINES]
    all_ = semi.quality(rows, "q.c").first()
    assert (all_.total, all_.valid, all_.parse_errors, all_.low, all_.high) == (18, 6, 12, 0.25, 1000.0)
    assert semi.quality(rows.limit(0), "q.c").first().total == 0


@pytest.mark.parametrize("part", [4_000_000, 20_000])
def test_five_thousand_patterns_in_whole_texts(spark, monkeypatch, part):
    """In one part and in several, as often as a plain search finds them."""
    monkeypatch.setattr(patterns, "PART", part)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    wanted = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(9000)})[:5000]
    texts = ["".join(word().capitalize() + r.choice([" ", " ", "-", "_", "\n"]) for _ in range(400)) for _ in range(15)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame([*enumerate(wanted), (9999, ""), (9998, None)], "pattern int, words string")
    got = {(x.doc_id, x.pattern): (x.n, x.first) for x in patterns.occurrences(docs, table).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, p in enumerate(wanted) if t else ():
            at = [m.start() for m in re.finditer(rf"(?<!\w)(?={re.escape(p)}(?!\w))", t.lower())]
            if at:
                want[d, i] = len(at), at[0]
    assert got == want and len(wanted) == 5000 and len(want) > 1500


def test_mined_documents_name_the_best_keyword_of_their_first_line(spark):
    docs = spark.createDataFrame([("b.md", "x\n see Roadmap and SPRINT \nphase"), ("a.md", "nothing"), ("c/d.md", "undeprecated"), ("z.md", "phase")], "path string, text string")
    words = spark.createDataFrame([(1, "sprint"), (2, "roadmap"), (3, "phase"), (4, "deprecat")], "pattern int, words string")
    got = [(r.path, r.line, r.keyword, r.title, r.note) for r in patterns.mined(docs, words, 2).orderBy("path").collect()]
    assert got == [("b.md", 2, "sprint", "Review: sprint in b.md", "see Roadmap and SPRINT"), ("c/d.md", 1, "deprecat", "Review: deprecat in d.md", "undeprecated")]


def test_layers_and_their_members(spark):
    links = [("a/b/x", "a/b/y"), ("a/b/x", "a/c/d/z"), ("a/c/d/z", "e"), ("a/b", "a/b/x"), ("ext:q", "a/b/y"), ("e", "e")]
    got = {tuple(r) for r in graphs.architecture(spark.createDataFrame(links, "source string, target string")).collect()}
    assert got == {("a/b", "inside", "a/b/x", "a/b/y", 1), ("a", "inside", "a/b", "a/c", 1), ("a/b", "leaves", "a/b/x", "a/c", 1), ("a/c", "enters", "a/b", "a/c/d", 1),
        ("a/c/d", "enters", "a/b", "a/c/d/z", 1), ("", "inside", "a", "e", 1), ("a", "leaves", "a/c", "e", 1), ("a/c", "leaves", "a/c/d", "e", 1), ("a/c/d", "leaves", "a/c/d/z", "e", 1),
        ("a", "inside", "a/b", "a/b", 1), ("a/b", "enters", "a/b", "a/b/x", 1), ("", "inside", "ext:q", "a", 1), ("a", "enters", "ext:q", "a/b", 1), ("a/b", "enters", "ext:q", "a/b/y", 1)}
    files = spark.createDataFrame([("a/b/x",), ("a/n/o",), ("p",)], "path string")
    found = graphs.architecture(spark.createDataFrame(links, "source string, target string"))
    assert {tuple(r) for r in graphs.orphans(files, found).collect()} == {("a", "a/n"), ("a/n", "a/n/o"), ("", "p")}
