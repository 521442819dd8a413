"""Single operators on small literals, with exact numbers."""

from __future__ import annotations

import datetime
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import paths, replies, roles, vectors
from quillmesh.functions import text as tx
from quillmesh.operators import aggregates, content, filters, graphs, joins, parsing, rank
from quillmesh.sources import files as source
from quillmesh.streaming import flows


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(("scores", "ratio", "k", "left"),
    [([0.85, 0.82, 0.79, 0.31, 0.28], 0.4, 10, 3), ([0.85, 0.83, 0.81, 0.79, 0.77], 0.4, 10, 5), ([0.5], 0.4, 10, 1), ([0.9, 0.2, 0.18, 0.15], 0.4, 10, 1),
    ([0.9, 0.88, 0.86, 0.84, 0.82], 0.4, 3, 3), ([0.8, 0.8, 0.8, 0.3], 0.4, 10, 3), ([0.0, 0.0, 0.0], 0.4, 10, 1), ([0.5, 0.47, 0.44, 0.41, 0.38], 0.4, 10, 5)])
def test_adaptive_cut(spark, scores, ratio, k, left):
    df = rows(spark, [(1, i, s) for i, s in enumerate(scores)], "q int, id int, score double")
    assert rank.adaptive_cut(df, ["q"], "score", "id", ratio, k).count() == left


def test_diversity_demotes_a_near_copy_and_keeps_order_at_one(spark):
    data = [(0, 0, 0.9, [1.0, 0.0, 0.0]), (0, 1, 0.88, [0.99, 0.01, 0.0]), (0, 2, 0.7, [0.0, 1.0, 0.0])]
    df = rows(spark, data, "q int, id int, score double, vec array<double>")
    order = lambda lam: [r.id for r in vectors.diverse(df, "q", 3, lam).orderBy("place").collect()]
    assert order(0.5) == [0, 2, 1] and order(1.0) == [0, 1, 2]


def test_average_ranks(spark):
    df = rows(spark, [(1,), (2,), (2,), (4,)], "v int")
    assert [r.s for r in rank.with_rank_share(df, "v", "s").orderBy("v", "s").collect()] == pytest.approx([0, 0.5, 0.5, 1])
    assert rank.with_rank_share(rows(spark, [(7,)], "v int"), "v", "s").first().s == 0.5
    assert sorted(r.s for r in rank.with_share_below(df, "v", "s").collect()) == [0, 0.25, 0.25, 0.75]


def test_numbering_over_partitions(spark):
    df = spark.range(5000).selectExpr("id", "pmod(xxhash64(id), 7) AS k").repartition(9)
    got = rank.numbered(df, [F.col("k"), F.col("id")]).orderBy("k", "id").collect()
    assert [r.place for r in got] == list(range(1, 5001))


def test_smooth_derivative_is_exact_on_cubics(spark):
    x = [float(i**3 - 2 * i) for i in range(9)]
    df = rows(spark, [(1, i, v) for i, v in enumerate(x)], "k int, i int, v double")
    got = [r.derivative for r in rank.smooth_derivative(df, ["k"], "i", "v").orderBy("i").collect()]
    assert got[2:-2] == pytest.approx([3 * i * i - 2 for i in range(2, 7)])
    padded = np.pad(np.array(x), 2, mode="reflect")
    assert got == pytest.approx([(padded[i] - 8 * padded[i + 1] + 8 * padded[i + 3] - padded[i + 4]) / 12 for i in range(9)])


def test_spaced(spark):
    df = rows(spark, [(1, i) for i in (1, 2, 4, 5, 9)], "k int, at bigint")
    assert sorted(r["at"] for r in rank.spaced(df, ["k"], "at", 3).collect()) == [1, 4, 9]


def test_chunks_of_a_long_text_may_end_in_overlap(spark):
    df = rows(spark, [("a", "x" * 3700), ("b", "l\n" * 3), ("c", "")], "path string, text string")
    got = content.chunks(df).groupBy("path").agg(F.count("*").alias("n"), F.max("end_line").alias("e")).collect()
    assert {r.path: (r.n, r.e) for r in got} == {"a": (3, 1), "b": (1, 3), "c": (1, 1)}


def test_packed_paragraphs(spark):
    df = rows(spark, [(1, "aa\n\nbb\n\n" + "c" * 11 + "\n\ndd")], "doc_id int, text string")
    assert [r.part for r in content.packed_paragraphs(df, 6).orderBy("i").collect()] == ["aa\n\nbb", "cccccc", "ccccc", "dd"]


def test_markdown(spark):
    text = "intro\n# A\none\n## B\ntwo\n# C\nthree"
    df = rows(spark, [(1, text), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r.section, r.text, r.start_line) for r in content.markdown_sections(df).orderBy("doc_id", "i").collect()]
    assert got == [("", "intro", 1), ("A", "one", 3), ("A > B", "two", 5), ("C", "three", 7)]
    assert [r.content for r in content.markdown_chunks(df, 1800, 350).collect()] == ["intro\n\none\n\ntwo\n\nthree"]


@pytest.mark.parametrize(("path", "glob", "hit"),
    [("a/b.py", "**/*.py", True), ("b.py", "**/*.py", True), ("src/x/y.ts", "src/**", True), ("lib/src", "src/**", False), ("a/b.lock", "*.lock", True),
    ("a/b.py", "?.py", True), ("ab.py", "?.py", False), ("src/x/y.py", "src/*.py", True), ("a1.py", "a[0-9].py", True), ("ab.py", "a[!b].py", False)])
def test_globs(spark, path, glob, hit):
    assert one(spark, paths.any_glob(F.col("p"), [glob]), p=path) is hit


@pytest.mark.parametrize(("q", "intent"),
    [("Where is the parser", "locate"), ("why does it fail", "rationale"), ("what calls foo", "trace"), ("compare a and b", "compare"),
    ("example of use", "example"), ("overview of it", "discover"), ("how does it work", "explain"), ("foo", "explain")])
def test_intents(spark, q, intent):
    assert one(spark, tx.intent(F.col("q")), q=q) == intent


def test_sanitising(spark):
    assert one(spark, tx.safe_fences(F.col("q")), q="a````b```c``") == "a``‘‘b``‘c``"
    assert one(spark, tx.without_urls(F.col("q")), q="x https://e.com/a http://localhost:1/b") == "x [URL-REMOVED] http://localhost:1/b"
    assert one(spark, tx.visible(F.col("q")), q="a​b﻿") == "ab"
    assert one(spark, tx.hits(F.col("q"), tx.SECRETS), q="AKIA" + "A" * 16) == ["aws_key"]
    assert one(spark, tx.clean_query(F.col("q")), q="please can you find it") == "find it"


def test_loops(spark):
    assert one(spark, tx.repeats(F.col("q")), q="ab" * 12) and one(spark, tx.repeats(F.col("q")), q="=" * 31)
    assert not one(spark, tx.repeats(F.col("q")), q="=" * 20 + " plain words")


@pytest.mark.parametrize(("tags", "words", "best"), [(["ui"], ["UI"], 1.0), (["auth"], ["authentication"], 0.7), (["ui"], ["view"], 0.5), (["x"], ["y"], 0.0)])
def test_affinity(spark, tags, words, best):
    assert one(spark, roles.affinity(F.array(*map(F.lit, tags)), F.array(*map(F.lit, words))), z=1) == best


@pytest.mark.parametrize(("n", "budget"), [(1, 0), (50, 1200), (100, 1500), (200, 2100), (1000, 3300), (9000, 4000)])
def test_budgets(spark, n, budget):
    assert one(spark, roles.atlas_budget(F.col("n")), n=n) == budget


def test_gate_rejects_crossed_limits():
    with pytest.raises(ValueError, match="low"):
        filters.gate(F.lit, 0.2, 0.5)


def test_changes_of_one_state_are_none(spark):
    df = rows(spark, [("a", "1"), ("b", None)], "path string, hash string")
    assert {r.status for r in joins.changeset(df, df).collect()} == {"unchanged"}
    new = rows(spark, [("a", "2"), ("c", "1")], "path string, hash string")
    assert {r.path: r.status for r in joins.changeset(df, new).collect()} == {"a": "modified", "b": "deleted", "c": "added"}
    assert {r.status for r in joins.changeset(df, new, False).collect()} == {"unchanged", "deleted", "added"}


def test_prefix_filter_loses_no_pair(spark):
    r = np.random.default_rng(0)
    sets = [sorted({f"t{x}" for x in r.integers(0, 12, 9)}) for _ in range(60)]
    df = rows(spark, list(enumerate(sets)), "id int, tokens array<string>")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.65}
    assert {(x.a, x.b) for x in joins.jaccard_pairs(df, 0.65).collect()} == want


def test_strong_components_of_random_graphs(spark):
    r = np.random.default_rng(7)
    for n, m in ((12, 20), (15, 18)):
        edges = sorted({(int(a), int(b)) for a, b in r.integers(0, n, (m, 2))})
        reach = np.eye(n, dtype=bool)
        for a, b in edges:
            reach[a, b] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k], :]
        both = reach & reach.T
        want = {i: int(np.flatnonzero(both[i])[0]) for i in range(n) if both[i].sum() > 1}
        got = graphs.strong_components(rows(spark, edges, "a bigint, b bigint"))
        assert {x.node: x.root for x in got.collect()} == want


def test_tiers_end_with_cycles(spark):
    nodes = rows(spark, [(i,) for i in range(5)], "id bigint")
    edges = rows(spark, [(1, 0), (2, 1), (3, 4), (4, 3)], "a bigint, b bigint")
    assert {r.id: r.tier for r in graphs.tiers(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_hub_outliers_need_five_files(spark):
    few = rows(spark, [("a", 50), ("b", 1)], "id string, in_degree int")
    assert aggregates.hub_outliers(few).count() == 0
    many = rows(spark, [("a", 50)] + [(f"f{i}", 1) for i in range(9)] + [("z", 0)], "id string, in_degree int")
    assert [r.id for r in aggregates.hub_outliers(many).collect()] == ["a"]


def test_as_of_takes_the_latest_not_after(spark):
    left = rows(spark, [("k", 5), ("k", 1), ("q", 9)], "key string, t int")
    right = rows(spark, [("k", 2, "x"), ("k", 5, "y"), ("q", 10, "z")], "key string, at int, v string")
    got = joins.as_of(left, right, ["key"], "t", "at", ["v"]).collect()
    assert {(r.key, r.t): r.v for r in got} == {("k", 5): "y", ("k", 1): None, ("q", 9): None}


def plain_split(text, most, least):
    import re

    said = [y.strip() for p in re.split(r"\n\n+", text) for y in re.split(r"(?<=[.!?])\s+", p.strip()) if y.strip()]
    v = [vectors.hashed_row(y, 32) for y in said]
    c = [round(float(sum(x * y for x, y in zip(p, q, strict=True))), 9) for p, q in zip(v, v[1:], strict=False)]
    turns = []
    if len(said) > 5:
        c_at = lambda i: c[-i if i < 0 else 2 * len(c) - 2 - i if i >= len(c) else i]
        d = [8 * (c_at(i + 1) - c_at(i - 1)) - (c_at(i + 2) - c_at(i - 2)) for i in range(len(c))]
        turns = [i for i in range(1, len(c)) if d[i - 1] < 0 <= d[i] and c[i] <= np.percentile(c, 20)]
    elif len(said) == 5:
        turns = [i for i in range(4) if c[i] <= np.percentile(c, 20)]
    cuts = []
    for t in turns:
        if not cuts or t - cuts[-1] >= 2:
            cuts.append(t)
    parts, waiting = [], None
    for i, t in enumerate([*cuts, len(said) - 1] if cuts else []):
        group = " ".join(said[cuts[i - 1] + 1 if i else 0 : t + 1])
        if waiting and len(waiting) + 1 + len(group) <= most:
            waiting += " " + group
            continue
        if waiting:
            parts.append(waiting)
        waiting = group if len(group) < least else None
        if not waiting:
            parts.append(group)
    if waiting and parts and len(parts[-1]) + 1 + len(waiting) <= most:
        parts[-1] += " " + waiting
    elif waiting:
        parts.append(waiting)
    out = []
    for p in parts or [text]:
        if len(p) <= (1.5 * most if parts else most):
            out.append(p)
            continue
        now = None
        for q in re.split(r"\n\n+", p):
            # the two of the blank line count behind every paragraph
            if now is not None and len(now) + 2 + len(q) + 2 > most:
                out.append(now)
                now = None
            if len(q) > most:
                out += [q[k : k + most] for k in range(0, len(q), most)]
            else:
                now = q if now is None else now + "\n\n" + q
        out += [now] if now is not None else []
    return out


@pytest.mark.parametrize(("most", "least"), [(1800, 350), (300, 120)])
def test_semantic_split_of_every_document_equals_a_plain_one(spark, most, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = rows(spark, [(-1, "One. Two."), (-2, "x" * 40 + "\n\n" + "y" * 900), (-3, None), (-4, "Ab c. Ab d. Ef g. Ef h. Ef c.")], "doc_id bigint, text string")
    docs = docs.where("doc_id IS NOT NULL").unionByName(odd)
    got = {}
    for r in content.semantic_parts(docs, most, least).orderBy("doc_id", "i").collect():
        got.setdefault(r.doc_id, []).append(r.part)
    want = {r.doc_id: plain_split(r.text, most, least) for r in docs.collect() if r.text is not None}
    assert got == want and sum(len(p) > 1 for p in want.values()) > 20


def test_semantic_split_query_reads_every_document(spark):
    from quillmesh.plans import registry

    sf = "/root/testdata/sf0.001"
    ids = lambda df: {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert ids(registry.QUERIES["gen_semantic_split"](spark, sf)) == ids(spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL"))


def test_seeded_vectors_read_whole_texts(spark):
    import hashlib
    import random

    from quillmesh.plans import registry

    def plain(text):
        r = random.Random(int(hashlib.sha256(text.encode("utf-8")).hexdigest(), 16) % (2**31))
        v = [r.gauss(0, 1) for _ in range(384)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.embedding for r in registry.QUERIES["vec_embed_fake"](spark, sf).collect()}
    assert got.keys() == text.keys() and all(np.allclose(got[k], plain(t)) for k, t in text.items())
    long = rows(spark, [("a " * 400 + "b",), ("a " * 400 + "c",), ("...",)], "text string")
    assert len({tuple(r.v) for r in long.select(vectors.fake(F.col("text")).alias("v")).collect()}) == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(50)} == {100}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_intents_of_questions(spark):
    """One question for each rung of the ladder, and those that a word elsewhere takes off it."""
    want = {
        "Who imports the parser": ("trace", "high"), "why is it so": ("rationale", "high"), "they chose maps": ("rationale", "medium"),
            "between a map and a list": ("compare", "high"),
        "an example please": ("example", "high"), "what's in here": ("discover", "high"), "where is it": ("locate", "high"),
            "please find the parser": ("locate", "medium"),
        "how do i find the parser": ("explain", "low"), "can someone explain the definition": ("explain", "high"), "find out how": ("locate", "high"),
            "tell me about it": ("explain", "high"), "parser": ("explain", "low"),
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", tx.intent(F.col("q")).alias("i"),
        tx.intent_confidence(F.col("q")).alias("c")).collect()
    assert {r.q: (r.i, r.c) for r in rows} == want


def test_update_flow_keeps_keys_of_earlier_batches(spark, tmp_path):
    """Two files, one a batch: a key seen in the first only, one in both, one in the second only."""
    day = 86_400
    for n, rows in enumerate([[("a", 0, 1), ("a", 5, 2), ("b", 10, 4)], [("b", 20, 8), ("b", 3 * day, 16), ("b", 3 * day + 1, 32), ("c", 3 * day, 64)]]):
        at = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), x) for k, s, x in rows]
        spark.createDataFrame(at, "k string, ts timestamp, x long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 0:
            time.sleep(1.1)
    read = spark.readStream.schema("k string, ts timestamp, x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.k: (r.opened - 1_704_067_200_000_000, r.total) for r in flows.drain(flows.budgets(read, "k", "x", day), "update", ["k"]).collect()}
    assert got == {"a": (0, 3), "b": (3 * day * 1_000_000, 48), "c": (3 * day * 1_000_000, 64)}


def brute_modularity(edges, label):
    whole = sum(w for _, _, w in edges)
    inside = sum(w for a, b, w in edges if label[a] == label[b])
    total = {}
    for a, b, w in edges:
        total[label[a]] = total.get(label[a], 0) + w
        total[label[b]] = total.get(label[b], 0) + w
    return inside / whole - sum(t * t for t in total.values()) / (4 * whole * whole)


def test_communities_of_triangles_and_of_planted_groups(spark):
    two = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1), ("a", "a", 9.0)]
    got = {r.id: r.community for r in graphs.communities(rows(spark, two, "a string, b string, w double")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    r = np.random.default_rng(4)
    edges = [(f"n{i:02}", f"n{j:02}", 1.0) for i in range(60) for j in range(i) if r.random() < (0.5 if i % 4 == j % 4 else 0.03)]
    df = rows(spark, edges, "a string, b string, w double")
    label = graphs.communities(df)
    got = {x.id: x.community for x in label.collect()}
    planted = {n: int(n[1:]) % 4 for n in got}
    q = brute_modularity(edges, got)
    assert q >= 0.97 * brute_modularity(edges, planted) and abs(graphs.modularity(df, label).first().q - q) < 1e-9


def test_tag_clusters_split_by_edges(spark):
    entries = rows(spark, [(1, "t"), (2, "t"), (3, "t"), (4, "u"), (5, None), (6, "t")], "id int, tag string")
    edges = rows(spark, [(1, 2), (3, 4), (6, 3)], "a int, b int")
    got = {r.id: (r.tag, r.cluster) for r in graphs.tag_clusters(entries, edges).collect()}
    assert got == {1: ("t", 1), 2: ("t", 1), 3: ("t", 3), 6: ("t", 3), 4: ("uncategorized", None), 5: ("uncategorized", None)}


def test_watch_debounces_spaces_and_backs_off():
    w = flows.Watch(None, 5.0, 20.0, 300.0)
    fired = []
    for at, path, fails in [(0, "a", False), (3, "b", False), (10, "c", False), (40, "d", True), (41, "e", False)]:
        w = flows.Watch(w.state(), 5.0, 20.0, 300.0)
        fired += w.until(at)
        w.saw(at, path, fails)
    fired += w.until(1000)
    # a and b together at 8, c not before 28, d and e at 48 with a failure, put back for 68 (the least gap is longer than the wait)
    assert fired == [(8.0, 2, False), (28.0, 1, False), (48.0, 2, True), (68.0, 2, False)] and w.due() is None
    assert [flows.backoff(n) for n in (1, 2, 5, 20)] == [1.0, 2.0, 16.0, 300.0]


def test_watch_tries_again_without_waiting_for_new_changes():
    w = flows.Watch(None, 100.0, 2.0, 300.0)
    w.saw(0, "a", True)
    fired = [*w.until(101)]
    w.saw(101, "b", False)  # between the failure and its repetition at 102
    w = flows.Watch(w.state(), 100.0, 2.0, 300.0)
    fired += w.until(1000)
    assert fired == [(100.0, 1, True), (102.0, 1, False), (201.0, 1, False)] and w.due() is None


@pytest.mark.parametrize(("reply", "want"), [
    ('{"results": [{"a": 1}, {"a": 2}]}', [1, 2]), ('[{"a": 1}]', [1]), ('{"a": 1}\n{"a": 2}', [1, 2]), ('Sure: {"a": 1} or {"a": 2}.', [1, 2]),
        ('```json\n[{"a": 3}]\n```', [3]),
    ("<think>{}</think>[{\"a\": 4}]", [4]), ('{"results": [{"a": 5}, {"a": 6', [5]), ('[{"a": 7, "b": [1, 2', [7]), ("no items", []), ("", []), (None, []),
        ('{"results": [{"a": {"b": "}"}}]}', [{"b": "}"}]),
])
def test_items_of_replies(reply, want):
    assert [json.loads(x)["a"] for x in replies.items(reply)] == want


def test_levels_of_detail_by_spans(spark):
    text = '"""M."""\nimport os\nX = 1\n\nclass A:\n    """Doc."""\n\n    @property\n    def p(self):\n        """P."""\n        return 1\n\n    def q(self,\n          x):\n        y = x\n        return y\n\ndef f(): return 2\n\ndef g(a):\n    def inner():\n        return a\n    return inner\n'
    got = {lod: parsing.skeleton(text, lod) for lod in ("2", "2.5", "3", "4")}
    assert "return y" not in got["2"] and "X = 1" in got["2"] and '"""P."""' in got["2"] and "    def q(self,\n          x):\n        ..." in got["2"] and "def f(): return 2" in got["2"]
    assert "X = 1" not in got["2.5"] and "import os" in got["2.5"]
    assert "def g" not in got["3"] and "def q" in got["3"] and "class A" in got["3"]
    assert got["4"].splitlines()[0] == "import os" and "class A:" in got["4"] and "y = x" not in got["4"]
    assert parsing.skeleton("not python (", "2") == "not python ("


def test_hybrid_context(spark):
    from quillmesh.facade import Corpus

    corpus = Corpus(spark, "/root/testdata/sf0.001")
    vector = corpus.tables.vectors.where("vec_id = 7").first().embedding
    got = corpus.context("where is the idiot", list(vector), k=5, budget=20_000).collect()
    assert got and sum(r.taken for r in got) <= 20_000 and {r.why for r in got} <= {"found", "neighbour"} and 7 in {r.doc_id for r in got}


def test_vendor_folders(spark):
    files = rows(spark, [("node_modules/a.js", 1), ("src/CMakeCache.txt", 1), ("lib/.git/HEAD", 1), ("big/x", 900), ("own/.git/HEAD", 5), (".hidden/x", 999),
        ("plain/x", 1), ("gen/x", 1), ("top.py", 999)], "path string, size long")
    got = {r.folder: (r.tier, r.reason) for r in source.vendor_folders(files, ["gen"], ["own"], 500, 99).collect()}
    assert got == {"node_modules": ("auto", "install folder"), "src": ("auto", "build output"), "lib": ("propose", "repository inside"),
        "big": ("propose", "size"), "gen": ("auto", "ignored")}


def test_as_of_across_buckets(spark):
    left = rows(spark, [(1, "2024-03-01"), (1, "2024-01-02"), (2, "2024-01-01")], "k int, d string").select("k", F.col("d").cast("timestamp").alias("ts"))
    right = rows(spark, [(1, "2024-01-01", "x"), (1, "2024-01-20", "y"), (2, "2024-02-01", "z")], "k int, d string, v string").select("k",
        F.col("d").cast("timestamp").alias("at"), "v")
    got = {(r.k, r.ts.month): r.v for r in joins.as_of(left, right, ["k"], "ts", "at", ["v"], 5).collect()}
    assert got == {(1, 3): "y", (1, 1): "x", (2, 1): None}


def test_equal_sets_are_paired_apart(spark):
    sets = rows(spark, [(1, "a", ["x", "y", "z"]), (2, "b", ["z", "y", "x"]), (3, "a", ["x", "y", "z"]), (4, "c", ["x", "y", "z", "w"]), (5, "c", ["q"])],
        "id int, folder string, tokens array<string>")
    assert {(r.a, r.b) for r in joins.jaccard_pairs(sets, 0.65).collect()} == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert {(r.a, r.b) for r in joins.jaccard_pairs(sets, 0.65, apart="folder").collect()} == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert [(r.a, r.b) for r in joins.jaccard_pairs(sets, 0.65, most=2).collect()] == [(1, 2), (1, 3)]


def plain_strong(edges):
    """Components by mutual reach, of two nodes or more."""
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            more = reach[b] - reach[a]
            if more:
                reach[a] |= more
                changed = True
    out = {}
    for n in nodes:
        same = {m for m in reach[n] if n in reach[m]}
        if len(same) > 1:
            out[n] = min(same)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_with_chains_and_rings(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(12), r.randrange(12)) for _ in range(14)]
    for k in range(6):  # chains between nodes, some back to where they begin
        a, b, base = r.randrange(12), r.randrange(12), 100 * (k + 1)
        way = [a, *range(base, base + r.randrange(1, 9)), b]
        edges += list(zip(way, way[1:], strict=False))
    ring = list(range(900, 907))
    edges += list(zip(ring, [*ring[1:], ring[0]], strict=True))
    got = {x.node: x.root for x in graphs.strong_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == plain_strong([e for e in edges if e[0] != e[1]])


def test_long_chains_cost_few_rounds(spark):
    """A path of three thousand nodes and a ring of a thousand: neither takes a round a node."""
    edges = [(i, i + 1) for i in range(3000)] + [(10_000 + i, 10_000 + (i + 1) % 1000) for i in range(1000)]
    got = graphs.strong_components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert len(got) == 1000 and {x.root for x in got} == {10_000}


def test_crews_of_other_sizes_are_refused():
    assert len({c for _, c in rank.worker_scopes(10)}) == len(rank.worker_scopes(3)) == 12 and {w for w, _ in rank.worker_scopes(1)} == {"all"}
    with pytest.raises(ValueError, match="not of 4"):
        rank.worker_scopes(4)


def plain_tiers(nodes, edges):
    deps = {n: {b for a, b in edges if a == n and b != n} for n in nodes}
    out = {}
    while ready := [n for n in nodes if n not in out and all(b in out for b in deps[n])]:
        out |= {n: max((out[b] + 1 for b in deps[n]), default=0) for n in ready}
    last = max(out.values(), default=-1) + 1
    return {n: out.get(n, last) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_tiers_with_chains_cycles_and_missing_nodes(spark, seed):
    r = random.Random(seed)
    edges = [(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(26)) if a < b]
    for k in range(5):
        way = [r.randrange(15), *range(100 * (k + 1), 100 * (k + 1) + r.randrange(1, 8)), 15 + r.randrange(15)]
        edges += list(zip(way, way[1:], strict=False))
    edges += [(31, 32), (32, 33), (33, 31), (34, 31), (35, 999), (36, 35), (37, 36), (3, 3)]
    nodes = sorted({x for e in edges for x in e} - {999} | {40})
    got = graphs.tiers(spark.createDataFrame([(n,) for n in nodes], "id int"), spark.createDataFrame(edges, "a int, b int")).collect()
    assert {x.id: x.tier for x in got} == plain_tiers(nodes, edges) and len(got) == len(nodes)


def test_bitmaps_drop_pairs_before_they_are_counted(spark):
    sets = [(1, [1, 2, 3, 4]), (2, [3, 4, 5]), (3, list(range(900))), (4, list(range(500, 1400))), (5, [])]
    made = rows(spark, sets, "id int, x array<int>").select("id", "x", *(c.alias(m) for m, c in joins.bitmap(F.col("x")).items())).collect()
    for a in made:
        for b in made:
            bits = sum(((a[f"m{i}"] ^ b[f"m{i}"]) & (2**64 - 1)).bit_count() for i in range(joins.BITS // 64))
            assert bits <= len(set(a.x) ^ set(b.x)) and (bits > 0) == (a.id != b.id)
    assert [sum((r[f"m{i}"] & (2**64 - 1)).bit_count() for i in range(8)) for r in made if r.id in (1, 5)] == [4, 0]


def test_signals_of_a_question_are_worked_out_once(spark):
    from quillmesh.functions import text as tx

    df = rows(spark, [("see src/a/b.py and util.py where fooBar FooBar snake_case is parsed",)], "q string").select(tx.query_signals(F.col("q")).alias("s"))
    s = df.first().s
    assert (s.paths, s.names, s.symbols, s.keywords[-1]) == (["src/a/b.py"], ["util.py"], ["FooBar", "snake_case"], "parsed")
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 5  # paths, names, two kinds of symbols, words


def test_cochange_shuffles_numbers_in_place_of_paths(spark):
    commits = rows(spark, [(c, f"p{i}", "1998-08-01") for c in range(3) for i in range(3 + c)], "commit_id int, path string, ts string")
    got = graphs.cochange(commits, "1998-09-01", 2000.0, 1, 0.1)
    assert {(r.a, r.b) for r in got.collect()} == {(f"p{i}", f"p{j}") for j in range(5) for i in range(j)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(na" in plan and "hashpartitioning(a#" not in plan


def test_anchor_pairs_equal_brute_force(spark):
    r = random.Random(7)
    have = {i: {r.choice("pqrstuvw") for _ in range(r.randint(1, 5))} for i in range(150)}
    words = {i: sorted({r.choice(["ab1", "cd2", "ef3", "gh4", "ij5", "kl6"]) for _ in range(r.randint(0, 5))}, key=lambda _: r.random()) for i in range(150)}
    words[3] = None
    anchors = spark.createDataFrame([(i, a) for i, x in have.items() for a in x] * 2, "id long, anchor string")
    titles = spark.createDataFrame(list(words.items()), "id long, tokens array<string>")
    for shared, least in [(2, 0.6), (3, 0.5), (1, 0.6), (2, 0.0), (2, 1.0)]:
        want = {}
        for a in have:
            for b in have:
                n, x, y = len(have[a] & have[b]), set(words[a] or []), set(words[b] or [])
                j = len(x & y) / len(x | y) if words[a] is not None and words[b] is not None and x | y else 0.0
                if a < b and n and (n >= shared or j >= least):
                    want[a, b] = n, round(j, 6)
        rows = joins.anchor_pairs(anchors, titles, shared, least).collect()
        assert len(rows) == len(want) and {(x.a, x.b): (x.shared, x.title_jaccard) for x in rows} == want


def test_anchor_of_many_concepts_makes_no_pairs_of_its_own(spark):
    anchors = spark.range(60_000).selectExpr("id", "'hub' AS anchor").union(spark.range(60_000).selectExpr("id", "concat('x', id div 2)"))
    titles = spark.range(60_000).selectExpr("id", "array(concat('w', id), concat('v', id)) AS tokens")
    got = joins.anchor_pairs(anchors, titles)  # 1.8 billion pairs share the hub, 30,000 another anchor too
    assert got.count() == 30_000 and got.where("b = a + 1 AND shared = 2 AND title_jaccard = 0").count() == 30_000


def test_rounds_of_communities_move_numbers_not_ids(spark, monkeypatch):
    seen, inner = [], graphs.moved_labels
    monkeypatch.setattr(graphs, "moved_labels", lambda near, *rest: (seen.append(dict(near.dtypes)), inner(near, *rest))[1])
    edges = rows(spark, [("b", "a", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("z", "y", 2.0), (None, "y", 1.0), ("y", "q", 0.0)], "a string, b string, w double")
    got = {r.id: r.community for r in graphs.communities(edges, rounds=4, levels=1).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert seen and all(d["a"] == d["b"] == "bigint" for d in seen)


@pytest.mark.parametrize("step", ["components", "tiers"])
def test_rounds_on_graphs_handle_numbers(spark, monkeypatch, step):
    """Names are as long as paths: what is shuffled, written and broadcast round by round are places in their order."""
    from quillmesh.operators import graphs

    plain, seen = graphs.chains, []
    monkeypatch.setattr(graphs, "chains", lambda edges, *rest: seen.append({t for _, t in edges.dtypes}) or plain(edges, *rest))
    edges = spark.createDataFrame([("file:z", "file:b"), ("file:b", "file:z"), ("file:b", "file:c"), ("file:a", "file:z"), ("file:c", "gone"), ("file:c", "file:c"), ("file:a", None)],
        "a string, b string")
    if step == "components":
        assert {tuple(r) for r in graphs.strong_components(edges).select("node", "root").collect()} == {("file:z", "file:b"), ("file:b", "file:b")}
    else:
        nodes = spark.createDataFrame([(x,) for x in ("file:a", "file:d", "file:e")], "id string")
        more = spark.createDataFrame([("file:a", "file:d"), ("file:a", "file:d"), ("file:d", "gone"), ("file:e", "file:e")], "a string, b string")
        assert {r.id: r.tier for r in graphs.tiers(nodes, more).collect()} == {"file:e": 0, "file:a": 1, "file:d": 1}
    assert seen == [{"bigint"}]


def test_layers_are_counted_by_side_before_they_are_spread(spark):
    """Edges of one path to one member of the common folder are one row before the rows of the layers are made of them."""
    from quillmesh.operators import graphs

    edges = [("s/1.ts", f"p/b{i % 2}/{i}.py") for i in range(6)] + [("p/b0/x/y.py", "p/b0/0.py"), ("p/b0", "p/b0/0.py"), ("z", "z"), (None, "z")]
    found = graphs.architecture(spark.createDataFrame(edges, "source string, target string"))
    got = {(r.layer, r.way, r.source, r.target): r.n for r in found.collect()}
    assert got[("", "inside", "s", "p")] == got[("s", "leaves", "s/1.ts", "p")] == got[("p", "enters", "s", "p/b0")] * 2 == 6
    assert got[("p/b0", "enters", "s", "p/b0/2.py")] == 1 and got[("p/b0", "inside", "p/b0/x", "p/b0/0.py")] == 1
    assert got[("p/b0/x", "leaves", "p/b0/x/y.py", "p/b0/0.py")] == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
