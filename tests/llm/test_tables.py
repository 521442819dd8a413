"""Fixity, near-duplicates, mixing, vectors, the pipeline: against brute force and SQL."""

from __future__ import annotations

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import flat_graph, hyperlang, merkle, mixing, multi_index, ngram_join, queries, toxicity
from quillmesh.llm.common import stored, table


def same(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    null = [c for c in cols if got[c].isna().all() and want[c].isna().all()]  # whose type pandas guesses
    a, b = (x[cols].drop(columns=null).sort_values([c for c in cols if c not in null]).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    same(spark, name, sf)


def jaccard(rows, least=0.8):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = re.findall(r"\w+", (text or "").lower())
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    return [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]


def test_near_duplicates_on_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    links = [0] * len(rows)
    for a, b in jaccard(rows):
        links[a] += 1
        links[b] += 1
    got = ngram_join.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == sorted((r[0] or 0, n) for r, n in zip(rows, links, strict=True))
    assert {r.doc_id: r.class_id for r in got}[3] == 1
    kept = ngram_join.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.deduplicated(none).count() == 0


def test_large_group_is_dealt_in_blocks(spark, monkeypatch):
    """Near copies of one text, more than a block holds, keep every link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        w[i] = f"other{i}"
        rows.append((i, " ".join(w)))
    links = np.zeros(70, int)
    for a, b in jaccard(rows):
        links[a] += 1
        links[b] += 1
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate(links.tolist())) and {r.class_id for r in got} == {0}


def test_pruning_rarely_drops_a_pair_at_the_threshold():
    r = np.random.default_rng(3)
    agree = (r.random((20_000, ngram_join.VALUES)) < 0.8).cumsum(1)
    steps = ngram_join.least_matches()
    lost = np.any([agree[:, (i + 1) * ngram_join.STEP - 1] < m for i, m in enumerate(steps)], axis=0)
    far = (r.random((5000, ngram_join.VALUES)) < 0.4).cumsum(1)
    dropped = np.any([far[:, (i + 1) * ngram_join.STEP - 1] < m for i, m in enumerate(steps)], axis=0)
    assert lost.mean() < 1e-3 and dropped.mean() > 0.999


def test_mix_targets_fill_up_and_stop(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "s string, source_size bigint")
    t = {r.s: r.target for r in mixing.targets(rows).collect()}
    assert t["a"] == 300 and t["b"] == 30 and t[None] == 15 and t["c"] == pytest.approx(1115 - 345)


def test_mix_meets_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = mixing.mix(docs).toPandas()
    for _, g in got.groupby("target"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 9
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id").copies.tolist() == got.sort_values("doc_id").copies.tolist()
    assert mixing.mixed(docs).count() == got.copies.sum()


def test_mix_with_unequal_weights_prefers_them(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
        F.when(F.col("id") % 8 < 4, 3.0).otherwise(1.0).alias("quality"))
    got = mixing.mix(docs, weight_col="quality").join(docs.select("doc_id", "quality", "source"),
        "doc_id").where("source = 's3'").groupBy("quality").agg(F.avg("copies").alias("c")).collect()
    c = {r.quality: r.c for r in got}
    assert c[3.0] > 1.5 * c[1.0]


def test_rates_share_again_what_the_bound_cuts(spark):
    """Two weights, target 2.5 times the size: the heavier documents stop at 3, the lighter ones take the rest."""
    per = spark.createDataFrame([("a", 1.0, 100), ("a", 2.0, 100), (None, 1.0, 10), ("z", 1.0, 0)], "s string, weight double, x long")
    goal = spark.createDataFrame([("a", 200, 500.0), (None, 10, 30.0), ("z", 0, 0.0)], "s string, source_size long, target double")
    got = {r.s: r.rate for r in mixing.rates(per, goal, 3.0).collect()}
    assert got == {"a": 2.0, None: 3.0, "z": None}


def test_mix_of_one_hot_source_without_ids(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * (i % 700 + 1), "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert (got.copies <= 3).all() and got[got.source_size == got.source_size.max()].copies.nunique() > 1


def test_longer_texts_of_a_source_are_likelier(spark):
    docs = spark.createDataFrame([(i, "w " * (50 if i % 2 else 800), "a" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    for _, g in got[got.target < 3 * got.source_size].groupby("source_size"):
        means = g.groupby("size").copies.mean()
        assert 1.5 < means[800] / means[50] < 2.0


def test_mix_on_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and {r.size for r in got if r.doc_id in (4, 5, 6)} == {0}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mix_plan_has_no_python(spark, sf):
    plan = mixing.mix(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")


def test_audit_finds_just_the_damage(spark):
    rows = [(i, f"u{i}", "x" * (i % 300), "clash") for i in range(700)] + [(None, None, None, None), (5, "u5", "again", None)]
    good = pages(spark, rows)
    bad = pages(spark, [(i, u, "y" + h[1:] if i in (3, 299, 650) else h, d) for i, u, h, d in rows if i != 44] + [(9999, "new", "n", None)])
    a = merkle.Archive(good, range_bytes=2000)
    assert a.last > 1 and a.audit(good).count() == 0
    assert {(r.id, r.status) for r in a.audit(bad).collect()} == {(3, "corrupt"), (299, "corrupt"), (650, "corrupt"), (44, "missing"), (9999, "extra")}
    out = merkle.fixity(good, bad).collect()
    assert len(out) == 702
    at = 0
    for r in sorted(out, key=lambda r: r.rec_offset):
        assert r.rec_offset == at
        at += r.rec_length


def test_equal_roots_prove_equal_archives(spark, monkeypatch):
    """A record that only the replica has changes the root; an intact replica's leaves aren't compared at all."""
    rows = [(i, f"u{i}", "x" * i, None) for i in range(50)] + [(None, None, "a", None), (None, None, "a", None), (None, None, None, None)]
    a = merkle.Archive(pages(spark, rows), range_bytes=500)
    root = lambda x: x.tree.where(F.col("level") == x.last + 1).collect()
    more = pages(spark, [*rows, (51, "u51", "y", None)])
    theirs = merkle.tree(merkle.placed(merkle.records(more), a.ranges), a.last).where(F.col("level") == a.last + 1).collect()
    assert len(root(a)) == 1 and len(theirs) == 1 and root(a)[0].digest != theirs[0].digest
    assert [(r.id, r.status) for r in a.audit(more).collect()] == [(51, "extra")]
    bad = pages(spark, [*rows[:-2], (None, None, "b", None), rows[-1]])
    assert sorted((r.id, r.status) for r in a.audit(bad).collect()) == [(None, "extra"), (None, "missing")]
    read = []
    monkeypatch.setattr(merkle, "under", lambda *x: read.append(x))
    assert a.audit(pages(spark, rows).repartition(3)).count() == 0 and not read


def test_leaves_outside_of_open_ranges_are_not_read(spark):
    a = merkle.Archive(pages(spark, [(i, f"u{i}", "x" * 300, None) for i in range(400)]), range_bytes=1000)
    plan = merkle.under(a.leaves, a.leaves.where("range = 7").select(F.col("range").alias("parent")).distinct())._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(range), EqualTo(range,7)]" in plan or "In(range, [7])" in plan


def test_audit_of_empty_archives(spark):
    none = pages(spark, [])
    assert merkle.fixity(none, none).count() == 0
    assert merkle.Archive(none).audit(pages(spark, [(1, "u", "h", None)])).collect()[0].status == "extra"


VECTORS = "vec_id bigint, embedding array<float>, label int, score double"


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1, 0.1), (1, [1.0, 0.01], 1, None), (20, [1.0, 0.0], 1, None), (2, [0.0, 0.0], 1, None), (3, None, 1, None),
        (4, [nan, 1.0], 1, None), (5, [None, 1.0], 1, None), (6, [1.0, 0.0], None, None), (40, [0.0, 1.0], 2, None), (7, [1.0, 0.0, 0.0], 1, None),
        (1, [1.0, 0.01], 1, None)]
    df = spark.createDataFrame(rows, VECTORS)
    near = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 4)) for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert near[0, 1] == (1, 1.0) and near[0, 2] == (6, 1.0) and near[0, 3] == (20, 1.0) and near[0, 4] == (40, 0.0)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in flat_graph.near_vectors(df).collect())
    assert got == [(0, 3, 0, True), (1, 3, 0, False), (1, 3, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 0, 7, True), (20, 3, 0, False), (40, 0, 40, True)]
    empty = df.limit(0)
    assert multi_index.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0 and flat_graph.near_vectors(empty).count() == 0


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_pigeonhole_probing_finds_every_code_within_the_distance(r):
    g = np.random.default_rng(5)
    codes = g.integers(0, 256, (900, multi_index.BITS // 8)).astype(np.uint8)
    for i in range(300):  # near codes at all distances up to what r covers
        codes[i] = codes[899]
        flips = g.choice(multi_index.BITS, g.integers(0, multi_index.PARTS * (r + 1)), replace=False)
        np.bitwise_xor.at(codes[i], flips // 8, (1 << (flips % 8)).astype(np.uint8))
    hit, ended = multi_index.Tables(codes).retrieve(codes[899:], 300, 99)
    d = np.unpackbits(codes ^ codes[899], axis=1).sum(1)
    assert ended[0] <= r and hit[0][d < multi_index.PARTS * (ended[0] + 1)].all() and hit[0].sum() >= 300


def test_a_shard_of_few_rows_is_retrieved_whole():
    codes = np.random.default_rng(6).integers(0, 256, (50, multi_index.BITS // 8)).astype(np.uint8)
    assert multi_index.Tables(codes).retrieve(codes[:3])[0].all()


def brute_recall(x, ids, got, k=20):
    hit = n = 0
    for q, g in got.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at]
        s[at] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:k]]) & set(g.vec_id))
        n += k
    return hit / n


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = table(spark, d, "embeddings").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    got = queries.op5_multi_index_hashing(spark, d).toPandas()
    assert brute_recall(x, ids, got) >= 0.95 and (got.groupby("query_id").size() == 20).all() and len(got) == 20 * (ids % 20 == 0).sum()
    score = {(r.query_id, r.vec_id): r.score for r in got.itertuples()}
    assert all(abs(s - x[ids == a][0] @ x[ids == b][0]) < 1e-12 for (a, b), s in score.items())


def test_search_over_many_shards_with_repeated_ids_and_ties(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD", 100)
    x = clustered(np.random.default_rng(9), 800, 16, 0.1)
    x[1] *= 3
    x[5:9] = x[1]  # ties, beside rows that repeat an id
    rows = [(i, v.tolist(), 0, None) for i, v in enumerate(x)] + [(7, x[1].tolist(), 0, None)] * 3
    got = multi_index.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 1, k=4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 6, 7, 8]
    got = multi_index.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).toPandas()
    assert brute_recall(np.array([np.float32(v).tolist() for v in x]), np.arange(800), got) >= 0.95


@pytest.mark.parametrize("dim", [64, 384])
def test_copies_are_ordered_by_id(spark, monkeypatch, dim):
    """Hundreds of copies of five vectors over several shards: equal scores, ids in order."""
    monkeypatch.setattr(multi_index, "SHARD", 256)
    five = np.random.default_rng(2).normal(size=(5, dim)).astype(np.float32)
    rows = [(i, five[(i * 7 + i // 11) % 5].tolist()) for i in range(1000)]
    got = multi_index.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    assert len(got) == 1000
    for q, g in got.sort_values("rank").groupby("query_id"):
        copies = [i for i, v in rows if v == rows[q][1] and i != q]
        assert g.vec_id.tolist() == copies[:20] and g.score.nunique() == 1


def test_inner_products_of_unequal_lengths(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8)) * r.uniform(0.1, 4, (600, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], VECTORS)
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    x = np.array([np.float32(v).tolist() for v in x])
    hit = sum(len(set(np.argsort(-np.where(np.arange(600) == q, -9e9, x @ x[q]))[:5]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit / (30 * 5) > 0.95


def clustered(r, n, dim, tight):
    c = r.normal(size=(n // 20, dim))
    return np.repeat(c, 20, 0) + tight * r.normal(size=(n, dim))


def plain_links(x, label):
    """n_links and the least row of each row's component, by comparing all."""
    x = np.array([np.float32(v).tolist() for v in x])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(m, False)
    return m.sum(1).tolist(), ngram_join.roots_of(len(x), *np.nonzero(m)).tolist()


@pytest.mark.parametrize(("shard", "block"), [(60, 4000), (60, 50), (4000, 4000), (4000, 70)])
def test_flat_graph_links_equal_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(flat_graph, "SHARD", shard)
    monkeypatch.setattr(flat_graph, "BLOCK", block)
    x, label = clustered(np.random.default_rng(2), 600, 16, 0.18), np.arange(600) % 2
    df = spark.createDataFrame([(i, v.tolist(), i % 2, None) for i, v in enumerate(x)], VECTORS)
    got = flat_graph.near_vectors(df).toPandas().sort_values("vec_id")
    assert (got.n_links.tolist(), got.component_id.tolist()) == plain_links(x, label)


def test_flat_graph_of_one_tight_group(spark, monkeypatch):
    """Five thousand near copies: every shard holds all of them, no task more than two blocks."""
    monkeypatch.setattr(flat_graph, "SHARD", 2500)
    monkeypatch.setattr(flat_graph, "BLOCK", 2000)
    r = np.random.default_rng(8)
    x = r.normal(size=64) + 0.22 * r.normal(size=(5000, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1, None) for i, v in enumerate(x)], VECTORS)
    got = flat_graph.near_vectors(df).toPandas().sort_values("vec_id")
    want = plain_links(x, np.ones(5000))
    assert (got.n_links.tolist(), got.component_id.tolist()) == want and max(want[0]) > 4000
    members = flat_graph.link_table(flat_graph.numbered_nodes(df.selectExpr("vec_id AS id", "transform(embedding, x -> double(x)) AS v",
        "string(label) AS label", "true AS usable")), 0.93)
    sums = members.agg(F.sum("links").alias("l"), F.sum("searched").alias("s")).first()
    assert sums.l == sum(want[0]) and sums.s > 0


def test_graph_degree_is_bounded_around_a_hub():
    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((1, 32)), np.ones((3000, 32)) + 0.3 * r.normal(size=(3000, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists, crowded = flat_graph.build(x, 0.93)
    assert (lists >= 0).sum(1).max() < flat_graph.DEGREE + flat_graph.NEAR and crowded[0]


def linked(x, graph, open_=None, audit=None):
    """Pairs that links returns for all rows."""
    n = len(x)
    no = np.zeros(n, bool)
    lots = flat_graph.links(x, graph, np.arange(n), np.ones(n, bool), no if open_ is None else open_, no if audit is None else audit, 0.93)
    return {z for p, q, *_ in lots for z in zip(p.tolist(), q.tolist(), strict=True)}


def test_search_alone_finds_every_link_of_nodes_that_are_not_crowded():
    x = clustered(np.random.default_rng(4), 1200, 16, 0.15)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists, crowded = flat_graph.build(x, 0.93)
    m = x @ x.T >= 0.93
    np.fill_diagonal(m, False)
    got, want = linked(x, flat_graph.with_long_links(lists)), set(zip(*(z.tolist() for z in np.nonzero(m)), strict=True))
    assert got <= want and not crowded.any() and got == want and len(want) > 2000
    # without edges there is no search to speak of, and what it doesn't find is lost
    edgeless = np.full((len(x), 4), -1, np.int64)
    assert len(linked(x, edgeless)) < 0.1 * len(want)
    # a node whose list may have lost some, or an audited one that misses a link, is counted
    some = np.arange(len(x)) % 3 == 0
    assert {p for p in want if some[p[0]]} <= linked(x, edgeless, open_=some)
    assert linked(x, edgeless, audit=np.arange(len(x)) % 64 == 0) == want


def test_crowded_nodes_lose_nothing():
    """Two tight groups that link across: every one's nearest are of its own group."""
    r = np.random.default_rng(7)
    a = r.normal(size=32)
    b = a + 0.33 * r.normal(size=32)
    x = np.concatenate([c + 0.02 * r.normal(size=(90, 32)) for c in (a, b)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = x @ x.T >= 0.93
    np.fill_diagonal(m, False)
    lists, crowded = flat_graph.build(x, 0.93)
    assert crowded.all() and m[:90, 90:].any()
    assert linked(x, flat_graph.with_long_links(lists), open_=crowded) == set(zip(*(z.tolist() for z in np.nonzero(m)), strict=True))


def test_deduplicated_decides_by_row(spark):
    """One id with two unrelated texts, copies without ids, near copies of a text whose id is null."""
    words = [f"word{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(1, "one text about a thing or two and more"), (1, "quite another text that shares not one run of words"), (None, " ".join(words)),
        (None, " ".join(words)), (None, near), (5, "no copy of any other row in this small table"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.deduplicated(docs).collect())
    assert [k for k in kept if k[0]] == sorted(r for r in rows if r[0]) and len(kept) == 5 and (0, "") in kept
    links = sorted((r.doc_id or 0, r.n_links) for r in ngram_join.near_duplicates(docs).collect())
    assert links == [(0, 0), (0, 2), (0, 2), (0, 2), (1, 0), (1, 0), (5, 0)]


def test_pipeline_stages_equal_plain_versions(spark):
    """Each stage on what its predecessor kept, against a plain version of it."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "ngram_jaccard_join", "source_mix", "byte_bpe"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    first = stored(stages["language_id"](spark, docs, sf), "t1")
    found = hyperlang.predict_language(docs, hyperlang.fit_profiles(docs)).collect()
    assert first.schema == docs.schema and ids(first) == sorted(r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_COSINE)

    second = stored(stages["toxicity"](spark, first, sf), "t2")
    scores = toxicity.score_documents(first, toxicity.fit(first, table(spark, sf, "labels"))).collect()
    assert second.schema == docs.schema and ids(second) == sorted(r.doc_id for r in scores if r.score < 0.3)

    third = stored(stages["ngram_jaccard_join"](spark, second, sf), "t3")
    rows = [(r.doc_id, r.text) for r in second.orderBy("doc_id").collect()]
    pairs = np.array(jaccard(rows)).reshape(-1, 2)
    root = ngram_join.roots_of(len(rows), pairs[:, 0], pairs[:, 1])
    assert third.schema == docs.schema and ids(third) == [d for i, (d, _) in enumerate(rows) if root[i] == i] and third.count() < len(rows)

    fourth = stored(stages["source_mix"](spark, third, sf), "t4")
    con = duckdb.connect()
    con.register("documents", third.toArrow())
    copies = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, copies FROM ({mixing.MIX_SQL})").fetchall()}
    assert fourth.schema == docs.schema and ids(fourth) == sorted(d for d, k in copies.items() for _ in range(k))

    last = stages["byte_bpe"](spark, fourth, sf).collect()
    text = {r.doc_id: r.text for r in fourth.collect()}
    assert sorted(r.doc_id for r in last) == ids(fourth)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_pipeline_stages_survive_odd_rows(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        stage(spark, odd, sf).count()
