"""Vectors without clusters: shards would overlap in most of their members, so blocks of the whole label meet instead."""

from __future__ import annotations

import numpy as np

from quillmesh.llm import flat_graph, ngram_join


def shuffled(spark):
    """Bytes that all stages of the session have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_scattered_vectors_are_copied_once_a_block(spark, monkeypatch):
    """1,200 vectors in 12 blocks. With 20 centroids each joins nearly all shards, each of them of as many blocks: some 200 copies, 16 MB."""
    monkeypatch.setattr(flat_graph, "SHARD", 60)
    monkeypatch.setattr(flat_graph, "BLOCK", 100)
    r = np.random.default_rng(5)
    x = r.normal(size=(1200, 64)).astype(np.float32)
    x[::10] = x[1::10] + (0.2 * r.normal(size=(120, 64))).astype(np.float32)
    before = shuffled(spark)
    got = flat_graph.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).toPandas().sort_values("vec_id")
    assert shuffled(spark) - before < 6_000_000
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    m = u @ u.T >= 0.93
    np.fill_diagonal(m, False)
    assert m.sum() > 200 and got.n_links.tolist() == m.sum(1).tolist()
    assert got.component_id.tolist() == ngram_join.roots_of(len(x), *np.nonzero(m)).tolist()


def test_centroids_stay_where_they_divide():
    r = np.random.default_rng(6)
    centres = np.linalg.qr(r.normal(size=(64, 8)))[0].T
    tight = np.repeat(centres, 500, 0) + 0.01 * r.normal(size=(4000, 64))
    loose = r.normal(size=(4000, 64))
    for x, want in ((tight, True), (loose, False)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert flat_graph.worthwhile(x, 100_000, flat_graph.spherical_means(x, 8), 0.93) is want
