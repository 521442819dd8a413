"""Hard negatives and sharding against brute force."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import hard_negatives, sharding

VECTORS = "vec_id bigint, embedding array<double>, label int, score double, aid string"
EVERY = "vec_id % 5 = 0"


def plain(rows, positives=5, negatives=3):
    """rows: (id, vector of numbers, label)."""
    whole = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows]
    out = []
    for i, v, c in whole:
        if i % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, w, d in whole if j != i)
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            inside = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(seed, n, dim, labels=3, grid=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x = np.round(x * grid) / grid if grid else x  # a coarse grid makes ties
    return [(i, x[i].tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "labels", "grid", "shard", "block"), [(200, 8, 3, None, 4096, 2048), (200, 2, 3, 2, 30, 7), (150, 3, 60, 1, 16, 8), (90, 4, 1, 4, 20, 5)])
def test_hard_negatives_equal_brute_force(spark, n, dim, labels, grid, shard, block):
    """Several shards and blocks, many ties, labels of few rows, one label alone."""
    rows = vectors(n, n, dim, labels, grid)
    df = spark.createDataFrame([(*x, 0.5, "clash") for x in rows], VECTORS)
    got = hard_negatives.hard_negatives(df, F.expr(EVERY), shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(2, 40, 3, 2, 3)
    odd = [(None, [1.0, 1.0, 1.0], 0), (100, None, 0), (105, [nan, 1.0, 1.0], 0), (110, [inf, 1.0, 1.0], 1), (115, [None, 1.0, 1.0], 1), (120, [1.0, 1.0, 1.0], None),
        (125, [1.0, 1.0], 0), (130, [], 1)]
    df = spark.createDataFrame([(*x, None, None) for x in good + odd], VECTORS)
    got = hard_negatives.hard_negatives(df, F.expr(EVERY), shard=10)
    assert sorted(map(tuple, got.collect())) == plain(good)
    zero = [(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, -1.0], 1), (3, [5.0, 1.0], 1), (5, [-1.0, 0.0], 0)]
    df = spark.createDataFrame([(*x, None, None) for x in zero], VECTORS)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.expr(EVERY)).collect())) == plain(zero)
    twice = [(i, v, c) for i, v, c in good for _ in range(1 + (i % 5 == 1))]
    df = spark.createDataFrame([(*x, None, None) for x in twice], VECTORS)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.expr(EVERY), shard=9).collect())) == plain(twice)
    assert hard_negatives.hard_negatives(df.limit(0), F.expr(EVERY)).count() == 0 and hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e18, 1.0], 1, None, None)], VECTORS), F.expr(EVERY))


def test_threshold_stops_early_where_it_can():
    """Rows far along few directions: an anchor scores few of them, and finds the same as all would give."""
    r = np.random.default_rng(1)
    x = np.floor(256 * r.pareto(1.5, (4000, 4))).astype(np.int64)
    lists = hard_negatives.Lists(x, np.arange(4000), [i % 2 for i in range(4000)])
    for a in range(0, 40, 2):
        s = x @ x[a]
        same = [i for i in np.lexsort((np.arange(4000), -s)) if i % 2 == 0 and i != a][:5]
        assert lists.positives(x[a], a, 0, 5)[0].tolist() == same
    scored = [lists.descend(x[a], lists.of(0), lambda _, s: np.partition(s, -5)[-5] if len(s) >= 5 else -np.inf)[2] for a in range(40)]
    assert np.median(scored) < 600


def test_large_components_are_exact():
    """Beyond 53 bits whole numbers take the place of doubles."""
    x = np.asarray([[1 << 28, 1], [1 << 28, 0], [(1 << 28) - 1, 5]], np.int64)
    lists = hard_negatives.Lists(x, np.arange(3), [0, 0, 0])
    ids, s = lists.positives(x[0], 0, 0, 2)
    assert lists.x.dtype == np.int64 and ids.tolist() == [1, 2] and s.tolist() == [1 << 56, (1 << 56) - (1 << 28) + 5]


DOCS = "doc_id bigint, text string, source string, size string, row string"


def check_shards(rows, got, shards):
    """Laws of a sharding: one row each, counts at most one apart, slots without gaps, each source's share to within two rows."""
    digest = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, *digest(t)) for i, t, _ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == min(shards, len(rows))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= (len(rows) % shards > 0)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_shards_have_the_mixture(spark):
    """A hot source, small ones, one without a name; copies; reruns agree however the rows lie."""
    r = np.random.default_rng(3)
    sources = ["hot"] * 500 + ["mid"] * 160 + [None] * 90 + ["small"] * 7 + [f"one{i}" for i in range(64)]
    rows = [(i if i % 50 else None, "same text" if i % 3 == 0 else f"text é {i}", s) for i, s in enumerate(sources)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], DOCS)
    got = sharding.sharded(df).collect()
    check_shards(rows, got, 16)
    again = sharding.sharded(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, sharding.sharded(df, seed=1).collect()))
    full = sharding.placed(sharding.read(df, 0, "doc_id", "text", "source"), 16, 0, ["doc_id"]).collect()
    counts, size = collections.Counter((x.s, x.shard) for x in full), collections.Counter(sources)
    assert all(abs(counts[s, k] - n / 16) < 2 for s, n in size.items() for k in range(16))
    assert r is not None and len({x.shard for x in full if (x.s or "").startswith("one")}) >= 12


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame([(*x, "kept", "too") for x in rows], DOCS)
    out = sharding.written(df, f"file://{tmp_path}/shards", shards=4, files=2)
    place = {(x.row.doc_id): (x.shard, x.slot) for x in out.collect()}
    assert place == {x.doc_id: (x.shard, x.slot) for x in sharding.sharded(df, 4).collect()}
    assert out.where("row.size = 'kept' AND row.row = 'too'").count() == 300


def test_shards_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    check_shards(rows, sharding.sharded(odd).collect(), 16)
    assert sharding.sharded(none).count() == 0
