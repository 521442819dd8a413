"""Similar sets met block by block, against brute force; what is shuffled grows with sets, not with pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import joins, overlaps


def shuffled(spark):
    """Bytes that all stages of the session have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def near_sets(r, classes, size, tokens):
    """Sets of very different sizes, some of them near copies of others."""
    out = []
    for _ in range(classes):
        one = set(r.integers(0, tokens, int(r.integers(1, size))).tolist())
        out.append(one)
        for _ in range(int(r.integers(0, 3))):
            out.append({x for x in one if r.random() > 0.15} | set(r.integers(0, tokens, len(one) // 8).tolist()) or {0})
    return [sorted(s) for s in out]


@pytest.mark.parametrize("small, held", [(40, 50), (400, 1000), (100_000, 2_000_000)])
def test_blocks_find_every_pair_once(spark, monkeypatch, small, held):
    sets = near_sets(np.random.default_rng(small), 60, 90, 300)
    want = {(a, b): j for a in range(len(sets)) for b in range(a + 1, len(sets)) if (j := len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))) >= 0.65}
    monkeypatch.setattr(overlaps, "SMALL", small)
    monkeypatch.setattr(overlaps, "LARGE", small)
    df = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(sets)], "id int, tokens array<string>")
    got = joins.jaccard_pairs(df, 0.65).collect()
    assert len(got) == len(want) > 20 and {(x.a, x.b): x.jaccard for x in got} == want
    # lots of a few meetings each find the same
    monkeypatch.setattr(overlaps, "HELD", held)
    different = [list(s) for s in sorted({tuple(s) for s in sets}, key=len)]
    rank = {t: i for i, t in enumerate(sorted({x for s in different for x in s}, key=lambda x: (sum(x in s for s in different), x)))}
    import pyarrow as pa

    block = overlaps.Block(pa.table({"set": [str(i) for i in range(len(different))], "n": [len(s) for s in different], "x": [sorted(rank[x] for x in s) for s in different]}), 0.65)
    pairs = set()
    for u, v in overlaps.meetings(block, block, True, 0.65):
        ok = overlaps.shared(block, block, u, v) >= overlaps.needed(block.n[u], block.n[v], 0.65)
        assert not pairs & set(zip(u[ok].tolist(), v[ok].tolist(), strict=True))
        pairs |= set(zip(u[ok].tolist(), v[ok].tolist(), strict=True))
    assert pairs == {(a, b) for a in range(len(different)) for b in range(a + 1, len(different))
        if len(set(different[a]) & set(different[b])) / len(set(different[a]) | set(different[b])) >= 0.65}


def test_large_sets_with_rare_tokens_in_common_are_not_shuffled_pair_by_pair(spark):
    """Any two of 200 sets of 1,000 tokens share four rare ones and are unlike: whole sets sent for each of 19,900 pairs are some 100 MB."""
    r = np.random.default_rng(3)
    rare = [[f"r{g}-{r.integers(0, 2)}" for g in range(8)] for _ in range(200)]
    sets = [(i, [*x, *(f"own{i}-{k}" for k in range(300)), *(f"c{k}" for k in r.permutation(2000)[:692])]) for i, x in enumerate(rare)]
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the sets are too many to broadcast
    try:
        got = joins.jaccard_pairs(spark.createDataFrame(sets, "id int, tokens array<string>"), 0.65)
        assert got.agg(F.count("*")).first()[0] == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 20_000_000
