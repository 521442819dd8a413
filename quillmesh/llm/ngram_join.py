"""Near-duplicate join on word 5-grams: MinHash candidates, Bayesian pruning, exact verification.

Words are runs of letters, digits and underscores in lower case; a text's set
holds its runs of five words (its only run, if it has fewer). Documents link
when the Jaccard similarity of their sets is at least 0.8.

1. Texts with the same words are one node (its copies are counted, not paired).
2. 120 MinHash values in 24 bands of 5; a pair that shares a bucket is a
   candidate, owned by the first band it shares, so it is compared once.
   A pair at the threshold shares one with probability 0.9999.
3. A bucket is dealt out in blocks of about 512 nodes, every pair of blocks a
   cell of its own, so that no bucket lands in one task.
4. In a cell, pairs are compared 15 values at a time and dropped once the
   posterior probability (uniform prior) of reaching 0.8 is below 1e-5.
5. What is left is verified on the whole sets. A cell returns sums of links and
   a star of each of its components, never the pairs.

Null and empty texts and those without words link with nothing and are a class
of their own. A row per document comes back: repeated rows too, each counting
the others as links. Null ids link like others; a class has a null class id
only if all its ids are null. Very long texts are read whole. Of a class with
ties for the least id, the text with the least digest stays. An empty table has
no rows. ``deduplicated`` returns all columns, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.graphs import components
from .common import arrow_map, claim, small_batches, stored

GRAM, THRESHOLD = 5, 0.8
VALUES, ROWS, STEP = 120, 5, 15
BANDS = VALUES // ROWS
BLOCK = 512
TOLERANCE = 1e-5
#: Pairs compared at once.
PAIRS = 100_000
#: Bits of the filter of wanted ids: 1 MB, whatever the input.
FILTER_BITS = 1 << 23

find_words = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


def grams(of: list[str], n: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    if not of:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, of), np.uint64, len(of))
    n = min(n, len(of))
    m = len(of) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


@functools.lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240229))
    return r.integers(0, 1 << 31, VALUES, np.uint32)[:, None] * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, VALUES, np.uint32, endpoint=False)[:, None]


def signature(of: np.ndarray) -> np.ndarray:
    """MinHash values, each folded to 16 bits."""
    a, b = permutations()
    h = (of ^ (of >> np.uint64(31))).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        least = np.minimum(least, (a * h[at : at + 2048] + b).min(1))
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (least >> np.uint32(16)).astype("<u2")


@functools.lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step: the fewest agreeing values with which a pair stays.

    With a uniform prior, the similarity given m of n agreements is Beta(m + 1, n - m + 1), whose tail above t is the chance that n + 1 trials with success t have m successes at most.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def row_key(id_: Column, text: Column) -> Column:
    """By which a row is found again: the hash of its id, of its text where that is null. Rows that share one are told apart by their digests."""
    return F.when(id_.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(id_))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, digest of the words (null: none) and signature of every row."""
    small_batches(docs.sparkSession)

    def make():
        claim("ngrams", lambda: None)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            digest, sig = [], []
            for t in b.column(2).to_pylist():
                w = words(t)
                digest.append(xxhash.xxh3_128_digest(" ".join(w)) if w else None)
                sig.append(signature(grams(w)).tobytes() if w else None)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["id", "key", "digest", "sig"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, row_key(F.col(id_col), F.col(text_col)), text_col), make, f"id {kind}, key bigint, digest binary, sig binary")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of about rows rows, cut where all keys change, with a group number for each row; input is sorted by keys."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(table: pa.Table, final: bool) -> tuple[pa.Table | None, np.ndarray, pa.Table | None]:
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        group = change.cumsum()
        last = 0 if table.num_rows == 0 else table.num_rows if final else int(np.flatnonzero(change)[-1]) if change.any() else 0
        return table.slice(0, last), group[:last], table.slice(last)

    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            done, group, rest = cut(pa.Table.from_batches(held), False)
            if done.num_rows:
                yield done, group
            held, count = rest.to_batches(), 0 if done.num_rows else -rest.num_rows
    if held:
        done, group, _ = cut(pa.Table.from_batches(held), True)
        if done.num_rows:
            yield done, group


def pairs_within(group: np.ndarray, part: np.ndarray, split: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, in lots; where split, only rows of different parts."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    count = end - np.arange(n) - 1
    upto = np.concatenate([[0], count.cumsum()])
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        c = count[at:stop]
        left = np.repeat(np.arange(at, stop), c)
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[at:stop] - upto[at], c)
        ok = ~split[left] | (part[left] != part[right])
        yield left[ok], right[ok]
        at = stop


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that this band owns and that pass every comparison."""
    agree = np.zeros(len(left), np.int16)
    for step, least in enumerate(least_matches()):
        part = slice(step * STEP, (step + 1) * STEP)
        agree = agree + (sig[left, part] == sig[right, part]).sum(1, dtype=np.int16)
        keep = agree >= least
        left, right, agree = left[keep], right[keep], agree[keep]
    if len(left):
        same = (sig[left] == sig[right]).reshape(len(left), BANDS, ROWS).all(2)
        keep = same.argmax(1) == band[left]
        left, right = left[keep], right[keep]
    return left, right


def prune(cells: DataFrame) -> DataFrame:
    """Of each cell, the nodes that have a surviving pair: their slot in the cell and the slots of their later partners."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["band", "bucket", "i", "j"], 4_000):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)
            band, part = t.column("band").to_numpy(), t.column("part").to_numpy()
            split = t.column("i").to_numpy() != t.column("j").to_numpy()
            lefts, rights = [], []
            for left, right in pairs_within(group, part, split):
                a, b = survivors(sig, left, right, band)
                lefts.append(a)
                rights.append(b)
            left, right = np.concatenate(lefts), np.concatenate(rights)
            if not len(left):
                continue
            used = np.unique(np.concatenate([left, right]))
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            lo, hi = np.searchsorted(left, used), np.searchsorted(left, used, "right")
            packed = right.astype("<u4")
            out = t.select(["band", "bucket", "i", "j", "digest", "key", "n"]).take(pa.array(used))
            yield from out.append_column("slot", pa.array(used.astype(np.int64))).append_column("later",
                pa.array([packed[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary())).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in ("band", "bucket", "i", "j", "digest", "key", "n"))
    return cells.mapInArrow(run, f"{schema}, slot bigint, later binary")


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    size = np.asarray([len(s) for s in sets])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    if len(a) * size.mean() * 4 < len(sets) ** 2 * len(every) / 40:
        return np.asarray([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    row, out = np.repeat(np.arange(len(sets)), size), np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(every), 8192):
        part = (where >= at) & (where < at + 8192)
        dense = np.zeros((len(sets), min(8192, len(every) - at)), np.float32)
        dense[row[part], where[part] - at] = 1
        out += dense @ dense.T
    return out[a, b].astype(np.int64)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def verify(cells: DataFrame, threshold: float) -> DataFrame:
    """digest, links (copies of verified partners counted) and a root of its part of the component, of each node of each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["band", "bucket", "i", "j"], 2_000):
            digests, links, roots = [], [], []
            digest, texts, later, slot, n = (t.column(c).to_pylist() for c in ("digest", "text", "later", "slot", "n"))
            for rows in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
                of: set[int] = set()
                sets, known = [], []
                for r in rows:
                    w = words(texts[r])
                    if slot[r] not in of and xxhash.xxh3_128_digest(" ".join(w)) == digest[r]:
                        of.add(slot[r])
                        sets.append(grams(w))
                        known.append(r)
                order = np.argsort([slot[r] for r in known]) if known else np.zeros(0, int)
                slots = np.asarray([slot[known[x]] for x in order], np.int64)
                a, b = [], []
                for x, r in enumerate(known):
                    ys = np.frombuffer(later[r], "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(slots, ys), len(slots) - 1)
                    b.append(order[at[slots[at] == ys]])
                    a.append(np.full(len(b[-1]), x))
                a, b = np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)
                if not len(a):
                    continue
                size, both = np.asarray([len(s) for s in sets]), common_counts(sets, a, b)
                keep = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[keep], b[keep]
                copies = np.asarray([n[r] for r in known])
                total = np.bincount(a, copies[b], len(known)) + np.bincount(b, copies[a], len(known))
                root = roots_of(len(known), a, b)
                for x in np.flatnonzero(total):
                    digests.append(digest[known[x]])
                    links.append(int(total[x]))
                    roots.append(digest[known[root[x]]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())],
                ["digest", "links", "root"])

    return cells.mapInArrow(run, "digest binary, links bigint, root binary")


def bit_of(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_BITS)) + 1


def filter_of(keys: DataFrame) -> DataFrame:
    """bucket, bits: a bitmap of keys, which are hashes, in rows of 4 kB, FILTER_BITS / 32768 rows at most. Keys meet by row first, so that a row is built once, not by every task."""
    dealt = keys.select(bit_of(F.col("key")).alias("k")).withColumn("__bucket", F.expr("bitmap_bucket_number(k)")).repartition("__bucket")
    return dealt.groupBy("__bucket").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(k))").alias("__bits"))


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows, which have a key, with a boolean maybe: the key may be one of keys (surely not, where false). The bitmap has a proven bound, so it is broadcast."""
    with_k = rows.withColumn("k", bit_of(F.col("key"))).withColumn("__bucket", F.expr("bitmap_bucket_number(k)")).withColumn("at",
        F.expr("bitmap_bit_position(k)"))
    byte = F.conv(F.hex(F.substring("__bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0, F.lit(False))
    return with_k.join(F.broadcast(filter_of(keys)), "__bucket", "left").select(*rows.columns, hit.alias("maybe"))


def classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and of each node its digest, rep (least id), n, n_links, class_id and whether it is the one its class keeps."""
    seen = stored(sketch(docs, id_col, text_col), "ngram-sketch")
    nodes = stored(seen.where("digest is not null").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.count("*").alias("n"), F.first("sig").alias("sig")), "ngram-nodes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * 2 * ROWS + 1, F.lit(2 * ROWS))))
    banded = nodes.select("digest", F.posexplode(keys).alias("band", "bucket"))
    crowded = banded.groupBy("band", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = banded.join(crowded, ["band", "bucket"]).join(nodes, "digest")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("digest"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = dealt.select("band", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "digest", "key", "n", "sig")
    cell = ["band", "bucket", "i", "j"]
    left = stored(prune(cells.repartition(*cell).sortWithinPartitions(*cell)), "ngram-pruned", small=True)
    some = marked(docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text")), left.select("key").distinct())
    texts = some.where("maybe").select("key", "text").join(left, "key")
    found = stored(verify(texts.select(*cell, "digest", "n", "slot", "later", "text").repartition(*cell).sortWithinPartitions(*cell), threshold),
        "ngram-links", small=True)
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    linked = nodes.select("digest", "rep", "n").join(found.groupBy("digest").agg(F.sum("links").alias("links")), "digest",
        "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    named = linked.select("digest", "rep", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("first"))
    per = named.join(least, "root").select("digest", "rep", "n", "n_links", F.col("first.rep").alias("class_id"),
        (F.col("digest") == F.col("first.digest")).alias("keeper"))
    return seen, per


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of its connected class) and n_links (other documents linked directly) of every row."""
    seen, per = classes(docs, threshold, id_col, text_col)
    worded = seen.where("digest is not null").select("id", "digest").join(per.select("digest", "class_id", "n_links"), "digest")
    return worded.select(F.col("id").alias("doc_id"), "class_id", "n_links").unionByName(seen.where("digest is null")
        .select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def digested(rows: DataFrame) -> DataFrame:
    """Adds the digest of their words (null: none) to rows that have a text."""
    small_batches(rows.sparkSession)
    at = rows.columns.index("text")

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            digest = [xxhash.xxh3_128_digest(" ".join(w)) if (w := words(t)) else None for t in b.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(digest, pa.binary())], [*b.schema.names, "digest"])

        return one

    return arrow_map(rows, make, StructType([*rows.schema, StructField("digest", BinaryType())]))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows, all columns, of one document of each class: that of the least id, any one of rows equal in id and words. Rows that no decision touches are not shuffled."""
    seen, per = classes(docs, threshold, id_col, text_col)
    fate = stored(per.where("n > 1 or n_links >= n").select("digest", "rep", "keeper"), "ngram-fate", small=True)
    keys = seen.where("digest is not null").join(fate.select("digest"), "digest").select("key").distinct()
    some = marked(docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.struct("*").alias("row")), keys)
    touched = digested(some.where("maybe").select("id", F.col("row")[text_col].alias("text"), "row")).drop("text").join(fate, "digest", "left")
    once = touched.where("keeper is null").select("row")
    again = touched.where(F.col("keeper") & F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["digest"]).select("row")
    return some.where("not maybe").select("row").unionByName(once).unionByName(again).select("row.*")


#: The same by joining every word run to itself; for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, coalesce(k, 0)::BIGINT AS n_links
FROM documents LEFT JOIN m ON m.a = doc_id LEFT JOIN k ON k.a = doc_id
"""
