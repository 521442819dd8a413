"""Phrase collocation mining by HAT-trie counting.

A task counts the phrases of its texts in a ``HatTrie``: a shallow trie of word
ids whose leaves are hash containers. A container holds all phrases of a range
of words; past ``BURST`` entries it bursts, into two ranges, or, if it holds one
word alone, into a node of the next word. When a task holds ``ENTRIES`` phrases,
its largest subtrees are spilled whole, as runs sorted by their words, until
half are gone. Runs leave the task as rows (first words, last word, count); they
are dealt by prefix (a hot prefix is dealt in ``DEAL`` parts by the last word)
and merged there, each partition its own prefixes.

Two counts are made. The first has words and pairs. A phrase of three or four
words occurs no oftener than each pair inside it, so the second counts only
phrases all of whose pairs are frequent, looked up in a bitmap of a fixed size
(2**``BITS`` bits): two pairs that share a bit only cost work, as every count is
exact and what is counted in vain falls to the same bound. Nothing is sampled.

Scores, cuts and what longer phrases cover are joins on (lang, phrase) of the
frequent phrases alone, in whole decimals. The first ``top`` of each language
are found by two rounds of ranks, so no task sorts a whole language.

A null text has no words; a null language is ``und``. Empty texts, and pieces
between two marks, give nothing; very long texts are read whole, one slice of
texts at a time, cut between texts alone. Repeated rows count each. Ties go by
count, then by the bytes of the phrase. An empty table has no result. Extra
columns are not read. Words may be of any characters but the marks, blanks and
line ends that split them; case is folded for A to Z only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import claim, slices, small_batches, stored

MARKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Symbols of a key (a language, a word, a pair of words) are numbered from 1 by the task, below 2**WIDTH.
WIDTH = 21
MASK = (1 << WIDTH) - 1
SHIFTS = (2 * WIDTH, WIDTH, 0)
#: Entries beyond which a container bursts, and which a task holds before it spills; words it numbers before it starts anew.
BURST, ENTRIES, WORDS = 1 << 15, 4_000_000, 1 << 20
#: New keys that a container hashes together at least.
FOLD = 1 << 13
SLICE = 2_000_000
ROWS = 1 << 16
DEAL = 64
BITS = 26
#: Candidates that a task ranks before languages are put together.
RANKED = 50_000

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_mark, _gap = np.zeros(256, bool), np.zeros(256, bool)
_mark[list(MARKS)] = _gap[list(MARKS + BLANKS)] = True


class Container:
    """Keys and their counts, with keys that are not hashed yet."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.keys = np.zeros(0, np.int64) if keys is None else keys
        self.counts = np.zeros(0, np.int64) if counts is None else counts
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(FOLD, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        if self.new:
            keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
            counts = np.concatenate([self.counts, *(c for _, c in self.new)])
            at, self.keys = pd.factorize(keys)
            self.counts = np.zeros(len(self.keys), np.int64)
            np.add.at(self.counts, at, counts)
            self.new, self.held = [], 0

    @property
    def size(self) -> int:
        return len(self.keys) + self.held


class Node:
    """One level of the trie: containers, or nodes of the next symbol, over ranges of this level's symbol."""

    def __init__(self, depth: int, kid: Container | None = None):
        self.depth = depth
        self.cuts = np.zeros(1, np.int64)  # first symbol of each range
        self.kids: list[Container | Node] = [kid or Container()]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(self.kids) == 1:
            self.kids[0].add(keys, counts)
        else:
            at = np.searchsorted(self.cuts, (keys >> SHIFTS[self.depth]) & MASK, "right") - 1
            order = np.argsort(at, kind="stable")
            keys, counts, at = keys[order], counts[order], at[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            for a, b in zip(first, [*first[1:], len(at)], strict=True):
                self.kids[at[a]].add(keys[a:b], counts[a:b])
        for i in range(len(self.kids) - 1, -1, -1):
            if isinstance(self.kids[i], Container) and self.kids[i].size > BURST:
                self.burst(i)

    def burst(self, i: int) -> None:
        kid = self.kids[i]
        kid.fold()
        if kid.size <= BURST:
            return
        symbol = (kid.keys >> SHIFTS[self.depth]) & MASK
        mid = int(np.partition(symbol, len(symbol) // 2)[len(symbol) // 2])
        # what lies before the middle symbol, that symbol, what lies behind it
        parts, cuts = [], []
        for low, mask in ((int(self.cuts[i]), symbol < mid), (mid, symbol == mid), (mid + 1, symbol > mid)):
            if low == mid + 1 and (i + 1 < len(self.cuts) and self.cuts[i + 1] == low):
                continue
            if low == mid and cuts and cuts[-1] == mid:  # the range begins with the middle symbol
                cuts.pop()
                parts.pop()
            part: Container | Node = Container(kid.keys[mask], kid.counts[mask])
            if low == mid and part.size > BURST and self.depth + 1 < len(SHIFTS):
                part = Node(self.depth + 1, part)
                part.burst(0)
            cuts.append(low)
            parts.append(part)
        self.cuts = np.concatenate([self.cuts[:i], cuts, self.cuts[i + 1 :]]).astype(np.int64)
        self.kids[i : i + 1] = parts

    @property
    def size(self) -> int:
        return sum(k.size for k in self.kids)

    def slots(self) -> Iterator[tuple[Node, int]]:
        """Where subtrees hang: containers, and nodes below the first word."""
        for i, k in enumerate(self.kids):
            if isinstance(k, Node) and k.depth < 2:
                yield from k.slots()
            else:
                yield self, i


def held(tree: Container | Node) -> tuple[np.ndarray, np.ndarray]:
    """All keys and counts of a subtree."""
    if isinstance(tree, Container):
        tree.fold()
        return tree.keys, tree.counts
    parts = [held(k) for k in tree.kids]
    return np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


class HatTrie:
    """Counts of keys of three symbols; spills whole subtrees, the largest first."""

    def __init__(self, entries: int = ENTRIES):
        self.root, self.entries = Node(0), entries

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if len(keys):
            self.root.add(keys, np.ones(len(keys), np.int64) if counts is None else counts)

    def full(self) -> bool:
        return self.root.size > self.entries

    def spill(self, all_: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Subtrees, taken out: all of them, or the largest until half of the entries are gone."""
        slots = sorted(self.root.slots(), key=lambda s: -s[0].kids[s[1]].size)
        left = self.root.size
        for node, i in slots:
            if not all_ and left <= self.entries // 2:
                break
            tree, node.kids[i] = node.kids[i], Container()
            left -= tree.size
            if tree.size:
                yield held(tree)


class Numbers:
    """Symbols of a task in order of their first sight, from 1."""

    def __init__(self, kind: pa.DataType):
        self.names = pa.array([], kind)

    def of(self, values: pa.Array) -> np.ndarray:
        """Numbers of distinct values."""
        at = pc.index_in(values, value_set=self.names)
        new = at.is_null()
        fresh = values.filter(new)
        out = pc.fill_null(at, 0).to_numpy().astype(np.int64) + 1
        out[new.to_numpy(zero_copy_only=False)] = len(self.names) + 1 + np.arange(len(fresh))
        self.names = pa.concat_arrays([self.names, fresh])
        return out


def tokens(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts, the piece that each is in (numbered over all texts), and its text."""
    data = "\n".join(t or "" for t in texts).encode()
    raw = _lower[np.frombuffer(data, np.uint8)]
    inside = ~_gap[raw]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(raw) else np.zeros(0, np.int64)
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
    marks = np.flatnonzero(_mark[raw])
    sizes = np.fromiter((len((t or "").encode()) + 1 for t in texts), np.int64, len(texts))
    return words, np.searchsorted(marks, starts), np.searchsorted(sizes.cumsum(), starts, "right")


def digest(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def places(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """A pair's bit in the bitmap, of the digests of its language and words."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F)) ^ lang
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


class Counter:
    """What one task counts: words and pairs, or, given a bitmap of pairs, phrases of three and four words."""

    def __init__(self, pairs: np.ndarray | None, entries: int = ENTRIES):
        self.bitmap, self.entries = pairs, entries
        self.anew()

    def anew(self) -> None:
        self.trie, self.order = HatTrie(self.entries), None
        self.langs, self.words, self.pairs = Numbers(pa.string()), Numbers(pa.string()), Numbers(pa.int64())
        self.hashes = {"langs": np.zeros(1, np.uint64), "words": np.zeros(1, np.uint64)}  # symbols are numbered from 1

    def hashed(self, kind: str) -> np.ndarray:
        names, known = getattr(self, kind).names, self.hashes[kind]
        if len(known) <= len(names):
            fresh = np.fromiter(map(digest, names[len(known) - 1 :].to_pylist()), np.uint64)
            known = self.hashes[kind] = np.concatenate([known, fresh])
        return known

    def add(self, langs: list[str], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        words, piece, text = tokens(texts)
        if not len(words):
            return
        coded = words.dictionary_encode()
        w = self.words.of(coded.dictionary)[coded.indices.to_numpy()]
        spoken = pa.array(langs, pa.string()).dictionary_encode()
        lang = self.langs.of(spoken.dictionary)[spoken.indices.to_numpy()][text]
        joined = piece[1:] == piece[:-1]  # a mark parts texts
        key = (lang << 2 * WIDTH) | (w << WIDTH)
        pair = key[:-1] | w[1:]
        if self.bitmap is None:
            at, one = pd.factorize(key)
            self.trie.add(one, np.bincount(at))
            at, one = pd.factorize(lang)
            self.trie.add(one << 2 * WIDTH, np.bincount(at))  # all words of a language, at its node
            self.trie.add(pair[joined])
        else:
            self.longer(pair, joined, w)
        if self.trie.full():
            for run in self.trie.spill():
                yield from self.rows(*run)
        if max(len(self.words.names), len(self.pairs.names), len(self.langs.names)) > WORDS:
            yield from self.rest()

    def longer(self, pair: np.ndarray, joined: np.ndarray, w: np.ndarray) -> None:
        at, one = pd.factorize(pair[joined])
        lang, first, second = (one >> s & MASK for s in SHIFTS)
        bit = places(self.hashed("langs")[lang], self.hashed("words")[first], self.hashed("words")[second], len(self.bitmap).bit_length() + 2)
        known = (self.bitmap[bit >> 3] >> (bit & 7) & 1).astype(bool)
        number = np.zeros(len(one), np.int64)
        number[known] = self.pairs.of(pa.array(one[known]))
        head = np.zeros(len(pair), np.int64)
        head[np.flatnonzero(joined)] = number[at]
        three = np.flatnonzero((head[:-1] > 0) & (head[1:] > 0))
        self.trie.add(head[three] << 2 * WIDTH | w[three + 2] << WIDTH)
        four = three[:-1][np.diff(three) == 1]
        self.trie.add(head[four] << 2 * WIDTH | w[four + 2] << WIDTH | w[four + 3])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for run in self.trie.spill(all_=True):
            yield from self.rows(*run)
        self.anew()

    def ranked(self) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """All words, the place of each in their order, and all languages; found once for the runs of a spill."""
        if self.order is None or len(self.order[0]) <= len(self.words.names) or len(self.order[2]) <= len(self.langs.names):
            words, langs = (pa.concat_arrays([pa.array([""]), x.names]) for x in (self.words, self.langs))
            rank = np.empty(len(words), np.int64)
            rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            self.order = words, rank, langs
        return self.order

    def rows(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A subtree as a sorted run: lang, head (all words but the last), last, k words, f."""
        words, rank, langs = self.ranked()
        a, b, c = (keys >> s & MASK for s in SHIFTS)
        symbols = [a, b, c]
        if self.bitmap is not None:  # the first symbol is a pair
            pairs = self.pairs.names.to_numpy()[a - 1]
            symbols = [*(pairs >> s & MASK for s in SHIFTS), b, c]
        order = np.lexsort([*(rank[s] for s in reversed(symbols[1:])), symbols[0]])
        for i in range(0, len(order), ROWS):
            part = order[i : i + ROWS]
            lang, *of = (s[part] for s in symbols)
            k = sum((x > 0).astype(np.int32) for x in of)
            texts = [words.take(pa.array(x)) for x in of]
            last, head = texts[0], pa.array([""] * len(part), pa.string())
            for j in range(1, len(of)):  # the head grows word by word, the last word is the last that is there
                there = pa.array(of[j] > 0)
                grown = pc.if_else(pa.array(np.full(len(part), j > 1)), pc.binary_join_element_wise(head, last, " "), last)
                head, last = pc.if_else(there, grown, head), pc.if_else(there, texts[j], last)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), head, last, pa.array(k), pa.array(counts[part])], ["lang", "head", "last", "k", "f"])


RUN = "lang string, head string, last string, k int, f bigint"


def runs(docs: DataFrame, lang_col: str, text_col: str, pairs: np.ndarray | None = None, entries: int = ENTRIES) -> DataFrame:
    """Sorted runs of each task's phrases: one or two words, or, given the bitmap of frequent pairs, three or four."""
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    shared = None if pairs is None else sc.broadcast(pairs)  # of a fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("phrases", lambda: None)
        counter = Counter(None if shared is None else shared.value, entries)
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                yield from counter.add(langs[lo:hi], texts[lo:hi])
        yield from counter.rest()

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col)).mapInArrow(run, RUN)


def merged(found: DataFrame, least: int) -> DataFrame:
    """Runs merged by prefix partition: phrases of at least that count, and each language's number of words (k = 0)."""
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("last"), F.lit(DEAL)).cast("int")).repartition("lang", "head", "deal")
    return dealt.groupBy("lang", "head", "deal", "last", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0)).select("lang",
        F.concat_ws(" ", F.when(F.col("k") > 1, F.col("head")), "last").alias("phrase"), "k", "f")


def bitmap(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits of the frequent pairs. What comes to the driver is bounded by the bits alone: at most 2**(bits - 6) words of 64."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lang = np.asarray([digest(x) for x in b.column(0).to_pylist()], np.uint64)
                two = np.asarray([[digest(w) for w in p.split(" ")] for p in b.column(1).to_pylist()], np.uint64)
                at = places(lang, two[:, 0], two[:, 1], bits)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    set_ = frequent.where("k = 2").select("lang", "phrase").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[set_.column(0).to_numpy()] = set_.column(1).to_numpy()
    return out.view(np.uint8)


def part(first: int | Column, last: int | Column) -> Column:
    """Words first to last (from 1) of the phrase."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut."""
    words = frequent.where("k >= 2").withColumn("words", F.split("phrase", " ")).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = words.select("lang", "phrase", F.col("f").alias("a"), "cut", part(1, F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k")).alias("right"))
    of = frequent.select(F.col("lang").alias("lang2"), F.col("phrase").alias("part"), "f").where("part <> ''")
    cuts = cuts.join(of.withColumnRenamed("f", "l"), (F.col("lang") == F.col("lang2")) & (F.col("left") == F.col("part"))).drop("lang2", "part")
    cuts = cuts.join(of.withColumnRenamed("f", "r"), (F.col("lang") == F.col("lang2")) & (F.col("right") == F.col("part"))).drop("lang2", "part")
    score = F.expr("(2000000BD * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    low = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("c"))
    return low.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")


def covered(frequent: DataFrame) -> DataFrame:
    """lang, phrase, longest: the highest count of a longer phrase that holds the phrase's words one after another."""
    words = frequent.where("k >= 3").withColumn("words", F.split("phrase", " ")).withColumn("at", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("upto",
        F.explode(F.expr("sequence(at + 1, k)")))
    inner = words.where("upto - at + 1 < k").select("lang", part(F.col("at"), F.col("upto")).alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def frequent_phrases(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text", bits: int = BITS, entries: int = ENTRIES) -> DataFrame:
    """lang, phrase, k, f of every phrase of one to four words that occurs that often, and each language's words as k = 0."""
    short = stored(merged(runs(docs, lang_col, text_col, entries=entries), least), "phrases")
    longer = merged(runs(docs, lang_col, text_col, bitmap(short, bits), entries), least)
    return short.unionByName(stored(longer, "phrases"))


def collocations(docs: DataFrame, least: int = 30, cover: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", bits: int = BITS,
    entries: int = ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, those apart that longer ones cover (cover per cent of their count)."""
    frequent = frequent_phrases(docs, least, lang_col, text_col, bits, entries)
    held_by = covered(frequent).withColumnsRenamed({"lang": "lang2", "phrase": "phrase2"})
    gone = F.expr(f"100BD * cast(longest AS decimal(20, 0)) >= {int(cover)}BD * cast(a AS decimal(20, 0))")
    stay = stored(scored(frequent).join(held_by, (F.col("lang") == F.col("lang2")) & (F.col("phrase") == F.col("phrase2")), "left").where(~F.coalesce(gone,
        F.lit(False))).drop("lang2", "phrase2", "longest"), "phrases-scored")
    parts = 1 + stay.count() // RANKED
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    few = stay.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = frequent.where("k = 0").select(F.col("lang").alias("lang2"), F.col("f").alias("n"))
    return first.join(n, F.col("lang") == F.col("lang2")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: All phrases of up to four words counted one by one.
COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*)::BIGINT AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
c AS (SELECT lang, phrase, g, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:c.k]),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(g[i:i + m - 1], ' '))))) AS phrase, f FROM f WHERE k >= 3),
o AS (SELECT lang, phrase, max(f) AS longest FROM h GROUP BY lang, phrase),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE coalesce(100::HUGEINT * longest < 80::HUGEINT * a, true)),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM z)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
