"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone.
An n-gram is bound as the product of its letters' vectors, each permuted by
(rotated by) its distance from the end; a text is the sum (bundle) of its
n-grams, and a language prototype the sum of its texts' unit vectors. A text
gets the language with the largest cosine.

Runs of characters that are no letters count as one gap, letter zero; case is
folded. Texts that are null or hold no letter are ``und`` with score 0. Equal
cosines go to the language that sorts first. Prototypes are fitted on at most
``fit_rows`` labelled documents, those of the least hash; n-gram counts cover
each whole text, in parts of bounded length. Rows that repeat each return. With
an empty table or no labels, every text is ``und``; an empty table has no rows.
Columns beside id, text and the label are never read; ``keep_identified``
returns them, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, claim, crc_fold, small_batches

DIM = 1024
GRAM = 3
#: Texts bundled by one product.
BATCH = 96
FIT_ROWS = 6000
UNKNOWN = "und"
#: N-gram vectors a worker keeps (each DIM bytes); beyond it starts anew.
KEPT = 60_000
#: Distinct n-grams in one product.
WIDTH = 8192
#: Characters of a text in hand at once.
PART = 1_000_000
_WORD = 21  # bits of a code point


@functools.lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point to case-folded letter, 0 where it is no letter."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


@functools.lru_cache(8192)
def letter_vector(code: int, dim: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, dim, np.int8)
    return (2 * bits - 1).astype(np.int8)


def gram_counts(text: str, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, bool]:
    """Packed n-grams of a text, their counts, and whether it has a letter."""
    grams, counts, letters = [], [], False
    tail = np.zeros(0, np.int64)
    for at in range(0, len(text), PART):
        codes = fold_table()[np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = letters or bool(codes.any())
        codes = np.concatenate([tail if at else [0], codes, [0] if at + PART >= len(text) else []]).astype(np.int64)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        tail = codes[-(n - 1) :]
        if len(codes) >= n:
            packed = codes[: len(codes) - n + 1].copy()
            for i in range(1, n):
                packed = packed << _WORD | codes[i : len(codes) - n + 1 + i]
            g, c = np.unique(packed, return_counts=True)
            grams.append(g)
            counts.append(c)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    if len(grams) == 1:
        return grams[0], counts[0], letters
    g, where = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(where, np.concatenate(counts)).astype(np.int64), letters


class Bundler:
    """Bundles texts; remembers bound n-gram vectors within a bound."""

    def __init__(self, dim: int = DIM, n: int = GRAM):
        self.dim, self.n = dim, n
        self.keys = np.zeros(0, np.int64)
        self.rows = np.zeros((0, dim), np.int8)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dim), np.int8)
        for i in range(self.n):
            letters, where = np.unique(grams >> (_WORD * (self.n - 1 - i)) & (1 << _WORD) - 1, return_inverse=True)
            out *= np.stack([np.roll(letter_vector(int(c), self.dim), self.n - 1 - i) for c in letters])[where]
        return out

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bundles (float32, a row a text) and which texts have letters: counts times n-gram vectors, as one product."""
        out, has = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        found = [gram_counts(t or "", self.n) for t in texts]
        for i, (_, _, letters) in enumerate(found):
            has[i] = letters
        size = [len(g) for g, _, _ in found]
        if not sum(size):
            return out, has
        every, where = np.unique(np.concatenate([g for g, _, _ in found]), return_inverse=True)
        row, count = np.repeat(np.arange(len(texts)), size), np.concatenate([c for _, c, _ in found])
        for a in range(0, len(every), WIDTH):
            part = (where >= a) & (where < a + WIDTH)
            dense = np.zeros((len(texts), min(WIDTH, len(every) - a)), np.float32)
            dense[row[part], where[part] - a] = count[part]
            out += dense @ self.vectors(every[a : a + WIDTH])
        return out, has

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A vector for each of some distinct, sorted n-grams."""
        at = np.searchsorted(self.keys, grams)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == grams[known]
        if not known.all():
            if len(self.keys) + len(grams) > KEPT:
                self.keys, self.rows, known = np.zeros(0, np.int64), np.zeros((0, self.dim), np.int8), np.zeros(len(grams), bool)
            new = grams[~known]
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, self.bind(new)])[order]
            at = np.searchsorted(self.keys, grams)
        return self.rows[at].astype(np.float32)


@functools.lru_cache(2)
def bundler(dim: int, n: int) -> Bundler:
    return Bundler(dim, n)


class Profiles:
    """Languages in order and their unit prototypes."""

    def __init__(self, langs: list[str], vectors: np.ndarray, n: int = GRAM):
        self.langs, self.n = langs, n
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        made, has = bundler(self.vectors.shape[1], self.n).bundle(texts)
        norm = np.linalg.norm(made, axis=1)
        cosine = np.round((made @ self.vectors.T) / np.where(norm > 0, norm, 1)[:, None], 6)
        best = cosine.argmax(1)
        score = np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score


def fit_profiles(docs: DataFrame, fit_rows: int = FIT_ROWS, dim: int = DIM, n: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang") -> Profiles:
    """Prototypes from labelled documents of folds 0, 1 and 3, at most fit_rows of each language in expectation.

    What leaves an executor is one vector a language and partition.
    """
    small_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("id")) != 2))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], np.zeros((0, dim)), n)
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, fit_rows / v)))), F.col("lang"))
    picked = known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < share * (1 << 20))

    def sums(batches):
        claim("hyperlang", bundler.cache_clear)
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            for at in range(0, len(texts), BATCH):
                made, has = bundler(dim, n).bundle(texts[at : at + BATCH])
                norm = np.linalg.norm(made, axis=1)
                for v, h, length, lang in zip(made, has, norm, langs[at : at + BATCH], strict=True):
                    if h and length:
                        total[lang] = total.get(lang, 0) + v.astype(np.float64) / length
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    by: dict[str, np.ndarray] = {}
    parts = picked.mapInArrow(sums, "lang string, v array<double>")
    agg = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    for r in agg.collect():  # languages times dim numbers
        by.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    langs = sorted(by)
    return Profiles(langs, np.stack([by[k] for k in langs]) if langs else np.zeros((0, dim)), n)


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row; no shuffle."""
    small_batches(docs.sparkSession)

    def make():
        claim("hyperlang", bundler.cache_clear)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, langs, scores = b.column(1).to_pylist(), [], []
            for at in range(0, len(texts), BATCH):
                x, y = profiles.predict(texts[at : at + BATCH])
                langs += x
                scores.append(y)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """Rows, all columns, whose text has a language at cosine of at least least."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def make():
        claim("hyperlang", bundler.cache_clear)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, keep = b.column(at).to_pylist(), []
            for i in range(0, len(texts), BATCH):
                langs, scores = profiles.predict(texts[i : i + BATCH])
                keep += [x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)]
            return b.filter(pa.array(keep, pa.bool_()))

        return one

    return arrow_map(docs, make, docs.schema)
