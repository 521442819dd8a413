"""Toxicity: boosted trees over dense features, isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon of words
and stems, hits near a second-person word, the densest window, capitals,
punctuation, digits, and obfuscation (look-alike characters of any script,
invisible characters, stretched or spelled-out words). Characters are counted
by their Unicode category.

Labels come from at most ``fit_rows`` labelled documents outside fold 2, those
of the least hash, dealt to ``PARTS`` parts. The lexicon holds words and word
beginnings whose share of toxic texts chance can't explain; each part's
features come from a lexicon of the other parts, and so do the scores that the
calibration sees. Near copies teach the lexicon once (one text a sketch).

Null and empty texts have all-zero features and get the score those have. Very
long texts are read whole, in memory in proportion to the text. Rows that
repeat each get their score; a document labelled more than once is toxic if any
label is; ties of the hash that orders the sample go by the id. An empty table
has no rows, empty labels give every text the same score. Columns beside id and
text are never read by a score; ``keep_clean`` returns them, whatever their
names.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees
from .common import arrow_map, crc_fold, small_batches, stored

#: Labelled rows that the model is fitted on at most, and the parts they are dealt to.
FIT_ROWS = 24_000
PARTS = 4
#: Entries of the lexicon at most, and terms whose exact counts are taken at most.
ENTRIES, CANDIDATES = 4000, 50_000
#: Least log likelihood ratio of an entry: among a million terms, chance alone makes less than one.
EVIDENCE = 14.0
#: Least log odds, against the share of toxic texts, of an entry and of a strong one.
ODDS, STRONG_ODDS = 1.5, 3.5
#: Lengths of word beginnings that may be stems.
STEMS = (4, 5, 6, 7)
LEAST_TEXTS = 5
NEAR = 6
WINDOW = 64
MEMO = 400_000

# Mild insults and hostile words of English, German, French and Spanish.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless trash garbage scum clown disgusting ugly fool fools"
    " jerk creep hate hateful vile filthy imbecile cretin freak lowlife"
    " dumm blöd trottel depp abschaum widerlich hässlich wertlos müll versager"
    " idiote stupide imbécile crétin débile ordure dégoûtant minable nul salaud"
    " idiota estúpido estúpida tonto imbécil basura asqueroso inútil patético escoria".split()
)
# Second-person words of the same languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Characters that stand for letters: digits and signs, then Cyrillic and Greek letters of the same shape.
ALIKE = str.maketrans("013457@$!|" + "асеорхуіѕј" + "αορτνικυε", "oieastasil" + "aceopxyisj" + "aoptvikue")

EDGE = ".,;:!?\"'()[]{}<>«»„“”…*_-~#%&/\\"
LONG = re.compile(r"(.)\1{2,}")
NAMES = [
    "log_words", "seed_rate", "seed_hits", "learned_rate", "learned_hits", "learned_weight", "strong_rate", "strong_hits", "near_rate", "near_hits",
        "second_rate",
    "window_hits", "hidden_rate", "hidden_hits", "mixed_rate", "unseen_rate", "upper_rate", "bang_rate", "question_rate", "mark_rate", "digit_rate",
        "letter_rate", "word_length",
    "repeat_weight", "repeat_hits", "repeat_rate",
]

PLAIN, SECOND_PERSON, LEARNED, STRONG, SEEDED, HIDDEN, SINGLE, MIXED = range(8)
#: Added for words of a stem that counts when several words share it.
REPEAT = 16
OTHER, UPPER, LOWER, LETTER, DIGIT, MARK, UNSEEN, BANG, QUESTION = range(9)
CLASS_OF = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LETTER, "Lm": LETTER, "Nd": DIGIT, "Cf": UNSEEN}


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point; made once in a worker."""
    kinds = (unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1))
    out = np.fromiter((CLASS_OF.get(k, MARK if k[0] in "PS" else OTHER) for k in kinds), np.uint8, sys.maxunicode + 1)
    out[[ord("!"), ord("¡")]], out[[ord("?"), ord("¿")]] = BANG, QUESTION
    return out


@functools.cache
def unseen() -> dict[int, None]:
    """Deletes characters without a shape."""
    return dict.fromkeys(np.flatnonzero(character_classes() == UNSEEN).tolist())


def cut_words(text: str) -> list[str]:
    return text.lower().split()


class Terms:
    """Finds the terms of texts: words, word beginnings (a star behind), and beginnings of two or more different words (two stars)."""

    def __init__(self, among: set[str] | None = None):
        self.among = among
        self.memo: dict[str, list[str]] = {}

    def of_word(self, raw: str) -> list[str]:
        w = raw.strip(EDGE)
        if len(w) < 3 or not w.isalpha():
            return []
        every = [w, *(w[:k] + "*" for k in STEMS if k <= len(w))]
        return every if self.among is None else [t for t in every if t in self.among or t + "*" in self.among]

    def of_text(self, text: str) -> set[str]:
        memo, words = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        lists = []
        for raw in set(cut_words(text)):
            found = memo.get(raw)
            if found is None:
                found = memo[raw] = self.of_word(raw)
            if found and (w := raw.strip(EDGE)) not in words:
                words.add(w)
                lists.append(found)
        n = Counter(itertools.chain.from_iterable(lists))
        out = {*n, *(t + "*" for t, k in n.items() if k > 1 and t[-1] == "*")}
        return out if self.among is None else out & self.among


def sketch(text: str) -> int:
    """The least hash of three words in a row: copies share it, near copies mostly."""
    w = cut_words(text)
    if len(w) < 3:
        return zlib.crc32(" ".join(w).encode())
    return min(map(zlib.crc32, (f"{a} {b} {c}".encode() for a, b, c in zip(w, w[1:], w[2:], strict=False))))


def lexicon_of(rows: list[tuple[str, int, int]], base: float) -> dict[str, float]:
    """The log odds of the terms (term, toxic texts, texts) that stand out surely."""
    found = []
    for term, a, n in rows:
        if a < LEAST_TEXTS or a <= n * base:
            continue
        odds = math.log((a + 0.5) / (n - a + 0.5)) - math.log(base / (1 - base))
        ratio = a * math.log(a / (n * base)) + (n - a) * math.log(max((n - a) / (n * (1 - base)), 1e-300))
        if odds >= ODDS and ratio >= EVIDENCE:
            found.append((-ratio, term, odds))
    return {term: odds for _, term, odds in sorted(found)[:ENTRIES]}


class Features:
    def __init__(self, learned: dict[str, float]):
        self.words = {w: v for w, v in learned.items() if w[-1] != "*"}
        self.stems = {w[:-1]: v for w, v in learned.items() if w[-1] == "*" != w[-2]}
        self.twice = {w[:-2]: v for w, v in learned.items() if w[-2:] == "**"}
        self.repeats: dict[str, tuple[str, str, float]] = {}
        self.memo: dict[str, int] = {}
        self.weights: dict[str, float] = {}
        self.lengths = sorted({len(w) for w in (*SEED, *self.words) if len(w) >= 4})

    def weight(self, word: str) -> float:
        """The largest log odds of a word and its beginnings; 0 for one unknown."""
        stems = self.stems
        return max(self.words.get(word, 0.0), *(stems.get(word[:k], 0.0) for k in STEMS if k <= len(word)), 0.0) if len(word) >= 3 else 0.0

    def listed(self, form: str) -> bool:
        return form in SEED or self.weight(form) >= STRONG_ODDS

    def kind(self, raw: str) -> int:
        word = raw.strip(EDGE)
        if word in SEED:
            return SEEDED
        if word in SECOND:
            return SECOND_PERSON
        if word.isalpha() and (weight := self.weight(word)):
            self.weights[raw] = weight
            return STRONG if weight >= STRONG_ODDS else LEARNED
        if len(word) == 1 and word.isalpha():
            return SINGLE
        if not word or word.isascii() and word.isalpha() and not LONG.search(word):
            return PLAIN
        seen = unicodedata.normalize("NFKC", raw.translate(unseen()))
        bare = "".join(c for c in seen.strip(".,;:?\"'()").translate(ALIKE) if c.isalpha())
        for form in (bare, bare.rstrip("i"), LONG.sub(r"\1", bare), LONG.sub(r"\1\1", bare)):
            if len(form) >= 4 and form != word and self.listed(form):
                return HIDDEN
        mixed = not word.isalpha() and any(c.isalpha() for c in word) and any(not c.isalpha() and c not in "-'’" for c in word)
        return MIXED if mixed else PLAIN

    def stem_of(self, raw: str) -> tuple[str, str, float] | None:
        """The stem of most log odds among those that count when repeated, the word, the odds."""
        w = raw.strip(EDGE)
        found = [(self.twice[w[:k]], w[:k]) for k in STEMS if k <= len(w) and w[:k] in self.twice] if w.isalpha() else []
        return (max(found)[1], w, max(found)[0]) if found else None

    def repeat(self, raw: str) -> int:
        if (found := self.stem_of(raw)) is None:
            return 0
        self.repeats[raw] = found
        return REPEAT

    def row(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        words = cut_words(text)
        memo, kinds = self.memo, bytearray(len(words))
        for i, w in enumerate(words):
            k = memo.get(w)
            if k is None:
                if len(memo) > MEMO:
                    memo.clear()
                    self.weights.clear()
                    self.repeats.clear()
                k = memo[w] = self.kind(w) | self.repeat(w)
            if k:
                kinds[i] = k
        k = np.frombuffer(kinds, np.uint8)
        again = np.flatnonzero(k & REPEAT)
        k = k & (REPEAT - 1)
        n = max(len(words), 1)
        seeds, learned, strong = np.flatnonzero(k == SEEDED), np.flatnonzero((k == LEARNED) | (k == STRONG)), np.flatnonzero(k == STRONG)
        hidden, second = np.flatnonzero(k == HIDDEN), np.flatnonzero(k == SECOND_PERSON)
        spelled = self.spelled(words, np.flatnonzero(k == SINGLE))
        hits = np.unique(np.concatenate([seeds, strong, hidden]))
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        dense = int((np.searchsorted(hits, hits + WINDOW) - np.arange(len(hits))).max()) if len(hits) else 0
        weight = sum(self.weights.get(words[i]) or self.weight(words[i].strip(EDGE)) for i in learned)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.bincount(character_classes()[codes], minlength=9)
        size, letters = len(codes), c[UPPER] + c[LOWER] + c[LETTER]
        dark = len(hidden) + spelled
        forms: dict[str, set[str]] = {}
        odds: dict[str, float] = {}
        for i in again:
            stem, word, v = self.repeats.get(words[i]) or self.stem_of(words[i])
            forms.setdefault(stem, set()).add(word)
            odds[stem] = v
        repeated = [(odds[s], len(f)) for s, f in forms.items() if len(f) > 1]
        return [
            math.log1p(len(words)), len(seeds) / n, math.log1p(len(seeds)), len(learned) / n, math.log1p(len(learned)), weight / n, len(strong) / n,
                math.log1p(len(strong)), near / n, math.log1p(near), len(second) / n,
            dense, dark / n, math.log1p(dark), int((k == MIXED).sum()) / n, c[UNSEEN] / size, c[UPPER] / max(letters, 1), c[BANG] / size, c[QUESTION] / size,
                c[MARK] / size, c[DIGIT] / size, letters / size, size / n,
            max((v for v, _ in repeated), default=0.0), sum(f for _, f in repeated), sum(f for _, f in repeated) / n,
        ]

    def spelled(self, words: list[str], singles: np.ndarray) -> int:
        """Lexicon words spelled out letter by letter, in the whole of each run of single letters."""
        found = 0
        for run in np.split(singles, np.flatnonzero(np.diff(singles) != 1) + 1) if len(singles) >= 4 else []:
            if len(run) >= 4:
                joined = "".join(words[i].strip(EDGE) for i in run)
                found += sum(joined[a : a + n] in SEED or joined[a : a + n] in self.words for n in self.lengths for a in range(len(joined) - n + 1))
        return found

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.asarray([self.row(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


class Model:
    def __init__(self, learned: dict[str, float], trees: Trees, scale: Isotonic):
        self.features, self.trees, self.scale = Features(learned), trees, scale

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.scale.read(self.trees.raw(self.features.matrix(texts)))


def term_counts(sample: DataFrame, among: set[str] | None = None) -> DataFrame:
    """term, part, toxic texts a, texts n; among: of these terms only.

    sample has part, toxic and text. Each task adds up its own texts first; the sample is bounded, and so are its terms.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = Counter(), Counter()
        reader = Terms(among)
        for b in batches:
            for part, toxic, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = [(t, part) for t in reader.of_text(text)]
                sums[0].update(found)
                if toxic:
                    sums[1].update(found)
        keys = list(sums[0])
        columns = [pa.array([t for t, _ in keys]), pa.array([p for _, p in keys], pa.int64()), pa.array([sums[1][k] for k in keys], pa.int64()),
            pa.array([sums[0][k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string()) if not keys else columns[0], *columns[1:]], ["term", "part", "a", "n"])

    return sample.select("part", "toxic", "text").mapInArrow(count, "term string, part bigint, a bigint, n bigint").groupBy("term",
        "part").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))


def learn_lexicons(sample: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The lexicon of all parts, and for each part that of the other ones, from one text of each sketch, that of the least hash.

    A first count, over the toxic texts and as many others, finds the terms worth counting over the whole sample. The
    hashes of the texts, bounded as the sample is, are broadcast.
    """
    sample = sample.where("text is not null")
    sample = sample.join(F.broadcast(sample.groupBy("sketch").agg(F.min("h").alias("h")).select("h")), "h", "left_semi")
    sizes = {r["part"]: (r["n"], r["t"]) for r in sample.groupBy("part").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    n, toxic = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    if not toxic or toxic == n:
        return {}, [{}] * PARTS
    share = F.lit(min(1.0, toxic / (n - toxic)))
    look = sample.where((F.col("toxic") == 1) | (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share * (1 << 20)))
    first = term_counts(look).groupBy("term").agg(F.sum("a").alias("a"),
        F.sum("n").alias("n")).where((F.col("a") >= LEAST_TEXTS) & (F.col("a") >= 2 * (F.col("n") - F.col("a"))))
    among = {r["term"] for r in first.orderBy(F.desc(2 * F.col("a") - F.col("n")), "term").limit(CANDIDATES).collect()}
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in term_counts(sample, among).collect():
        counts.setdefault(r["term"], [(0, 0)] * PARTS)[r["part"]] = (r["a"], r["n"])

    def without(part: int) -> dict[str, float]:
        of = [k for k in range(PARTS) if k != part]
        base = (sum(sizes.get(k, (0, 0))[1] for k in of) + 0.5) / (sum(sizes.get(k, (0, 0))[0] for k in of) + 1)
        return lexicon_of([(t, sum(c[k][0] for k in of), sum(c[k][1] for k in of)) for t, c in counts.items()], base)

    return without(-1), [without(k) for k in range(PARTS)]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most fit_rows labelled documents; their ids, so bounded, are broadcast."""
    small_batches(docs.sparkSession)
    tasks = max(2, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = known.where(crc_fold(F.col("__id")) != 2).withColumn("h", F.xxhash64(F.col("__id").cast("string"))).orderBy("h", "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")
    rows = rows.select("h", F.pmod("h", F.lit(PARTS)).alias("part"), "toxic", "text").repartition(tasks, "h")

    def sketched():
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array([sketch(t or "") for t in b.column(3).to_pylist()], pa.int64())],
            ["h", "part", "toxic", "text", "sketch"])

    sample = stored(arrow_map(rows, sketched, "h bigint, part bigint, toxic int, text string, sketch bigint"), "toxic-sample", small=True)
    learned, others = learn_lexicons(sample)

    def make():
        of = [Features(x) for x in others]

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            x = [of[k].row(t) for k, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["part", "toxic", "x"])

        return one

    got = arrow_map(sample, make, "part bigint, toxic int, x array<double>").toArrow()
    x = np.asarray(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, len(NAMES))
    y, part = got.column("toxic").to_numpy().astype(float), got.column("part").to_numpy()
    order = np.lexsort((*x.T, y, part))  # whatever order the tasks ended in
    x, y, part = x[order], y[order], part[order]
    raw = np.zeros(len(y))
    for k in range(PARTS):
        raw[part == k] = Trees().fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(learned, Trees().fit(x, y), Isotonic().fit(raw, y))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row; no shuffle."""
    small_batches(docs.sparkSession)

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(b.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows, all columns, that score under the threshold."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def make():
        return lambda b: b.filter(pa.array(model.score(b.column(at).to_pylist()) < threshold))

    return arrow_map(docs, make, docs.schema)
