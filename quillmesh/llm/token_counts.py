"""Token counts by overlap resynchronisation.

Texts of more than a chunk are cut into chunks that overlap; each chunk is
encoded with offsets, and neighbours are spliced at a boundary that both
encodings share and that is proven stable: the end of a word of the left chunk,
far enough from its cut, at which a word of the right chunk ends too, with as
many pieces of that end (a character that lower case or composition expands may
end several), all of which go to the left. The
tokenizer's words never look back, so the tokens of the right chunk from there
on are those of the whole text. When an overlap has no such boundary, it is
doubled until one is found or the text ends. Texts of a chunk or less are
encoded whole.

A chunk of a word tokenizer is encoded by its words between spaces, which a
worker remembers; runs without a space that are longer than ``LONG_WORD`` go to
the library with offsets, so that they too can be cut inside. A sentencepiece
chunk is encoded with offsets, and boundaries are spaces between two words.

Null and empty texts have no tokens; rows are never dropped, repeated rows each
return. Very long texts cost memory for their own length and for one chunk at a
time (more only where no boundary turns up). An empty table has no rows. Extra
columns are not read.
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, claim, slices, small_batches
from .token_files import parted, words

CHUNK_CHARS = 4096
OVERLAP_CHARS = 256
#: A left chunk's word that ends this near to its cut may go on behind it.
GUARD_CHARS = 8
LONG_WORD = 512


class Chunk(NamedTuple):
    """Pieces of an encoded chunk, in order: where each ends in the text, how many tokens it and all before it have, and whether its end is a word's."""

    ends: np.ndarray
    tokens: np.ndarray
    sure: np.ndarray

    def total(self, pieces: int) -> int:
        return int(self.tokens[pieces - 1]) if pieces else 0


def splice(left: Chunk, right: Chunk, cut: int, left_end: int, base: int) -> tuple[int, int] | None:
    """Pieces of left before, and of right up to, the first proven common boundary behind the cut."""
    ok = left.sure & (left.ends > cut) & (left.ends <= left_end - GUARD_CHARS)
    ok[:base] = False
    for end in np.unique(left.ends[ok]):
        # a character that the normaliser expands gives several pieces of one end: all of them, or the boundary isn't common
        a, i = np.searchsorted(left.ends, end, "left"), np.searchsorted(left.ends, end, "right")
        b, j = np.searchsorted(right.ends, end, "left"), np.searchsorted(right.ends, end, "right")
        if i - a == j - b and left.sure[i - 1] and right.sure[j - 1]:
            return int(i), int(j)
    return None


def spliced_count(text: str, encode, chunk: int, overlap: int) -> tuple[int, int, int]:
    """Tokens of a text of more than a chunk, the splices it took, and how often an overlap was widened. encode(start, end) gives the Chunk of that part."""
    total = start = base = splices = widened = 0  # base: first piece of the chunk at start that still counts
    end = min(len(text), chunk + overlap)
    left = encode(start, end)
    while end < len(text):
        cut, wide = start + chunk, overlap
        right_end = min(len(text), cut + chunk + overlap)
        right = encode(cut, right_end)
        while (at := splice(left, right, cut, end, base)) is None and end < len(text):
            wide, widened = wide * 2, widened + 1
            end = min(len(text), cut + wide)
            left = encode(start, end)
            if right_end < end:
                right_end = end
                right = encode(cut, right_end)
        if at is None:  # the left chunk reached the end of the text
            break
        total += left.total(at[0]) - left.total(base)
        base, left, start, end, splices = at[1], right, cut, right_end, splices + 1
    return total + left.total(len(left.ends)) - left.total(base), splices, widened


class JsonTokens:
    """A tokenizers file. Where its words are those that a chunk can be cut at, long texts are spliced; others are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.words = words(path)
        self.splits = self.words.bare is not None

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(ids) // self.words.dtype.itemsize for ids in self.words.encode(texts)]

    def chunk(self, text: str, start: int, end: int) -> Chunk:
        """By words between spaces; a long run without a space by the library's tokens."""
        parts = parted(text[start:end])
        short = [w for w in parts if len(w) <= LONG_WORD]
        self.words.remember([short])
        memo, item = self.words.memo, self.words.dtype.itemsize
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        if len(short) == len(parts):
            n = np.fromiter((len(memo[w]) for w in parts), np.int64, len(parts)) // item
            return Chunk(start + size.cumsum() + np.arange(len(parts)), n.cumsum(), np.ones(len(parts), bool))
        ends, tokens, sure, at = [], [], [], start
        for w in parts:
            if len(w) <= LONG_WORD:
                ends.append(at + len(w))
                tokens.append(len(memo[w]) // item)
                sure.append(True)
            else:
                e = self.lib.encode(text[at : at + len(w)], add_special_tokens=False)
                ends += [at + b for _, b in e.offsets]
                tokens += [1] * len(e.ids)
                sure += self.words.ends[np.asarray(e.ids, np.int64)].tolist()
            at += len(w) + 1
        return Chunk(np.asarray(ends, np.int64), np.asarray(tokens, np.int64).cumsum(), np.asarray(sure, bool))

    def count_long(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
        """Tokens, splices, and how often an overlap was widened."""
        if not self.splits:
            return self.counts([text])[0], 0, 0
        return spliced_count(text, lambda a, b: self.chunk(text, a, b), chunk, overlap)


class PieceTokens:
    """A sentencepiece model; no piece spans the space between two words, so encodings agree from there on."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode(texts, num_threads=1)]

    def chunk(self, text: str, start: int, end: int) -> Chunk:
        part = text[start:end]
        begins = np.asarray([p.begin for p in self.lib.encode(part, return_type="proto").pieces], np.int64)
        starts = np.fromiter((c & 0xC0 != 0x80 for c in part.encode()), bool)  # bytes that begin a character
        ends = np.append(begins[1:], len(starts)) if len(begins) else begins
        at = np.concatenate([[0], starts.cumsum()])[ends]
        # a piece's end is sure where a space follows between two letters or digits
        sure = [0 < i < len(part) - 1 and part[i] == " " and part[i - 1].isalnum() and part[i + 1].isalnum() for i in at.tolist()]
        return Chunk(start + at, np.arange(1, len(at) + 1), np.asarray(sure, bool))

    def count_long(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
        if not self.splits:
            return self.counts([text])[0], 0, 0
        return spliced_count(text, lambda a, b: self.chunk(text, a, b), chunk, overlap)


@functools.lru_cache(4)
def load(path: str):
    return PieceTokens(path) if path.endswith(".model") else JsonTokens(path)


def count_all(texts: list[str | None], path: str) -> list[int]:
    lib, out = load(path), [0] * len(texts)
    short = [i for i, t in enumerate(texts) if t and len(t) <= CHUNK_CHARS]
    for a, b in slices([texts[i] for i in short]):
        for i, n in zip(short[a:b], lib.counts([texts[i] for i in short[a:b]]), strict=True):
            out[i] = n
    for i, t in enumerate(texts):
        if t and len(t) > CHUNK_CHARS:
            out[i] = lib.count_long(t)[0]
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle."""
    small_batches(docs.sparkSession)

    def make():
        claim("words", lambda: (words.cache_clear(), load.cache_clear()))

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            n = np.asarray(count_all(texts, tokenizer), np.int64)
            size = np.asarray([len(t.encode()) if t else 0 for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
