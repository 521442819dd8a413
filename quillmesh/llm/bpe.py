"""Byte-level BPE by a segment tree over byte positions.

Leaf i holds the rank of the pair that starts at live node i (none: NONE);
inner nodes hold the smaller of their children, so the root holds the least
rank and a walk that prefers the left child ends at the leftmost pair that has
it. A merge rewrites three leaves (the merged node, the node it swallowed, its
left neighbour) and their paths: logarithmic work each.

Pieces up to WIDE bytes are merged many at a time, one tree per row of an
array; longer ones one by one. Pieces that are themselves in the vocabulary
are one token. Equal ranks merge leftmost first.

Null and empty texts have no ids, and the digest of none. Very long texts are
encoded whole, in lots of pieces; a single piece of many megabytes is one tree
in flat arrays. Rows that repeat each return. An empty table has no rows. Extra
columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, claim, slices, small_batches

NONE = np.int32(2**31 - 1)
WIDE = 64
#: Pieces a worker remembers; beyond it starts anew.
MEMO = 200_000


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.asarray(keys, np.int64))
        self.pairs = np.append(np.asarray(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.asarray(values, np.int32)[order], NONE)
        self.of_pair = dict(zip(keys, values, strict=True))
        self.byte = np.asarray([ranks[bytes([i])] for i in range(256)], np.int64)

    @classmethod
    @functools.lru_cache(4)
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the vocabulary has no such token."""
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)


def packed(kind: str, values: np.ndarray) -> array:
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, np.dtype(kind)).tobytes())
    return out


class Tree:
    """One piece of any length, in flat arrays: some 30 bytes for each of the piece's."""

    def __init__(self, piece: bytes, v: Vocabulary):
        n = len(piece)
        self.width = 1 << max(1, (n - 1).bit_length())
        token = v.byte[np.frombuffer(piece, np.uint8)].astype(np.int64)
        least = np.full(2 * self.width, NONE, np.int32)
        least[self.width : self.width + n - 1] = v.rank(token[:-1], token[1:])
        level = self.width
        while level > 1:
            np.minimum(least[level : 2 * level : 2], least[level + 1 : 2 * level : 2], out=least[level // 2 : level])
            level //= 2
        self.v, self.n = v, n
        self.token, self.least = packed("i", token), packed("i", least)
        self.next, self.prev = packed("q", np.arange(1, n + 1)), packed("q", np.arange(-1, n - 1))

    def put(self, i: int, rank: int) -> None:
        least, i = self.least, i + self.width
        least[i] = rank
        i >>= 1
        while i:
            now = min(least[2 * i], least[2 * i + 1])
            if now == least[i]:
                break
            least[i] = now
            i >>= 1

    def pair(self, i: int) -> int:
        j = self.next[i]
        return int(NONE) if j >= self.n else self.v.of_pair.get(self.token[i] << 32 | self.token[j], int(NONE))

    def merged(self) -> list[int]:
        least, none = self.least, int(NONE)
        while (rank := least[1]) != none:
            i = 1
            while i < self.width:
                i = 2 * i + (least[2 * i] > least[2 * i + 1])
            i -= self.width
            j = self.next[i]
            self.token[i], self.next[i] = rank, self.next[j]
            if self.next[j] < self.n:
                self.prev[self.next[j]] = i
            self.put(j, none)
            self.put(i, self.pair(i))
            if self.prev[i] >= 0:
                self.put(self.prev[i], self.pair(self.prev[i]))
        out, i = [], 0
        while i < self.n:
            out.append(self.token[i])
            i = self.next[i]
        return out


def merge_many(pieces: list[bytes], width: int, v: Vocabulary) -> list[np.ndarray]:
    """The same for pieces of 2 to width bytes, a tree in each row."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    spot = np.arange(width)
    live = spot < size[:, None]
    token = np.where(live, v.byte[raw], -1)
    after = np.tile(spot + 1, (n, 1))
    before = np.tile(spot - 1, (n, 1))
    least = np.full((n, 2 * width), NONE, np.int32)
    paired = spot[:-1] < size[:, None] - 1
    first = np.full((n, width - 1), NONE, np.int32)
    first[paired] = v.rank(token[:, :-1][paired], token[:, 1:][paired])
    least[:, width : 2 * width - 1] = first
    for i in range(width - 1, 0, -1):
        np.minimum(least[:, 2 * i], least[:, 2 * i + 1], out=least[:, i])
    rows = np.flatnonzero(least[:, 1] != NONE)

    def put(r: np.ndarray, i: np.ndarray, rank: np.ndarray | np.int32) -> None:
        i = i + width
        least[r, i] = rank
        while i.size and i[0] > 1:
            i = i >> 1
            least[r, i] = np.minimum(least[r, 2 * i], least[r, 2 * i + 1])

    def pair(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[r, i]
        ok = j < size[r]
        out = np.full(len(r), NONE, np.int32)
        out[ok] = v.rank(token[r[ok], i[ok]], token[r[ok], j[ok]])
        return out

    while rows.size:
        rank, i = least[rows, 1], np.ones(rows.size, np.int64)
        for _ in range(width.bit_length() - 1):
            i = 2 * i + (least[rows, 2 * i] > least[rows, 2 * i + 1])
        i -= width
        j = after[rows, i]
        k = after[rows, j]
        token[rows, i], after[rows, i] = rank, k
        token[rows, j] = -1
        inside = k < size[rows]
        before[rows[inside], k[inside]] = i[inside]
        put(rows, j, NONE)
        put(rows, i, pair(rows, i))
        h = before[rows, i]
        left = h >= 0
        put(rows[left], h[left], pair(rows[left], h[left]))
        rows = rows[least[rows, 1] != NONE]
    keep = token >= 0
    ends = np.cumsum(keep.sum(1))
    return np.split(token[keep].astype("<u4"), ends[:-1])


def encode_pieces(pieces: Iterable[bytes], v: Vocabulary) -> dict[bytes, bytes]:
    """Little-endian 32-bit ids of each piece."""
    out: dict[bytes, bytes] = {}
    classes: dict[int, list[bytes]] = {}
    for p in pieces:
        if not p:
            out[p] = b""
        elif (rank := v.ranks.get(p)) is not None:
            out[p] = rank.to_bytes(4, "little")
        elif len(p) > WIDE:
            out[p] = np.asarray(Tree(p, v).merged(), "<u4").tobytes()
        else:
            classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(p)
    for width, of in classes.items():
        for at in range(0, len(of), 2048):
            part = of[at : at + 2048]
            out |= {p: ids.tobytes() for p, ids in zip(part, merge_many(part, width, v), strict=True)}
    return out


class Codec:
    """Encodes whole texts, each match of the pattern separately, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.v, self.split, self.memo = Vocabulary.load(path), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.memo) + len(wanted) > MEMO:
            self.memo.clear()
        missing = [p for p in wanted if p not in self.memo]
        ids = encode_pieces({p.encode() for p in missing}, self.v)
        self.memo.update((p, ids[p.encode()]) for p in missing)
        return [b"".join(map(self.memo.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and decoded bytes of every row; no shuffle."""
    return _coded(docs, ranks, pattern, id_col, text_col, "ids binary, decoded binary", lambda ids, back: (ids, back))


def code_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with lowercase hex SHA-256 of ids and decoded bytes in their place."""
    return _coded(docs, ranks, pattern, id_col, text_col, "ids_sha256 string, decoded_sha256 string", lambda ids,
        back: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))


def coded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids together with both digests."""
    return _coded(docs, ranks, pattern, id_col, text_col, "ids binary, ids_sha256 string, decoded_sha256 string", lambda ids,
        back: (ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))


def _coded(docs: DataFrame, ranks: str, pattern: str, id_col: str, text_col: str, columns: str, digest) -> DataFrame:
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", *(c.split()[0] for c in columns.split(", "))]
    kinds = [pa.binary() if "binary" in c else pa.string() for c in columns.split(", ")]

    def make():
        c = codec(ranks, pattern)
        claim("bpe", lambda: (codec.cache_clear(), c.memo.clear()))

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, rows = [], []
            for a, z in slices(texts):
                for ids in c.encode(texts[a:z]):
                    n.append(len(ids) // 4)
                    rows.append(digest(ids, c.decode(ids)))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()),
                *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, n_tokens bigint, {columns}")
