"""Flat token files: unsigned integers, 64-bit document offsets, memory maps.

A shard is a run of documents in ascending id order, three files beside each
other in the shared folder:

* ``.bin`` the ids, little-endian uint16 where the vocabulary fits, else uint32
* ``.off`` n + 1 little-endian 64-bit offsets of its documents, in ids
* ``.doc`` n little-endian 64-bit document ids, then n bytes: 1 where not null

Shards are written in parallel under names that no other attempt shares; only
those that the manifest names count, so a lost executor's rerun can't mix with
its first attempt. A shard's base, the number of ids before it, is a prefix sum
over the manifest (one row a shard).

Words between spaces and line ends are encoded once and remembered: the
tokenizer collapses white space and its words never span it, so a text's ids
are those of its parts. Null and empty texts hold just the end id; null
document ids come first; repeated rows each return, and documents of equal id
lie beside each other in no fixed order unless their texts are equal too. Very
long texts are written whole; a shard is as long as its documents. An empty
table has no files and no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .common import claim, scratch_path, slices, small_batches

#: Words a worker remembers; beyond it starts anew.
MEMO = 1_500_000


#: Marks that, behind a run of letters, are a piece of their own.
MARKS = ".,;:!?"
#: The pieces into which the tokenizer may part a text for the short way to hold.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte to character, as byte-level vocabularies write them: bytes without a print form follow from 256 on.
BYTE_CHARS = {b: b for b in _kept} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_kept))}


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def bare(path: str):
    """The merges alone, for lower-case letters already written as byte characters; None where the tokenizer is of another kind."""
    from tokenizers import Tokenizer

    with open(path) as f:
        spec = json.load(f)
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    fits = (
        spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in parts] == ["Split",
            "ByteLevel"] and parts[0]["pattern"] == {"Regex": PIECES} and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    )
    if not fits:
        return None
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None,
        "decoder": None}))


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.dtype = np.dtype("<u2" if max(self.lib.get_vocab().values()) < 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.ends = np.zeros(max(self.lib.get_vocab().values()) + 1, bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        special = [i for i, t in sorted(self.lib.get_added_tokens_decoder().items()) if t.special and t.content.startswith("<|") and not t.normalized]
        self.mark = special[0] if special else None

        self.bare = bare(path)

    def learn(self, words: list[str]) -> None:
        """Words of letters, with or without marks behind them, go to the bare merges; the rest to the whole tokenizer."""
        if self.bare is None:
            return self.learn_whole(words)
        memo, cores, marked, rest = self.memo, set(), [], []
        for w in words:
            c = w.rstrip(MARKS)
            if c.isalpha() and (c.isascii() or latin(c)) and c.islower():
                if c not in memo:
                    cores.add(c)
                if len(c) != len(w):
                    marked.append((w, c, w[len(c) :]))
            else:
                rest.append(w)
        self.learn_whole([*rest, *{t for _, _, t in marked if t not in memo}.difference(rest)])
        for some in ([c for c in cores if c.isascii()], [c for c in cores if not c.isascii()]):
            if not some:
                continue
            line = " ".join(some)
            if not line.isascii():
                line = " ".join(c.encode().decode("latin-1").translate(BYTE_CHARS) for c in some)
            ids = np.asarray(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            packed, start = ids.astype(self.dtype).tobytes(), 0
            for c, end in zip(some, ends, strict=True):
                memo[c] = packed[start:end]
                start = end
        for w, c, t in marked:
            memo[w] = memo[c] + memo[t]

    def learn_whole(self, words: list[str]) -> None:
        """Encodes words as one text, parted by a special token, at which the library cuts a text before all else."""
        plain = [w for w in words if w and "<|" not in w] if self.mark is not None else []
        if plain:
            ids = np.asarray(self.lib.encode_batch_fast([self.lib.id_to_token(self.mark).join(plain)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.mark)
            packed, w = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            starts, ends = [0, *((cuts + 1) * w).tolist()], [*(cuts * w).tolist(), len(packed)]
            self.memo.update((x, packed[a:b]) for x, a, b in zip(plain, starts, ends, strict=True))
        rest = [w for w in words if w not in self.memo] if plain else words
        for word, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.memo[word] = np.asarray(e.ids, self.dtype).tobytes()

    def remember(self, parts: list[list[str]]) -> None:
        """Sees to it that memo has all words of these lists."""
        wanted = set().union(*parts)
        if len(self.memo) + len(wanted) > MEMO:
            self.memo.clear()
        missing = [w for w in wanted if w not in self.memo]
        for at in range(0, len(missing), 50_000):
            self.learn(missing[at : at + 50_000])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        parts = [parted(t) for t in texts]
        self.remember(parts)
        return [b"".join(map(self.memo.__getitem__, p)) for p in parts]


def parted(text: str) -> list[str]:
    """The words between single spaces or line ends; each keeps its length, but for case."""
    return folded(text).replace("\n", " ").split(" ")


def folded(text: str) -> str:
    """In lower case where that surely is what the tokenizer does: Latin-1 text that can't hold a special token."""
    if "<|" in text:
        return text
    return text.lower() if latin(text) else text


@functools.lru_cache(4)
def words(path: str) -> WordIds:
    return WordIds(path)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes all documents and returns the manifest: path, first id, n_docs, n_ids, base and width of each shard."""
    small_batches(docs.sparkSession)
    fs, top = opened(folder)
    fs.create_dir(top, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = words(tokenizer), f"shard-{uuid.uuid4().hex}"
        claim("words", words.cache_clear)
        end = np.asarray([end_id], enc.dtype).tobytes()
        sizes, ids, known, out = [], [], [], None
        fs, top = opened(folder)
        for b in batches:
            if out is None:
                out = fs.open_output_stream(f"{top}/{name}.bin")
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in slices(texts):
                for packed in enc.encode(texts[a:z]):
                    out.write(packed + end)
                    sizes.append(len(packed) // enc.dtype.itemsize + 1)
            known += b.column(0).is_valid().to_pylist()
            ids += b.column(0).fill_null(0).to_pylist()
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        with fs.open_output_stream(f"{top}/{name}.off") as f:
            f.write(offsets.tobytes())
        with fs.open_output_stream(f"{top}/{name}.doc") as f:
            f.write(np.asarray(ids, "<i8").tobytes() + np.asarray(known, np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "known": [known[0]], "first": [ids[0]], "n_docs": [len(ids)], "n_ids": [int(offsets[-1])],
            "width": [enc.dtype.itemsize]})

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    rows = ordered.mapInArrow(run, "name string, known boolean, first bigint, n_docs bigint, n_ids bigint, width bigint").collect()
    manifest, base = [], 0
    for r in sorted(rows, key=lambda r: (r.known, r.first)):
        manifest.append(r.asDict() | {"folder": folder, "base": base})
        base += r.n_ids
    return manifest


class Shard:
    """One shard, memory-mapped where the folder is a local or mounted one, else read by one request a file."""

    def __init__(self, folder: str, name: str, width: int, n_docs: int):
        fs, top = opened(folder)

        def data(kind: str, dtype: str) -> np.ndarray:
            if isinstance(fs, pafs.LocalFileSystem):
                return np.memmap(f"{top}/{name}.{kind}", dtype, "r")
            with fs.open_input_file(f"{top}/{name}.{kind}") as f:
                return np.frombuffer(f.read(), dtype)

        self.ids, self.offsets = data("bin", f"<u{width}"), data("off", "<i8")
        raw = data("doc", "u1")
        self.docs, self.known = raw[: 8 * n_docs].view("<i8"), raw[8 * n_docs :].astype(bool)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_shards(spark: SparkSession, manifest: list[dict], kind: str = "bigint") -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "folder string, name string, width bigint, n_docs bigint, base bigint"
    rows = [tuple(m[k] for k in ("folder", "name", "width", "n_docs", "base")) for m in manifest]
    shards = spark.createDataFrame(rows, schema)
    if len(rows) > 1:
        shards = shards.repartition(len(rows), "name")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                s = Shard(m["folder"], m["name"], m["width"], m["n_docs"])
                for at in range(0, m["n_docs"], 10_000):
                    some = range(at, min(m["n_docs"], at + 10_000))
                    crc = np.fromiter((zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in some), np.int64)
                    part = slice(at, some.stop)
                    yield pa.RecordBatch.from_arrays([pa.array(s.docs[part], mask=~s.known[part]), pa.array(s.offsets[:-1][part] + m["base"]),
                        pa.array(np.diff(s.offsets[at : some.stop + 1])), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_shards(spark, write_shards(docs, folder, tokenizer, end_id, id_col, text_col))
