"""Phrase collocations: the trie against plain counting, the operator against a plain version."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from quillmesh.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, cover=80, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {key: c for key, c in f.items() if c >= least}
    out = []
    for lang in n:
        mine, kept = {p: c for (x, p), c in often.items() if x == lang}, []
        for p, a in mine.items():
            held = [c for q, c in mine.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) > 1 and not any(100 * c >= cover * a for c in held):
                score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, rows, vocabulary=25):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "é", "İx", "a\x00b", "don't", " z"]
    joins = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "?!"]
    p = 1 / np.arange(1, len(words) + 1)
    made = []
    for i in range(rows):
        w = r.choice(len(words), r.integers(0, 60), p=p / p.sum())
        made.append((["en", "de", None][i % 3], "".join(words[x] + joins[r.integers(len(joins))] for x in w)))
    return made


SCHEMA = "lang string, text string, phrase string, f int"


def counts(rows):
    f = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            f[lang, ""] += len(w)
            f.update((lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f


@pytest.mark.parametrize(("burst", "entries", "words"), [(1 << 15, 4_000_000, 1 << 20), (4, 60, 1 << 20), (3, 1 << 20, 12)])
def test_runs_add_up_to_plain_counts(monkeypatch, burst, entries, words):
    """Containers that burst, subtrees that spill and numbers that start anew change no count; of longer phrases, those of known pairs are counted."""
    for name, value in {"BURST": burst, "WORDS": words, "FOLD": 16}.items():
        monkeypatch.setattr(collocations, name, value)
    rows = [(lang or "und", text) for lang, text in texts(3, 200)]
    want = counts(rows)
    for bits in (None, np.full(1 << 10, 255, np.uint8)):  # every pair is known
        counter, got = collocations.Counter(bits, entries), collections.Counter()
        for i in range(0, len(rows), 20):
            made = list(counter.add(*zip(*rows[i : i + 20], strict=True)))
            for b in [*made, *(counter.rest() if i + 20 >= len(rows) else [])]:
                for x in b.to_pylist():
                    assert x["k"] == len(f"{x['head']} {x['last']}".split(" ")) - (not x["head"]) - (not x["last"])
                    got[x["lang"], f"{x['head']} {x['last']}".strip(" ")] += x["f"]
        assert got == {k: n for k, n in want.items() if n and (k[1].count(" ") > 1) == (bits is not None)}


@pytest.mark.parametrize(("entries", "bits"), [(4_000_000, 26), (60, 8)])
def test_collocations_equal_a_plain_version(spark, monkeypatch, entries, bits):
    """Pairs that share bits, spills and salted ranks change nothing."""
    monkeypatch.setattr(collocations, "RANKED", 40)
    rows = texts(1, 240)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(5)
    got = collocations.collocations(df, least=8, top=60, bits=bits, entries=entries).collect()
    assert sorted(map(tuple, got)) == plain(rows, 8, 80, 60) and len(got) > 60


def test_trie_bursts_spills_and_keeps_every_count(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 5)
    monkeypatch.setattr(collocations, "FOLD", 2)
    r = np.random.default_rng(4)
    trie, want, out = collocations.HatTrie(entries=300), collections.Counter(), collections.Counter()
    for _ in range(60):
        a, b, c = (r.zipf(1.5, 100) % m for m in (3, 40, 900))
        keys = a << 42 | b << 21 | c
        want.update(keys.tolist())
        trie.add(keys)
        if trie.full():
            parts = list(trie.spill())
            assert parts and trie.root.size <= 300
            for keys, counts in parts:
                out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    deep = [n.depth for n, _ in trie.root.slots()]
    assert max(deep) == 1 and len(deep) > 5
    for keys, counts in trie.spill(all_=True):
        out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert out == want and trie.root.size == 0


def test_runs_are_sorted_by_words():
    counter = collocations.Counter(None)
    list(counter.add(["en"], ["b a b c. a b"]))
    rows = [tuple(x.values()) for b in counter.rest() for x in b.to_pylist()]
    assert rows == [("en", "", "", 0, 6), ("en", "", "a", 1, 2), ("en", "a", "b", 2, 2), ("en", "", "b", 1, 3), ("en", "b", "a", 2, 1), ("en", "b", "c", 2, 1),
        ("en", "", "c", 1, 1)]


def test_collocations_on_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = collocations.collocations(odd, least=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3)
    assert collocations.collocations(none).count() == 0


def test_scores_pass_64_bits(spark):
    big = 1 << 61
    frequent = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big)], "lang string, phrase string, k int, f bigint")
    assert [r.score for r in collocations.scored(frequent).collect()] == [1_000_000]
