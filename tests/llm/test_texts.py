"""Token counts, byte BPE, token files, language, toxicity: against the libraries, plain versions and held-out rows."""

from __future__ import annotations

import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmesh.llm import boosting, bpe, hyperlang, queries, token_counts, token_files, toxicity
from quillmesh.llm.common import slices, table

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIB = Tokenizer.from_file(WORD)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def whole(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library_and_round_trips(text):
    c = bpe.codec(BYTE, public_tokenizers.PATTERN)
    ids = c.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == TIK.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", [b"aaaaaaa", b"!" * 3000, "é".encode() * 50, bytes(range(256)), b"abcabcabc" * 30])
def test_segment_tree_one_by_one_equals_many_at_once(piece):
    v = bpe.Vocabulary.load(BYTE)
    slow = bpe.Tree(piece, v).merged()
    wide = 1 << (len(piece) - 1).bit_length()
    assert bpe.merge_many([piece, piece], wide, v)[1].tolist() == slow
    assert b"".join(v.tokens[i] for i in slow) == piece


def test_bpe_on_odd_rows(odd, none):
    got = bpe.code_digests(odd, BYTE, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd.collect():
        ids = TIK.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.code_digests(none, BYTE, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Straße", "don't", "x1", "日本", "é", "<|endoftext|>", "!!", "a.b,", " ", "\n", "\t", "Σας", "9"]), max_size=40))
def test_word_ids_equal_the_library(parts):
    text = "".join(parts)
    w = token_files.words(WORD)
    assert np.frombuffer(w.encode([text])[0], w.dtype).tolist() == whole(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word", "don't", "x1", "日本", "é!", "aaaaaaaaaaaaaaaaaaaa", " ", "\n", "'s"]), min_size=1, max_size=120))
def test_overlaps_resynchronise(parts):
    text = "".join(parts)
    assert token_counts.load(WORD).count_long(text, 40, 4)[0] == len(whole(text))


@pytest.mark.parametrize("text", ["a" * 9000, "'s" * 4000, "日本" * 4000, "x1 " * 3000, "<|endoftext|>" * 700, "é!é " * 2000, "word " * 9])
def test_overlaps_widen_until_they_align(text):
    assert token_counts.load(WORD).count_long(text, 900, 8)[0] == len(whole(text))


@pytest.mark.parametrize("text",
    ["several words in a row and more of them " * 400, "é à ü ñ  two   spaces\n" * 300, "日本語 " * 900, "x" * 5000, "▁ a▁b " * 700, "ﬁ ½ ① word " * 500])
def test_piece_model_splices(text):
    lib = token_counts.load(PIECE)
    got, splices, _ = lib.count_long(text, 500, 16)
    assert got == lib.counts([text])[0] and (splices > 1 or text[0] in "x▁")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "naïve", " ", "  ", "\n", "x1", "...", "日本", "\u200b", "½"]), max_size=300).map("".join))
def test_piece_model_splices_random_texts(text):
    lib = token_counts.load(PIECE)
    assert lib.count_long(text + " end", 40, 4)[0] == lib.counts([text + " end"])[0]


@pytest.mark.parametrize("path", [WORD, PIECE])
def test_documents_are_counted_through_splices(spark, path):
    """Every text of documents, and most of their characters through the splice path."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").collect()
    lib = token_counts.load(path)
    spliced = chars = widened = 0
    for r in rows if path == WORD else rows[::4]:
        want = len(whole(r.text)) if path == WORD else lib.counts([r.text])[0]
        got, splices, wide = lib.count_long(r.text)
        assert got == want == token_counts.count_all([r.text], path)[0], r.doc_id
        spliced += len(r.text) * (splices > 0)
        chars, widened = chars + len(r.text), widened + wide
    assert spliced > 0.3 * chars and widened < 50


def test_query_counts_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, d).collect()}
    want = {r.doc_id: (len((r.text or "").encode()), n := len(whole(r.text)), n > 2048) for r in table(spark, d, "documents").collect()}
    assert got == want


def test_characters_that_the_normaliser_expands_keep_their_tokens():
    """Each of them gives several tokens of one end offset; unspaced runs of them are spliced inside."""
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and max(len(unicodedata.normalize("NFC", chr(c))), len(chr(c).lower())) > 1]
    lib, r = Tokenizer.from_file(WORD), random.Random(1)
    texts = [(unit * 9001)[:n] for c in odd for unit, n in ((c, 5000), ("a" + c, 9001))] + ["İstanbul" * 1200]
    texts += ["".join(r.choice([*odd, *"abcé"]) for _ in range(n)) for n in (5000, 9001) for _ in range(10)]
    assert len(odd) > 80 and token_counts.count_all(texts, WORD) == [len(e.ids) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


def test_counts_on_odd_rows(odd, none):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, WORD).collect()}
    for r in odd.collect():
        n = len(whole(r.text))
        assert got[r.doc_id, len((r.text or "").encode())] == (n, n > 2048)
    assert token_counts.token_counts(none, WORD).count() == 0


def test_token_files_read_back_in_order(odd, none):
    got = sorted(token_files.token_file_digests(odd, WORD).collect(), key=lambda r: r.start)
    assert len(got) == odd.count() and got[0].doc_id is None and got[0].start == 0
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    at = 0
    for r in got:
        ids = whole(texts[r.doc_id].pop()) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    assert token_files.token_file_digests(none, WORD).count() == 0


def test_slices_cover_all():
    texts = ["a" * n for n in (5, 900, 0, 3, 2000)] + [None]
    spans = list(slices(texts, 500))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(texts)))


def test_language_counts_whole_texts_in_parts(monkeypatch):
    text = "Ein Satz, und noch einer. " * 50
    g, c, has = hyperlang.gram_counts(text)
    monkeypatch.setattr(hyperlang, "PART", 37)
    g2, c2, has2 = hyperlang.gram_counts(text)
    assert has and has2 and g.tolist() == g2.tolist() and c.tolist() == c2.tolist()


def test_bundle_is_the_sum_of_bound_vectors():
    b = hyperlang.Bundler(64, 3)
    made, has = b.bundle(["abc", "", None, "12"])
    g, c, _ = hyperlang.gram_counts("abc")
    assert np.allclose(made[0], c @ b.bind(g).astype(float)) and has.tolist() == [True, False, False, False]
    assert not made[1:].any()


def test_language_held_out_accuracy(spark, sf):
    got = queries.op6_hyperdimensional_language(spark, "/root/testdata/sf0.01").alias("p").join(table(spark, "/root/testdata/sf0.01", "documents"),
        "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_one_piece_of_megabytes():
    """A run of letters is one piece; it must fit a worker, and equal the library's ids where that can still do it."""
    c = bpe.codec(BYTE, public_tokenizers.PATTERN)
    short = "abcdefghij" * 300 + "x" * 2000
    assert np.frombuffer(c.encode([short])[0], "<u4").tolist() == TIK.encode_ordinary(short)
    long = "abcxyz" * 50_000
    ids = c.encode([long])[0]
    assert c.decode(ids) == long.encode()


def test_language_query_equals_a_plain_version(spark):
    """Every text's trigrams bound letter by letter, bundled and compared, without tables or batches."""
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    profiles = hyperlang.fit_profiles(docs)
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in queries.op6_hyperdimensional_language(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    plain = hyperlang.Bundler(hyperlang.DIM, hyperlang.GRAM)
    for r in rows[::9]:
        g, c, _ = hyperlang.gram_counts(r.text)
        v = np.zeros(hyperlang.DIM)
        for gram, n in zip(g.tolist(), c.tolist(), strict=True):
            v += n * plain.bind(np.array([gram]))[0].astype(float)
        cosine = profiles.vectors @ v / np.linalg.norm(v) / np.linalg.norm(profiles.vectors, axis=1)
        lang, score, held = got[r.doc_id]
        assert lang == profiles.langs[int(cosine.argmax())] and abs(score - max(0.0, cosine.max())) < 1e-4
        assert held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_query_equals_a_plain_version(spark):
    """Each text's features, the sum of its leaves and the calibration, one text at a time."""
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in queries.op1_toxicity(spark, d).collect()}
    for r in docs.collect():
        x = model.features.row(r.text)
        f = model.trees.base
        for feature, cut, value in zip(model.trees.feature, model.trees.cut, model.trees.value, strict=True):
            node = 0
            for _ in range(model.trees.depth):
                place = int(np.searchsorted(model.trees.edges[feature[node]], x[feature[node]], "left"))
                node = 2 * node + 1 + (place > cut[node])
            f += value[node - (2**model.trees.depth - 1)]
        score = float(np.clip(np.interp(f, model.scale.x, model.scale.y), 0, 1))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.3) and got[r.doc_id][2] == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(got) == docs.count()


def test_byte_bpe_query_equals_the_library_on_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, d).collect()}
    rows = table(spark, d, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = TIK.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_token_file_query_equals_the_library_on_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(queries.op7_token_files(spark, d).collect(), key=lambda r: r.doc_id)
    rows = sorted(table(spark, d, "documents").collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*whole(r.text), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_on_odd_rows(odd, none):
    p = hyperlang.fit_profiles(odd)
    got = {(r.doc_id, r.lang_pred): r.score for r in hyperlang.predict_language(odd, p).collect()}
    assert {got[i, "und"] for i in (4, 5, 6, 9)} == {0.0} and len(got) == 11
    kept = hyperlang.keep_identified(odd, p, 0.0)
    assert kept.columns == odd.columns and kept.count() == 8
    empty = hyperlang.fit_profiles(none)
    assert {r.lang_pred for r in hyperlang.predict_language(odd, empty).collect()} == {"und"}
    assert hyperlang.predict_language(none, p).count() == 0


def test_isotonic_is_monotone_and_pools():
    s = boosting.Isotonic().fit(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    y = s.read(np.linspace(-1, 4, 50))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and s.read(np.array([1.5]))[0] == 0.5


def test_trees_learn_a_rule():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    t = boosting.Trees().fit(x, y)
    assert ((t.raw(x) > 0) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize(("text", "column"),
    [("you are an idiot", "near_hits"), ("what an 1d1ot", "hidden_hits"), ("an i d i o t here", "hidden_hits"), ("such an iiidiiiot", "hidden_hits"),
    ("moron", "seed_hits")])
def test_features_see(text, column):
    f = toxicity.Features({"zork": 2.0})
    assert f.row(text)[toxicity.NAMES.index(column)] > 0
    assert f.row("plain words of no harm")[toxicity.NAMES.index(column)] == 0


@pytest.mark.parametrize("before", [0, 1990, 1998, 5000])
def test_spelled_words_are_seen_anywhere_in_a_run(before):
    f = toxicity.Features({"unbelievablezork": 2.0})
    hits = lambda words: f.spelled(words, np.arange(len(words)))
    assert hits(["x"] * before + list("idiot") + ["x"] * 9) == 1
    assert hits(["x"] * before + list("unbelievablezork") + ["x"] * 9) == 1
    assert hits(["x"] * (before + 9)) == 0
    assert f.row(" ".join("x" * before + "idiot"))[toxicity.NAMES.index("hidden_hits")] > 0


def test_toxicity_held_out_by_language(spark):
    """The lexicon must find the words of every language, from labels alone."""
    d = "/root/testdata/sf0.1"
    lang = table(spark, d, "documents").select("doc_id", "lang")
    got = queries.op1_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").join(lang, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    for _, part in got.groupby("lang"):
        assert (part[part.toxic == 1].predicted == 1).mean() >= 0.85
        assert (part[part.toxic == 0].predicted == 0).mean() >= 0.97


def test_lexicon_terms():
    found = toxicity.Terms().of_text("Zorkich, zorkung (ab) zorkung 12x")
    assert {"zorkich", "zork*", "zork**", "zorkun*"} <= found and "zorkun**" not in found and not any("12" in t for t in found)
    assert toxicity.Terms({"zork**"}).of_text("zorkich zorkung") == {"zork**"} and toxicity.Terms({"zork**"}).of_text("zorkich zorkich") == set()
    kept = toxicity.lexicon_of([("zork*", 40, 40), ("the", 50, 500), ("rare", 4, 4), ("half", 30, 90)], 0.1)
    assert set(kept) == {"zork*", "half"} and kept["zork*"] > kept["half"] > toxicity.ODDS


def test_characters_count_by_category():
    f, at = toxicity.Features({}), toxicity.NAMES.index
    plain = f.row("Это простое предложение без вопросов и цитат «вот» — так…")
    assert plain[at("question_rate")] == 0 and plain[at("letter_rate")] > 0.7
    assert f.row("这是一个句子。")[at("letter_rate")] > 0.8
    for hidden in ("іdіоt", "id\u200biot", "ｉｄｉｏｔ", "1d1ot", "iiidiot"):
        assert f.row("oh " + hidden)[at("hidden_hits")] > 0, hidden


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 1), (11, 0), (None, 1), (99, 1), (8, None)], "doc_id bigint, toxic int")
    m = toxicity.fit(odd, labels)
    got = toxicity.score_documents(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.keep_clean(odd, m).columns == odd.columns
    m = toxicity.fit(none, labels.limit(0))
    assert toxicity.score_documents(odd, m).count() == odd.count() and toxicity.score_documents(none, m).count() == 0
