"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, flat_graph, hard_negatives, hyperlang, merkle, mixing, multi_index, ngram_join, sharding, token_counts, token_files, toxicity
from .common import held_out, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return merkle.fixity(pages, merkle.decayed(pages))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = hyperlang.predict_language(docs, hyperlang.fit_profiles(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op11_hat_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fagin_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, label = F.col("vec_id"), F.col("label")
    label = F.when(every % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), every % 50 == 0, label)


def op13_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_merkle_fixity, op3_ngram_jaccard, op4_pareto_mix, op5_multi_index_hashing, op6_hyperdimensional_language,
    op7_token_files, op8_token_counts, op9_flat_graph, op10_byte_bpe, op11_hat_trie_collocations, op12_fagin_hard_negatives, op13_stratified_sharding)}

NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, least(vec_id, coalesce(least, vec_id)) = vec_id AS kept
FROM v LEFT JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id
"""

ORACLE_SQL = {"op9_flat_graph": NEAR_SQL, "op2_merkle_fixity": merkle.FIXITY_SQL, "op3_ngram_jaccard": ngram_join.JACCARD_SQL, "op4_pareto_mix": mixing.MIX_SQL,
    "op11_hat_trie_collocations": collocations.COLLOCATIONS_SQL, "op12_fagin_hard_negatives": hard_negatives.HARD_NEGATIVES_SQL,
    "op13_stratified_sharding": sharding.SHARDING_SQL}
