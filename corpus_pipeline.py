"""From raw documents to a tokenised training mix, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; ``run`` writes each stage's rows to the shared folder and
reads them back as the next stage's documents, so a lost executor costs one
stage at most. No stage but the last changes the columns.

Rejected: texts without a letter or unlike every language (1), toxic texts (2),
all but one document of each near-duplicate class (3). Stage 4 repeats or
leaves out whole documents to meet the sources' targets.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import bpe, hyperlang, mixing, ngram_join, toxicity
from quillmesh.llm.common import stored, table

#: A text of a known language is nearer to its profile than this, even when short; unrelated letters aren't.
LEAST_COSINE = 0.08


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; null, empty and letterless texts go."""
    return hyperlang.keep_identified(docs, hyperlang.fit_profiles(docs), LEAST_COSINE)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those that came this far, scores below its threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies; decided by row, so repeated and null ids lose no other text."""
    return ngram_join.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and their digest, and the digest of what they decode to."""
    return bpe.coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Profiles and boosted trees have no SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
