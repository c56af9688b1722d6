"""A training corpus from raw documents: toxicity, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tensorfold.llm import mixing, sentencepiece_codec, similar_texts, toxicity
from tensorfold.llm.common import fresh, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; rows without a text count as empty and stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = tuple(fresh(docs.columns, "score", "offending"))
    scored = toxicity.score_documents(docs, model, names=names)
    return scored.where(scored[names[0]] < 0.5).drop(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the least id.

    Candidates meet at SimHash's anchors; the shingles themselves decide.
    """
    return similar_texts.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of sources takes them."""
    return mixing.apply_mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document of the mixture."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_documents(docs, model, keep=("doc_id", "source"), emit=sentencepiece_codec.digest_row, schema=sentencepiece_codec.DIGEST)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm runs each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
