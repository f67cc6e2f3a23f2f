"""A corpus from raw documents to token ids, in five stages.

Every stage takes all documents that the one before has kept, and is written as
Parquet and read again before the next one starts, so that a lost executor costs
no more than the stage that runs.  All but the last return the columns of
``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from splitcraft.llm import bpe, minhash, mixing, pii, quality
from splitcraft.session import ensure_checkpoint_dir

#: Words in a shingle, and the similarity (in hundredths) from which documents
#: are near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: No source is read more than so often while the smaller ones are raised.
REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond their group's cut-offs go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses and numbers are replaced, terms that disclose them generalised
    or removed; ``n_chars`` is that of the new text."""
    return pii.sanitise(docs, chars_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated towards the weights of the temperature at
    which none is read more than ``REPEATS`` times; every document stays."""
    return mixing.mix(docs, repeats=REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, intact``: token ids, and whether they decode to
    the text again."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), check=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Sketches, signatures, patterns with checks, hashes and merges are beyond SQL;
#: tests/llm compare the stages with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
