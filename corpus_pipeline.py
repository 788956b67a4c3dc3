"""The corpus pipeline: five stages over ``documents``, each by one operator.

A stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept and returns a DataFrame with the columns of ``documents``;
the last one returns what it made of them. A stage decides by ``doc_id``: rows
that share one stand or fall together, and rows without one stay (the quality
stage alone decides row by row). Null texts count as empty ones; no rows give
no rows; other columns pass as they are. ``run`` writes each stage's result
as Parquet in the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._store import drop_ids, materialise
from codeweft.llm.bpe import decode, encode
from codeweft.llm.decontaminate import decontaminate
from codeweft.llm.exact_dedup import exact_dedup
from codeweft.llm.jaccard_join import jaccard_components
from codeweft.llm.quality import fit, keep_good

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the last by id, of each group of equal texts."""
    return drop_ids(docs, exact_dedup(docs).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group that near-duplicate links
    join: five words to a shingle, similarity of 0.8 or more."""
    return drop_ids(docs, jaccard_components(docs).where("doc_id <> component_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return drop_ids(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("spans") > 0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text they decode to."""
    decoded = decode(encode(docs, VOCABULARY), VOCABULARY)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminated),
    ("bpe", tokens),
]

#: No SQL: the classifier and the tokenizer can't be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
