"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.  The other tables are read from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.pii import sanitize
from ledgerline.llm.queries import toxicity_model
from ledgerline.llm.similar import drop_similar
from ledgerline.llm.tokens import CachedEncoder
from ledgerline.llm.toxicity import drop_toxic
from ledgerline.llm.winnow import drop_contaminated


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the model learns from the labels of the documents at hand."""
    return drop_toxic(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id from each group of near copies: Jaccard similarity of 5-word shingles of 0.8 or more."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers and revealing words replaced; n_chars follows the text."""
    n_chars = docs.schema["n_chars"].dataType
    return sanitize(docs).withColumn("n_chars", F.char_length("text").cast(n_chars)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return pack_documents(docs, CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte"), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The fitted classifier, fingerprints and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
