"""Cleaning and packing a corpus: documents in, token ids out.

Stages, each on all that the one before kept: documents without a language go; one document of each near-duplicate group
stays; secrets are redacted; sources are mixed to their targets (documents are repeated, cut or left out); texts are encoded
as SentencePiece ids.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readcollapse.llm import language_id, mixing, near_dedup, secrets, sentencepiece_fst
from readcollapse.llm.common import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_fst.encode(docs, keep=["doc_id", "lang", "source"])
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Kernel regression, sampling and transducers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{place}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
