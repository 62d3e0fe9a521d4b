"""From raw documents to token ids: five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, neardup, piece_bpe, pii, quality_classifier
from loomgraph.llm.common import stored
from loomgraph.llm.queries import PIECE_MODEL, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    out = pii.redact(pii.find_pii(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents come as often, and with the words, that the mix takes."""
    rows, parts = mixing.mix(docs)
    return mixing.mixed_documents(docs, rows, parts)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding."""
    return piece_bpe.tokenized(docs, tokenizer(PIECE_MODEL))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: EM, MinHash and the pseudorandom draw can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
