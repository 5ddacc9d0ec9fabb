"""The corpus pipeline: documents in, kept and encoded documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import decontaminate, pieces, pii, simhash, toxicity
from innsight.llm.queries import PIECES, PII_KEY, table
from innsight.sources.scratch import remove_folder, scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject. It learns from those of ``docs``
    that have a label and are not held out."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, network)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no notable part of a benchmark item."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced."""
    replaced = pii.pseudonymise(docs, PII_KEY, counts=False)
    length = F.char_length("text").cast("long")
    return replaced.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and digests; the text that the ids decode
    to is compared and not stored again."""
    return pieces.encode_texts(docs, public_tokenizers.path(PIECES)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("sentencepiece", encode),
]

#: A trained network and a subword tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read
    again by the next; what a stage has read of the one before is then deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
