"""The corpus pipeline: documents through five of the corpus operators, each stage on what its predecessor kept.

Stages: toxic documents go; of equal texts the one with the largest doc_id stays; of near duplicates (multisets of
five-word shingles, similarity 0.8 or more) one of each class stays; secrets are replaced in the texts; what is left is packed.
All stages but the last return the columns of documents.  `run` writes what each stage returns to the shared folder and reads it again.

A stage gives for each case (nulls, empty and long texts, repeated rows, empty tables, extra columns) what its operator's
docstring says.  An empty labels table rejects no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxquarry.llm import bagminhash, exact, packing, secrets, toxicity
from voxquarry.llm.queries import model
from voxquarry.llm.util import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id"))
    return toxicity.reject(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its ids."""
    return packing.pack(docs, model("byte_bpe_50k.json"), model("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: Toxicity, shingle signatures and byte pairs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
