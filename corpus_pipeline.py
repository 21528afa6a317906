"""The corpus pipeline: five operators over the documents, one after another.

quality classifier, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing. Each stage takes
(spark, docs, sf_dir), works on every row its predecessor kept, and but for the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import cotraining, linededup, mixing, packing, simhash
from quillgrid.llm.common import DOCUMENT_COLUMNS, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    models = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    return cotraining.with_quality(docs, models).where("quality_keep").select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has in an aligned block go; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs).select(*DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.repeat_rows(docs).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Fitted models and hashes of token ids have no SQL form: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
