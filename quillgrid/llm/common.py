"""Helpers that every operator of this subpackage shares: table access and cuts of lineage in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgrid.sources.tables import BATCH_BYTES, bounded_batches, read_table  # noqa: F401  (the operators here take them from this module)

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark knows will do."""
    return read_table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset in a local session (tests) a folder of this process is made and set; on a cluster it's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillgrid-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends there, and the rows outlive a lost executor.

    The folder is named by application and step, so that the owner of the cluster can sweep it afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
