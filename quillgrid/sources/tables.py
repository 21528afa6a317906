"""Parquet tables, and tables that a session writes for itself in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches between the JVM and Python hold whole texts; Spark's own bound (64 MB, 10,000 rows) is a large part of an executor's memory.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is; where the session's creator left the size of Arrow batches alone, it is bounded by BATCH_BYTES from now on."""
    spark = df.sparkSession
    if spark.sparkContext.getConf().get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def own_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application, in the folder of ``spark.checkpoint.dir`` that driver and executors share.

    Only a local session may do without that setting: it gets a temporary folder. On a cluster it's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillgrid-")
    return f"{found.rstrip('/')}/quillgrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: the lineage ends there, and the rows outlive a lost executor."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
