"""The folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir; where that is unset on one machine, as in tests, a new local folder that becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A path for one run's files below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read again.

    Unlike checkpoint() this drops the constraints that the optimizer has inferred as well, which grow with every round of an
    iteration until planning takes longer than the work.
    """
    folder = new_folder(rows.sparkSession, "rows")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
