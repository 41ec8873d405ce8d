"""The shared folder that long jobs write their steps to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_checkpoints(spark: SparkSession) -> None:
    """Have ``checkpoint()`` write to spark.checkpoint.dir; in local mode, where it is unset, to a folder of our own."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if (spark.sparkContext.master or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="assaya-")
    spark.sparkContext.setCheckpointDir(found)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a compressed table in the shared folder; the shuffles behind it go as soon as it is written."""
    spark = rows.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/assaya-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)
