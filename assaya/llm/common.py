"""Shared helpers of the training-data operators: shared scratch folders and table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where no spark.checkpoint.dir is set (tests, a single machine).
_OWN_DIR: list[str] = []
_SENT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="assaya-"))
        found = f"file://{_OWN_DIR[0]}"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/assaya-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark deletes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; cuts lineage and survives lost executors.

    Nothing reads the shuffles behind it again, so they go at once and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ready(spark)
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


#: Most rows that are broadcast to be left out; beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000


def without(rows: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """The ``rows`` that match none of ``gone`` (a written table of ids), which is broadcast if it is small enough."""
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, same, "left_anti")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: Spark goes by the size of its compressed files, and rows that repeat can take a hundred times as much on the driver."""
    return df.hint("merge")


def ready(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, unless they find it on the path that they inherit."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    inherited = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if root in map(os.path.abspath, inherited) or app in _SENT:
        return
    _SENT.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="assaya-"), "assaya.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "assaya")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
