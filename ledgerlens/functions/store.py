"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where it is unset and the master is local, as in tests.

    RuntimeError where it is unset on a cluster: a folder of one machine would lose the other machines' parts.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        local = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        sc.setCheckpointDir(folder)
    return folder


def _tables(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "tables", spark.sparkContext.applicationId)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are deleted when it is over; else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again: a cut lineage that outlives executors, and real sizes for the planner.

    The tables of a session stay until forget(): results that are still to be read may need them. Those that none
    will need can go sooner, by dropped().
    """
    path = os.path.join(_tables(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    with _shuffles_end_with_the_write(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored(), and the number of rows, counted while they are written. Parts written anew after a loss may count twice."""
    seen = Observation()
    return stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def dropped(*tables: DataFrame) -> None:
    """Deletes stored() tables that no frame still to be run reads; other tables that a frame reads are left alone."""
    for df in tables:
        own = _tables(df.sparkSession)
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if own.split(":", 1)[-1].lstrip("/") in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this session has stored; for the end of a query whose result has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
