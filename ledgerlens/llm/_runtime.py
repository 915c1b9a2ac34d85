"""What every operator of this subpackage needs from the session: a shared folder, and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import dropped, shared_dir, stored, stored_counted

__all__ = ["dropped", "few", "shared_dir", "stored", "stored_counted", "table", "total_bytes"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def total_bytes(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Rows and bytes of the named string columns, counted on the executors."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows, size or 0


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """Keys (one number a row), marked to be sent to the executors if they are at most `most`; else joined by shuffle.

    They are written and counted first, so the size of what is sent is known.
    """
    df, n = stored_counted(df, "keys")
    return F.broadcast(df) if n <= most else df
