"""Sinks: insert-if-new by key, full replacement, additive append."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from .readers import Warehouse
from .schema import KEYS, TABLES


def aligned(df: DataFrame, table: str, *more: Column) -> DataFrame:
    """df by name in the table's schema: missing columns are null, others left out; and more columns behind them."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]], *more)


def insert_new(wh: Warehouse, table: str, df: DataFrame) -> int:
    """Appends the rows whose key isn't in the table yet; within df the smallest row of a key wins. Rows added.

    Writing twice adds nothing the second time. One writer at a time: Parquet folders know no locks.
    """
    keys = KEYS[table]
    rows = aligned(df, table)
    one = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("r")).select(*keys, "r.*").select(*rows.columns)
    new = stored(one.join(wh.read(table).select(*keys), keys, "left_anti"), table)
    path = wh.path(table)
    new.write.mode("append").parquet(path)
    wh.spark.catalog.refreshByPath(path)
    return new.count()


def replace(wh: Warehouse, table: str, df: DataFrame) -> int:
    """Full replacement. The new table is written beside the old one, which is moved aside and deleted last.

    So df may be derived from the old table, and at any time one of the two is there whole.
    """
    mark = uuid.uuid4().hex
    jvm, conf = wh.spark._jvm, wh.spark._jsc.hadoopConfiguration()
    new, old, dst = (jvm.org.apache.hadoop.fs.Path(p) for p in (os.path.join(wh.folder, f"_{table}-{mark}"), os.path.join(wh.folder, f"_{table}-{mark}-old"), wh.path(table)))
    fs = dst.getFileSystem(conf)
    aligned(df, table).write.parquet(str(new))
    moved = fs.exists(dst)
    if moved and not fs.rename(dst, old):
        raise OSError(f"{dst} can't be moved aside")
    if not fs.rename(new, dst):
        if moved:
            fs.rename(old, dst)
        raise OSError(f"{new} can't take the place of {dst}")
    if moved:
        fs.delete(old, True)
    wh.spark.catalog.refreshByPath(wh.path(table))
    return wh.read(table).count()


def add_labels(wh: Warehouse, df: DataFrame) -> int:
    """Labels added to those there are; cases that are there stay as they are. Rows added."""
    return insert_new(wh, "fraud_cases", df)


def replace_labels(wh: Warehouse, df: DataFrame, order: str | None = None) -> int:
    """Labels replaced. Of several rows of a case the last by the column `order` counts, else the most confident: rows of a table have no order of their own."""
    by = [F.col(order)] if order else []
    rows = aligned(df, "fraud_cases", F.struct(*by, F.coalesce("match_confidence", F.lit(-1.0)), F.coalesce("loan_number", F.lit(""))).alias("_by"))
    best = rows.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in TABLES["fraud_cases"].names if c != "case_id"]), "_by").alias("r"))
    return replace(wh, "fraud_cases", best.select("case_id", "r.*"))
