"""Order statistics without one task per group.

A window over a whole group, or an exact percentile aggregate, holds the group in one task. Here values are first
collapsed to (keys, value, count), then cut into slices of about equal numbers of values by sketched borders; sums
over slices are few rows, and windows run inside a slice. The borders balance the work only: results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SLICES = 64
#: A value that holds more than one row in so many is joined by broadcast: there are fewer than HOT of them.
HOT = 1000


def _with_slices(cells: DataFrame, keys: list[str], value: str, slices: int) -> DataFrame:
    marks = F.percentile_approx(value, [i / slices for i in range(1, slices)], 2000).alias("_marks")
    cuts = cells.groupBy(*keys).agg(marks) if keys else cells.agg(marks)
    joined = cells.join(cuts, keys) if keys else cells.join(F.broadcast(cuts))  # without keys: one row
    return joined.withColumn("_slice", F.size(F.filter(F.array_distinct("_marks"), lambda m: m < F.col(value)))).drop("_marks")


def counted(df: DataFrame, keys: list[str], value: str, slices: int = SLICES) -> DataFrame:
    """(keys, value, n, before, total): distinct values with their count, the rows below, and the rows of the group.

    Null and NaN values are left out; null keys aren't.
    """
    v = F.col(value)
    # read three times below, so written once: else every caller's plan would be run for each
    cells = stored(df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "cells")
    cells = _with_slices(cells, keys, value, slices)
    sums = cells.groupBy(*keys, "_slice").agg(F.sum("n").alias("_sum"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most `slices` rows
    sums = sums.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(over.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_low"), F.sum("_sum").over(over).alias("total"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(sums, [*keys, "_slice"]).select(*keys, value, "n", (F.col("_low") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "total", "_slice")


def group_quantiles(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """(keys, a column for each name): exact quantiles, linear between neighbours, as numpy's default."""
    cells = counted(df, keys, value)
    aggs: list[Column] = []
    for name, q in named.items():
        at = (F.col("total") - 1) * q
        low, high = F.floor(at), F.ceil(at)
        end = F.col("before") + F.col("n")
        aggs += [F.max(F.when((F.col("before") <= low) & (low < end), F.col(value))).alias(f"_l_{name}"), F.max(F.when((F.col("before") <= high) & (high < end), F.col(value))).alias(f"_h_{name}"), F.max(at - low).alias(f"_f_{name}")]
    got = cells.groupBy(*keys).agg(*aggs) if keys else cells.agg(*aggs)
    return got.select(*keys, *[(F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * F.col(f"_f_{k}")).alias(k) for k in named])


def _joined(df: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of cells(keys, n, ...) by keys that are never null in either; n is left out.

    Values that very many rows share would meet in one task, so these few go to all executors.
    """
    cells = stored(cells, "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    often, rest = cells.where(hot).drop("n"), cells.where(~hot).drop("n")
    marked = df.join(F.broadcast(often.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    own = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(often), keys)
    return own.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(rest, keys))


def with_cume_dist(df: DataFrame, keys: list[str], value: str, name: str = "cume_dist") -> DataFrame:
    """Share of the group's rows at or below each value, as the window function of that name. Rows without a value drop."""
    c = counted(df, keys, value)
    return _joined(df, c.select(*keys, value, "n", ((F.col("before") + F.col("n")) / F.col("total")).alias(name)), [*keys, value])


def with_mean_rank(df: DataFrame, keys: list[str], value: str, name: str = "pct_rank", size: str = "cohort_size") -> DataFrame:
    """Mean rank of ties as a share of the group, and the size of the group."""
    c = counted(df, keys, value)
    return _joined(df, c.select(*keys, value, "n", ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias(name), F.col("total").alias(size)), [*keys, value])


def with_q_values(df: DataFrame, p: str = "p_value", name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values over all rows: the least p * total / rank from each p upwards, at most 1."""
    df = stored(df, "p_values")
    c = counted(df, [], p).withColumn("_raw", F.col(p) * F.col("total") / (F.col("before") + F.col("n")))
    later = c.groupBy("_slice").agg(F.min("_raw").alias("_min"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    later = later.select("_slice", F.min("_min").over(after).alias("_later"))
    inside = Window.partitionBy("_slice").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = c.join(F.broadcast(later), "_slice").select(p, "n", F.least(F.min("_raw").over(inside), F.col("_later"), F.lit(1.0)).alias(name))
    return _joined(df, q, [p])


def with_ranks(df: DataFrame, by: list[Column], name: str = "rank", head: int | None = None) -> DataFrame:
    """1-based ranks in a total order. With head, only the first rows are kept, without sorting the rest.

    Without head the order is found by a range partitioning and the sizes of its parts (few rows), not in one task.
    """
    if head is not None:
        top = df.orderBy(*by).limit(head)
        return top.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))  # at most `head` rows
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    ordered = stored(ordered, "ordered")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return ordered.join(F.broadcast(first), "_part").withColumn(name, (F.col("_first") + F.col("_i") + 1).cast("int")).drop("_part", "_i", "_first")
