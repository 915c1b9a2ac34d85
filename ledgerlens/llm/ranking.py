"""Problem 3: one ranking from several scores on different scales, by outranking net flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import stored


def _prefix(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], buckets: int) -> DataFrame:
    """Exclusive prefix sums of values in the order of a column in [0, 1], within keys.

    Two levels: totals of equal slices of [0, 1] are summed first (at most buckets rows a key), then rows within a
    slice; so a key with most of the rows is spread over many tasks.
    """
    df = df.withColumn("_b", F.least(F.floor(F.col(order) * buckets), F.lit(buckets - 1)).cast("int"))
    tot = df.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_b").orderBy(order, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(tot, [*keys, "_b"])
    return df.select("*", *[(F.col(f"_o_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0.0))).alias(n) for n, v in values.items()]).drop("_b", *[f"_o_{n}" for n in values])


def percentiles(scores: DataFrame, slices: int = 256, sample: int = 20_000) -> DataFrame:
    """(detector_id, score, n, n_det, pct): distinct scores with their number of items and mid-rank percentile.

    Ranks are exact. Hot detectors are cut into slices of the score whose borders come from percentile sketches;
    the borders only balance the tasks and don't change the result.
    """
    cells = scores.groupBy("detector_id", "score").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = stored(cells, "cells")
    cuts = cells.groupBy("detector_id").agg(F.percentile_approx("score", [i / slices for i in range(1, slices)], sample).alias("_cuts"), F.sum("n").alias("n_det"))
    # one row per detector: its cuts are fixed in number
    cells = cells.join(cuts, "detector_id").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    tot = cells.groupBy("detector_id", "_b").agg(F.sum("n").alias("_t"))
    before = Window.partitionBy("detector_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("detector_id", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_o"))
    inside = Window.partitionBy("detector_id", "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_o") + F.coalesce(F.sum("n").over(inside), F.lit(0.0))
    return cells.join(tot, ["detector_id", "_b"]).select("detector_id", "score", "n", "n_det", ((below + F.col("n") / 2) / F.col("n_det")).alias("pct"))


def net_flow_ranking(
    signals: DataFrame, item: str = "loan_number", detector: str = "detector_id", score: str = "score", indifference: float = 0.05, preference: float = 0.5, weights: dict[str, float] | None = None, buckets: int = 1024
) -> DataFrame:
    """(item, n_scores, plus_flow, minus_flow, net_flow, rank), best first.

    Per detector, item a is preferred to b by 0 up to an indifference gap of percentiles, by 1 beyond the preference
    gap, and linearly in between. The mean preference over all other items, in both directions, is a sum over a
    sorted list and is computed exactly from prefix sums of counts and percentiles at four shifted positions, never
    from pairs. Detectors are weighted (1 each unless weights names them); flows are divided by the sum of all
    weights, so an item without a score of a detector is neutral there. As only ranks enter, no range dominates.

    Null items, null detectors and null or NaN scores are dropped; infinite scores rank last or first. Of several
    rows of an item and detector the highest counts. Equal net flows share the smaller rank. Empty in, empty out.
    """
    if not 0 <= indifference < preference <= 1:
        raise ValueError("0 <= indifference < preference <= 1")
    q, p = indifference, preference
    one = (
        signals.select(F.col(item).alias("item"), F.col(detector).alias("detector_id"), F.col(score).cast("double").alias("score"))
        .where(F.col("item").isNotNull() & F.col("detector_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
        .groupBy("item", "detector_id").agg(F.max("score").alias("score"))
    )
    one = stored(one, "scores")
    pct = stored(percentiles(one), "percentiles")
    # Points carry weight; queries ask for the prefix at a shifted position. kind 0: points, 1: queries. A query at x
    # sees the points at positions <= x; those exactly at a border have preference 0 or 1 there, which both sides of
    # the formula give alike.
    points = pct.select("detector_id", "score", F.lit(0).alias("_kind"), F.lit("").alias("ask"), F.col("pct").alias("at"), "n", (F.col("n") * F.col("pct")).alias("s"))
    asked = pct.select("detector_id", "score", F.explode(F.array(*[F.struct(F.lit(k).alias("ask"), (F.col("pct") + d).alias("at")) for k, d in (("lp", -p), ("lq", -q), ("hq", q), ("hp", p))])).alias("x"))
    queries = asked.select("detector_id", "score", F.lit(1).alias("_kind"), F.col("x.ask").alias("ask"), F.col("x.at").alias("at"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    # with a wide preference gap half of the positions lie outside of (0, 1): below it there is nothing, above it all
    queries = queries.where("at > 0 and at < 1")
    sums = _prefix(points.unionByName(queries), ["detector_id"], "at", {"cum_n": F.col("n"), "cum_s": F.col("s")}, buckets).where("_kind = 1")
    wide = sums.groupBy("detector_id", "score").agg(*[F.max(F.when(F.col("ask") == k, F.col(c))).alias(f"{k}_{c}") for k in ("lp", "lq", "hq", "hp") for c in ("cum_n", "cum_s")])
    all_s = pct.groupBy("detector_id").agg(F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("pct")).alias("s_all"))
    wide = pct.select("detector_id", "score", "pct").join(wide, ["detector_id", "score"], "left").join(all_s, "detector_id")
    shift = {"lp": -p, "lq": -q, "hq": q, "hp": p}
    wide = wide.withColumns({f"{k}_cum_{c}": F.when(F.col("pct") + d <= 0, 0.0).when(F.col("pct") + d >= 1, F.col(f"{c}_all")).otherwise(F.col(f"{k}_cum_{c}")) for k, d in shift.items() for c in "ns"})
    x = F.col("pct")
    plus = F.col("lp_cum_n") + ((x - q) * (F.col("lq_cum_n") - F.col("lp_cum_n")) - (F.col("lq_cum_s") - F.col("lp_cum_s"))) / (p - q)
    minus = (F.col("n_all") - F.col("hp_cum_n")) + ((F.col("hp_cum_s") - F.col("hq_cum_s")) - (x + q) * (F.col("hp_cum_n") - F.col("hq_cum_n"))) / (p - q)
    others = F.greatest(F.col("n_all") - 1, F.lit(1.0))
    flows = wide.select("detector_id", "score", (plus / others).alias("plus"), (minus / others).alias("minus"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("detector_id") == name, F.lit(float(w))).otherwise(weight)
    total = flows.select("detector_id").distinct().agg(F.sum(weight).alias("w_all"))
    w = F.col("w")
    flat = one.join(flows, ["detector_id", "score"]).withColumn("w", weight)
    got = flat.groupBy("item").agg(F.count(F.lit(1)).alias("n_scores"), F.sum(w * F.col("plus")).alias("plus"), F.sum(w * F.col("minus")).alias("minus"))
    got = got.join(F.broadcast(total))  # one row
    got = got.select("item", "n_scores", F.round(F.col("plus") / F.col("w_all"), 9).alias("plus_flow"), F.round(F.col("minus") / F.col("w_all"), 9).alias("minus_flow"), F.round((F.col("plus") - F.col("minus")) / F.col("w_all"), 9).alias("net_flow"))
    got = stored(got, "flows")
    return ranked(got, "net_flow").withColumnRenamed("item", item)


def ranked(df: DataFrame, by: str, slices: int = 512) -> DataFrame:
    """Adds rank (ties share the smallest), by descending value, without sorting everything in one task."""
    cells = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    cuts = cells.agg(F.percentile_approx(by, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    cells = cells.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c > F.col(by)))).drop("_cuts")
    tot = cells.groupBy("_b").agg(F.sum("_n").alias("_t"))
    tot = tot.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # at most slices rows
    inside = Window.partitionBy("_b").orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(tot, "_b").select(by, (F.col("_o") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1).alias("rank"))
    return df.join(cells, by).select(*df.columns, "rank")
