"""Composite ranking, baselines, and how well a ranking concentrates known positives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import group_quantiles, with_cume_dist, with_ranks
from ..functions.stats import rounded
from ..sources.readers import one_per_loan

#: Borders between 0, 1, 2, ... of a Poisson(1) draw among the numbers below PRIME.
PRIME = 2147483647
POISSON = tuple(int(PRIME * np.exp(-1.0) * sum(1 / math.factorial(j) for j in range(i + 1))) for i in range(12))
KS = (100, 250, 500, 1000, 2000, 5000)


def clean_signals(signals: DataFrame) -> DataFrame:
    """Signals with a loan, a detector and a score; repeated rows count once."""
    return signals.where(F.col("loan_number").isNotNull() & F.col("detector_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).select("loan_number", "detector_id", "score").distinct()


def composite(signals: DataFrame, loans: DataFrame, per_signal: float = 0.5) -> DataFrame:
    """One row per flagged loan: the best percentile of its scores within their detectors, plus a bonus per further signal.

    Percentiles are cumulative shares within the detector, so every detector counts alike. Loans without a signal
    don't appear; signals of unknown loans do, without loan columns.
    """
    pct = with_cume_dist(clean_signals(signals), ["detector_id"], "score", "pct")
    per = pct.groupBy("loan_number").agg((F.max("pct") + per_signal * (F.count(F.lit(1)) - 1)).alias("composite_score"), F.count(F.lit(1)).alias("n_signals"), F.array_sort(F.collect_set("detector_id")).alias("detectors"))
    l = one_per_loan(loans, "borrower_name", "naics_code", "borrower_state", "current_approval_amount", "jobs_reported")
    return per.join(l, "loan_number", "left").select("loan_number", "borrower_name", "naics_code", F.col("borrower_state").alias("state"), F.col("current_approval_amount").alias("amount"), "jobs_reported", "composite_score", "n_signals", "detectors")


def ranked(df: DataFrame, score: str = "composite_score", head: int | None = None) -> DataFrame:
    """Rows with rank 1 for the highest score; equal scores by loan number."""
    return with_ranks(df, [F.col(score).desc(), F.col("loan_number")], head=head)


def baseline(loans: DataFrame, kind: str) -> DataFrame:
    """(loan_number, score) of the whole population: amount_per_job or raw_amount."""
    l = one_per_loan(loans, "current_approval_amount", "jobs_reported").where((F.col("jobs_reported") >= 1) & (F.col("current_approval_amount") > 0))
    score = {"amount_per_job": F.col("current_approval_amount") / F.col("jobs_reported"), "raw_amount": F.col("current_approval_amount")}[kind]
    return l.select("loan_number", score.alias("score"))


def positives(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("loan_number").isNotNull()).select("loan_number").distinct()


def temporal_split(cases: DataFrame, year: int) -> DataFrame:
    """(loan_number, part): train up to the year of the earliest charge, test after it; undated loans drop."""
    first = cases.where(F.col("loan_number").isNotNull() & F.col("charge_date").isNotNull()).groupBy("loan_number").agg(F.min("charge_date").alias("d"))
    return first.select("loan_number", F.when(F.year("d") <= year, "train").otherwise("test").alias("part"))


def restrict(ranking: DataFrame, universe: DataFrame) -> DataFrame:
    """The ranking's loans that are in the universe, ranked anew in the same order."""
    kept = ranking.join(universe.select("loan_number").distinct(), "loan_number", "left_semi").withColumnRenamed("rank", "_old")
    return with_ranks(kept, [F.col("_old"), F.col("loan_number")]).drop("_old")


def slice_universe(loans: DataFrame, min_amount: float | None = 150_000.0) -> DataFrame:
    """(loan_number) of the loans from an amount on; of all loans if it is None."""
    l = one_per_loan(loans, "current_approval_amount")
    return (l if min_amount is None else l.where(F.col("current_approval_amount") >= min_amount)).select("loan_number")


def metrics_at(ranking: DataFrame, known: DataFrame, population: int | None = None, ks: tuple[int, ...] = KS, head_only: bool = True) -> DataFrame:
    """(k, hits, precision, lift, recall) of a ranking(loan_number, rank).

    Only the ranks of known positives are looked at: one semi join, one aggregate. Precision divides by k, lift by the
    share of positives in the population; null where that is 0.
    """
    known = known.select("loan_number").distinct()
    hits = ranking.join(known, "loan_number", "left_semi").select("rank")
    row = hits.agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks])
    n = known.agg(F.count(F.lit(1)).alias("n_pos"))
    wide = row.join(F.broadcast(n))  # one row each
    long = wide.select("n_pos", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("m")).select("n_pos", "m.k", "m.hits")
    base = F.col("n_pos") / F.lit(float(population)) if population else F.lit(None).cast("double")
    precision = F.col("hits") / F.col("k")
    return long.select("k", "hits", rounded(precision, 5).alias("precision"), rounded(F.when(base > 0, precision / base), 2).alias("lift"), rounded(F.when(F.col("n_pos") > 0, F.col("hits") / F.col("n_pos")), 4).alias("recall"))


def positive_rank_stats(ranking: DataFrame, known: DataFrame, population: int) -> DataFrame:
    """One row on where known positives stand: coverage, mean and median rank, mean percentile, and with the unranked at the end."""
    known = known.select("loan_number").distinct()
    at = ranking.join(known, "loan_number", "left_semi").select(F.col("rank").cast("double").alias("rank"))
    size = ranking.agg(F.count(F.lit(1)).alias("n_in_ranking"))
    n = known.agg(F.count(F.lit(1)).alias("n_positives"))
    med = group_quantiles(at, [], "rank", {"median": 0.5})
    one = at.agg(F.count(F.lit(1)).alias("n_ranked"), F.avg("rank").alias("mean"), F.sum("rank").alias("total"))
    row = one.join(F.broadcast(med)).join(F.broadcast(size)).join(F.broadcast(n))  # one row each
    unranked = F.col("n_positives") - F.col("n_ranked")
    return row.select(
        "n_positives", "n_ranked", unranked.alias("n_unranked"), "n_in_ranking", rounded("mean", 1).alias("mean_rank_ranked"), rounded("median", 1).alias("median_rank_ranked"),
        rounded(F.when(F.col("n_in_ranking") > 0, F.col("mean") / F.col("n_in_ranking")), 4).alias("mean_percentile_in_ranking"),
        rounded(F.when(F.col("n_positives") > 0, (F.coalesce("total", F.lit(0.0)) + unranked * population) / F.col("n_positives") / population), 4).alias("mean_percentile_population_conservative"),
    )


def overlap(signals: DataFrame, a: str, b: str) -> DataFrame:
    """One row: sizes of two detectors' flagged sets, of both, of either, and their Jaccard index."""
    per = signals.where(F.col("detector_id").isin(a, b) & F.col("loan_number").isNotNull()).groupBy("loan_number").agg(F.max((F.col("detector_id") == a).cast("int")).alias("a"), F.max((F.col("detector_id") == b).cast("int")).alias("b"))
    n = per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("intersection"), F.count(F.lit(1)).alias("union"))
    return n.withColumn("jaccard", rounded(F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0), 6))


def fuse(rankings: list[DataFrame], weights: list[float] | None = None, k: int = 60, head: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank); equal sums by loan number. ValueError if weights don't match."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("one weight for each ranking")
    parts = [r.select("loan_number", (F.lit(w) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("i")) for i, (r, w) in enumerate(zip(rankings, weights))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    # summed in a fixed order, so that equal inputs give equal sums
    fused = all_.groupBy("loan_number").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("i", "s"))), F.lit(0.0), lambda t, x: t + x["s"]).alias("fused_score"))
    return with_ranks(fused, [F.col("fused_score").desc(), F.col("loan_number")], head=head)


def drawn(replicate: int, places: np.ndarray) -> np.ndarray:
    """How often each place is drawn in a replicate: Poisson(1) numbers by whole-number arithmetic, as SQL can do it."""
    u = ((replicate * 48271 + places * 69621 + 12345) % PRIME * 16807 + places * 40692 + replicate) % PRIME
    v = (u * 39373 + replicate * 16807) % PRIME
    return np.searchsorted(np.array(POISSON), v, "right")


def bootstrap_intervals(ranking: DataFrame, known: DataFrame, population: int, ks: tuple[int, ...] = KS, n_boot: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(k, hits_low, hits_high, lift_low, lift_high): percentile intervals of a Poisson bootstrap of the ranking.

    Every ranked loan is drawn Poisson(1) times in a replicate. Only places up to about max(ks) matter, so what the
    executors get is the ranks of the positives among the first 5 * max(ks) places: bounded by ks, not by the data.
    Replicates run in parallel and draw by their number, so results don't depend on the partitioning.
    """
    spark = ranking.sparkSession
    head = 5 * max(ks)
    n = ranking.where(F.col("rank") <= head).count()
    at = np.array(sorted(r[0] for r in ranking.where(F.col("rank") <= head).join(known.select("loan_number").distinct(), "loan_number", "left_semi").select("rank").collect()), int) - 1
    n_pos = known.select("loan_number").distinct().count()

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = np.zeros(n)
        y[at[at < n]] = 1
        for b in batches:
            rows = []
            for i in b["id"]:
                m = drawn(int(i), np.arange(1, n + 1, dtype=np.int64))
                cum, taken = np.cumsum(m), np.cumsum(y * m)
                for k in ks:
                    j = int(np.searchsorted(cum, k)) if n else 0
                    rows.append((k, float(taken[-1]) if n and j >= n else float((taken[j - 1] if j else 0) + y[j] * (k - (cum[j - 1] if j else 0))) if n else 0.0))
            yield pd.DataFrame(rows, columns=["k", "hits"])

    hits = spark.range(n_boot, numPartitions=min(64, n_boot)).mapInPandas(replicate, "k int, hits double")
    q = hits.groupBy("k").agg(F.percentile("hits", [alpha / 2, 1 - alpha / 2]).alias("q"))  # n_boot rows a group
    base = n_pos / population if population else 0
    lift = lambda c: rounded(c / F.col("k") / base, 2) if base else F.lit(0.0)
    return q.select("k", rounded(F.col("q")[0], 1).alias("hits_low"), rounded(F.col("q")[1], 1).alias("hits_high"), lift(F.col("q")[0]).alias("lift_low"), lift(F.col("q")[1]).alias("lift_high"))
