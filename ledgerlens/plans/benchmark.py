"""The whole evaluation: rank, restrict, measure, against baselines and detector by detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators.ranking import KS, baseline, bootstrap_intervals, clean_signals, composite, metrics_at, positive_rank_stats, positives, ranked, restrict, slice_universe, temporal_split
from ..sources.readers import one_per_loan


def benchmark(signals: DataFrame, loans: DataFrame, cases: DataFrame, ks: tuple[int, ...] = KS, min_amount: float | None = 150_000.0) -> DataFrame:
    """(ranking, k, hits, precision, lift, recall) of the composite, each detector alone and the baselines, in the slice.

    Known positives are those of the slice, and so is the population. Only counts leave the executors.
    """
    universe = stored(slice_universe(loans, min_amount), "universe")
    known = stored(positives(cases).join(universe, "loan_number", "left_semi"), "positives")
    n = universe.count()
    rankings = {"composite": restrict(ranked(composite(signals, loans).select("loan_number", "composite_score")), universe)}
    best = stored(clean_signals(signals).groupBy("detector_id", "loan_number").agg(F.max("score").alias("score")), "detector_scores")
    for d in sorted(r[0] for r in best.select("detector_id").distinct().collect()):  # one row a detector
        rankings[d] = restrict(ranked(best.where(F.col("detector_id") == d), "score"), universe)
    for b in ("amount_per_job", "raw_amount"):
        rankings[b] = restrict(ranked(baseline(loans, b), "score"), universe)
    out = None
    for name, r in rankings.items():
        m = metrics_at(r, known, n, ks).withColumn("ranking", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("ranking", "k", "hits", "precision", "lift", "recall")


def full_benchmark(signals: DataFrame, loans: DataFrame, cases: DataFrame, ks: tuple[int, ...] = KS, min_amount: float | None = 150_000.0, n_boot: int = 2000) -> dict:
    """The whole evaluation as one dict of small tables: benchmark() with intervals and positive ranks of the composite.

    With min_amount None the whole population is looked at, else the slice from that amount on. Nothing but counts,
    metrics and intervals reaches the driver.
    """
    universe = stored(slice_universe(loans, min_amount), "universe")
    known = stored(positives(cases).join(universe, "loan_number", "left_semi"), "positives")
    n, y = universe.count(), known.count()
    best = stored(restrict(ranked(composite(signals, loans).select("loan_number", "composite_score")), universe).select("loan_number", "rank"), "ranking")
    rows = lambda df: [r.asDict() for r in df.collect()]
    table = rows(benchmark(signals, loans, cases, ks, min_amount).orderBy("ranking", "k"))
    of = lambda names: [r for r in table if r["ranking"] in names]
    basic = {"composite", "amount_per_job", "raw_amount"}
    return {
        "ks": list(ks), "slice": min_amount, "full_population": min_amount is None, "population": n, "n_labeled_fraud": y, "base_rate": y / n if n else 0.0, "n_ranked": best.count(), "n_boot": n_boot,
        "overall": of({"composite"}), "overall_ci": rows(bootstrap_intervals(best, known, n, ks, n_boot).orderBy("k")) if n_boot else [], "positive_ranks": rows(positive_rank_stats(best, known, n))[0] if n else {},
        "baselines": of({"amount_per_job", "raw_amount"}), "ablation": [r for r in table if r["ranking"] not in basic],
    }


def validate_ranking(ranking: DataFrame, signals: DataFrame, loans: DataFrame, cases: DataFrame, year: int = 2022, ks: tuple[int, ...] = KS) -> DataFrame:
    """(ranking, k, hits, precision, lift, recall) of any ranking(loan_number, rank) and of the composite, on charges after a year.

    What every check of a detector or scorer comes down to: training positives leave both rankings and the population.
    """
    split = stored(temporal_split(cases, year), "split")
    rest = stored(one_per_loan(loans, "current_approval_amount").select("loan_number").join(split.where("part = 'train'"), "loan_number", "left_anti"), "rest")
    test = stored(split.where("part = 'test'").select("loan_number").join(rest, "loan_number", "left_semi"), "test")
    n = rest.count()
    a = metrics_at(restrict(ranking, rest), test, n, ks).withColumn("ranking", F.lit("tested"))
    b = metrics_at(restrict(ranked(composite(signals, loans)), rest), test, n, ks).withColumn("ranking", F.lit("composite"))
    return a.unionByName(b).select("ranking", "k", "hits", "precision", "lift", "recall")
