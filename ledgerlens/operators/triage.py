"""The head of a ranking before a judge: candidates, judged in batches, ranked again, and held against the ranking."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import with_ranks
from ..functions.stats import rounded
from ..functions.store import stored
from ..sources.readers import one_per_loan
from .ranking import KS, composite, metrics_at, ranked

MOST = 2000
#: What a judge's importance adds at most, and the scale on which it is given.
BONUS, SCALE = 0.5, 3.0
Judge = Callable[[pd.DataFrame], pd.DataFrame]


def candidates(signals: DataFrame, loans: DataFrame, top: int = 100) -> DataFrame:
    """The first loans of the composite ranking (0 to MOST of them) with what a judge may want to see."""
    top = max(0, min(top, MOST))
    head = ranked(composite(signals, loans), head=top) if top else ranked(composite(signals, loans), head=1).limit(0)
    more = one_per_loan(loans, "payroll_proceed", "business_type", "business_age_description", "borrower_city")
    return head.join(more, "loan_number", "left")


def judged(cands: DataFrame, judge: Judge, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """cands with importance (0 to SCALE), reason and failed.

    judge takes and gives a pandas frame of many candidates and adds importance and reason; it runs in Arrow batches on
    the executors. A batch that fails is tried again up to `retries` times, then its loans are neutral: importance 0
    and failed. Answers outside of the scale are cut to it, those that are no number are neutral.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = None
            for attempt in range(retries + 1):
                try:
                    said = judge(b.copy())
                    break
                except Exception:  # noqa: BLE001
                    time.sleep(wait * 2**attempt)
            value = pd.to_numeric(said["importance"], errors="coerce") if said is not None else pd.Series(float("nan"), b.index)
            reason = said["reason"].astype(object) if said is not None else pd.Series(None, b.index, dtype=object)
            yield b.assign(importance=value.clip(0, SCALE).fillna(0.0).astype(float).to_numpy(), reason=reason.to_numpy(), failed=value.isna().to_numpy())

    return cands.mapInPandas(run, f"{kind}, importance double, reason string, failed boolean")


def reranked(cands: DataFrame, bonus: float = BONUS) -> DataFrame:
    """Judged candidates in the order of composite score plus importance; equal ones keep their order."""
    score = F.col("composite_score") + bonus * F.col("importance") / SCALE
    return with_ranks(cands.withColumn("triage_score", score), [F.col("triage_score").desc(), F.col("rank")], "triage_rank")


def triage(signals: DataFrame, loans: DataFrame, judge: Judge, top: int = 100, **options) -> tuple[DataFrame, dict[str, int]]:
    """(reranked candidates, counts): n_candidates, n_raised (importance above 0) and n_failed."""
    got = stored(judged(candidates(signals, loans, top), judge, **options), "judged")
    n, up, bad = got.agg(F.count(F.lit(1)), F.count_if(F.col("importance") > 0), F.count_if(F.col("failed"))).first()
    return reranked(got), {"n_candidates": n, "n_raised": up, "n_failed": bad}


def gate(before: DataFrame, after: DataFrame, known: DataFrame, population: int, ks: tuple[int, ...] = (25, 50, 100, 250)) -> DataFrame:
    """(k, hits_before, hits_after, lift_before, lift_after, verdict): whether a new ranking finds known positives sooner.

    Both are tables of (loan_number, rank). The verdict, the same in every row, is improved, regressed or neutral by
    the sum of the changes of lift.
    """
    a, b = (metrics_at(r, known, population, ks).select("k", F.col("hits").alias(f"hits_{n}"), F.coalesce("lift", F.lit(0.0)).alias(f"lift_{n}")) for r, n in ((before, "before"), (after, "after")))
    both = stored(a.join(b, "k"), "gate")
    change = both.agg(F.coalesce(F.sum(F.col("lift_after") - F.col("lift_before")), F.lit(0.0)).alias("d"))
    verdict = F.when(F.col("d") > 1e-9, "improved").when(F.col("d") < -1e-9, "regressed").otherwise("neutral")
    return both.join(F.broadcast(change.select(verdict.alias("verdict"))))  # one row


def ranks_after(full: DataFrame, head: DataFrame) -> DataFrame:
    """(loan_number, rank): a whole ranking whose head has been ranked again; the rest follows in its old order."""
    new = head.select("loan_number", F.col("triage_rank").alias("_new"))
    return with_ranks(full.select("loan_number", F.col("rank").alias("_old")).join(new, "loan_number", "left"), [F.col("_new").asc_nulls_last(), F.col("_old")]).select("loan_number", "rank")


def lift_curve(ranking: DataFrame, known: DataFrame, population: int, points: int = 40, ks: tuple[int, ...] = KS) -> DataFrame:
    """metrics_at() for the ks and for about `points` more, evenly spaced by logarithm up to the population."""
    spaced = {max(1, round(population ** (i / (points - 1)))) for i in range(points)} if population > 1 else set()
    return metrics_at(ranking, known, population, tuple(sorted({k for k in {*spaced, *ks} if k <= max(population, 1)})))


def flag_rate(signals: DataFrame, loans: DataFrame) -> DataFrame:
    """(detector_id, n, share): how many loans each detector flags, and the share of all loans."""
    n = one_per_loan(loans, "current_approval_amount").agg(F.count(F.lit(1)).alias("_all"))
    s = signals.where(F.col("loan_number").isNotNull()).select("detector_id", "loan_number").distinct().groupBy("detector_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(F.broadcast(n)).select("detector_id", "n", rounded(F.col("n") / F.nullif(F.col("_all"), F.lit(0)), 6).alias("share"))  # one row
