"""Aggregates for overviews and for one loan against its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import group_quantiles
from ..functions.stats import rounded
from ..sources.readers import one_per_loan
from .ranking import clean_signals, positives

SLICE = 150_000.0
DIMENSIONS = {"state": "borrower_state", "naics": "naics_code", "lender": "originating_lender"}


def in_slice(loans: DataFrame, *columns: str, min_amount: float = SLICE) -> DataFrame:
    return one_per_loan(loans, "current_approval_amount", *columns).where(F.col("current_approval_amount") >= min_amount)


def _per_job() -> Column:
    return F.col("current_approval_amount") / F.col("jobs_reported")


def _usable(df: DataFrame) -> DataFrame:
    return df.where((F.col("jobs_reported") >= 1) & (F.col("current_approval_amount") > 0))


def slice_summary(loans: DataFrame) -> DataFrame:
    """One row: loans, sum and median of amounts, forgiven, second draws."""
    df = in_slice(loans, "forgiveness_amount", "processing_method")
    med = group_quantiles(df, [], "current_approval_amount", {"median_amount": 0.5})
    one = df.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("current_approval_amount"), 2).alias("total"), F.count_if(F.col("forgiveness_amount") > 0).alias("forgiven"), F.count_if(F.col("processing_method") == "PPS").alias("second_draw"))
    return one.join(F.broadcast(med)).select("n", "total", rounded("median_amount", 2).alias("median_amount"), "forgiven", "second_draw")  # one row each


def amount_buckets(loans: DataFrame) -> DataFrame:
    a = F.col("current_approval_amount")
    bucket = F.when(a < 350_000, "150k-350k").when(a < 1_000_000, "350k-1M").when(a < 2_000_000, "1M-2M").otherwise("2M+")
    return in_slice(loans).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("loans"))


def jobs_buckets(loans: DataFrame) -> DataFrame:
    j = F.col("jobs_reported")
    bucket = F.when(j.isNull() | (j < 1), "none").when(j == 1, "1").when(j <= 5, "2-5").when(j <= 25, "6-25").when(j <= 100, "26-100").otherwise("100+")
    return in_slice(loans, "jobs_reported").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("loans"))


def top_values(loans: DataFrame, dimension: str, by_amount: bool = False, k: int = 15) -> DataFrame:
    """The k largest groups of a dimension, by loans or by amount."""
    c = DIMENSIONS[dimension]
    value = rounded(F.sum("current_approval_amount"), 2) if by_amount else F.count(F.lit(1))
    return in_slice(loans, c).where(F.coalesce(c, F.lit("")) != "").groupBy(F.col(c).alias("key")).agg(value.alias("value")).orderBy(F.col("value").desc(), "key").limit(k)


def detector_coverage(signals: DataFrame, loans: DataFrame) -> DataFrame:
    """Different loans of the slice that each detector flags."""
    s = signals.where(F.col("loan_number").isNotNull()).select("detector_id", "loan_number").distinct()
    return s.join(in_slice(loans).select("loan_number"), "loan_number", "left_semi").groupBy("detector_id").agg(F.count(F.lit(1)).alias("flagged_loans"))


def population(loans: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: loans, loans of the slice, labelled loans of the slice."""
    l = one_per_loan(loans, "current_approval_amount").join(positives(cases).withColumn("_y", F.lit(1)), "loan_number", "left")
    big = F.col("current_approval_amount") >= SLICE
    return l.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(big).alias("n_slice"), F.count_if(big & F.col("_y").isNotNull()).alias("n_labels"))


def pay_medians(loans: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: median pay per job of the slice, and median amount and pay per job of its labelled loans."""
    df = _usable(in_slice(loans, "jobs_reported")).withColumn("_d", _per_job())
    y = df.join(positives(cases), "loan_number", "left_semi")
    a, b, c = group_quantiles(df, [], "_d", {"median_per_job": 0.5}), group_quantiles(y, [], "current_approval_amount", {"labelled_amount": 0.5}), group_quantiles(y, [], "_d", {"labelled_per_job": 0.5})
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select(*[rounded(x, 4).alias(x) for x in ("median_per_job", "labelled_amount", "labelled_per_job")])  # one row each


def percentile_of(loans: DataFrame, value: float) -> DataFrame:
    """One row: the share of the slice with less pay per job than a value, in percent."""
    df = _usable(in_slice(loans, "jobs_reported"))
    return df.agg(rounded(100.0 * F.count_if(_per_job() < value) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("percentile"))


def pay_histogram(loans: DataFrame) -> DataFrame:
    return _usable(in_slice(loans, "jobs_reported")).groupBy(F.round(F.log10(_per_job()), 1).alias("log_per_job")).agg(F.count(F.lit(1)).alias("loans"))


def sectors(loans: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """The k sectors with most loans, with labelled loans and their rate."""
    df = in_slice(loans, "naics_code").where(F.coalesce("naics_code", F.lit("")) != "").join(positives(cases).withColumn("_y", F.lit(1)), "loan_number", "left")
    g = df.groupBy(F.substring("naics_code", 1, 2).alias("sector")).agg(F.count(F.lit(1)).alias("total_loans"), F.count("_y").alias("prosecuted_loans"))
    return g.withColumn("rate_pct", F.round(100.0 * F.col("prosecuted_loans") / F.col("total_loans"), 4)).orderBy(F.col("total_loans").desc(), "sector").limit(k)


def cells(loans: DataFrame, cases: DataFrame) -> DataFrame:
    """(naics_code, state, total, prosecuted, median_per_job) of every industry and state of the slice."""
    df = in_slice(loans, "naics_code", "borrower_state", "jobs_reported").where(F.col("naics_code").isNotNull() & F.col("borrower_state").isNotNull()).join(positives(cases).withColumn("_y", F.lit(1)), "loan_number", "left").withColumn("_d", F.try_divide("current_approval_amount", F.nullif("jobs_reported", F.lit(0.0))))
    keys = ["naics_code", "borrower_state"]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("_y").alias("prosecuted"))
    return g.join(group_quantiles(df, keys, "_d", {"median_per_job": 0.5}), keys, "left").select("naics_code", F.col("borrower_state").alias("state"), "total", "prosecuted", rounded("median_per_job", 4).alias("median_per_job"))


def density_grid(loans: DataFrame, step: float = 0.05) -> DataFrame:
    """(ix, iy, n): loans by steps of the logarithms of pay per job and of the amount."""
    df = _usable(one_per_loan(loans, "current_approval_amount", "jobs_reported"))
    at = lambda c: F.floor(F.log10(c) / step + 0.5).cast("int")
    return df.groupBy(at(_per_job()).alias("ix"), at(F.col("current_approval_amount")).alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def peers(loans: DataFrame, targets: DataFrame, least: int = 30) -> DataFrame:
    """Each target's pay per job against its industry and state, or the reason why it can't be compared."""
    l = one_per_loan(loans, "naics_code", "borrower_state", "current_approval_amount", "jobs_reported").withColumn("_have", F.lit(True))
    t = targets.select("loan_number").distinct().join(l, "loan_number", "left")
    ok = _usable(l).withColumn("_d", _per_job())
    keys = ["naics_code", "borrower_state"]
    size = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("cohort_size"))
    cohort = size.join(group_quantiles(ok, keys, "_d", {"_m": 0.5}), keys)
    a, j = F.coalesce("current_approval_amount", F.lit(0.0)), F.coalesce("jobs_reported", F.lit(0.0))
    j2 = t.join(cohort, keys, "left")
    why = F.when(F.col("_have").isNull(), "loan_not_found").when((j < 1) | (a <= 0), "missing_jobs_or_amount").when(F.col("naics_code").isNull() | F.col("borrower_state").isNull(), "missing_cohort_key").when(F.coalesce("cohort_size", F.lit(0)) < least, "cohort_too_small")
    d = F.when(why.isNull(), F.try_divide("current_approval_amount", "jobs_reported"))
    return j2.select("loan_number", why.isNull().alias("available"), why.alias("reason"), F.when(why.isNull(), F.concat_ws(" | ", *keys)).alias("cohort"), F.when(why.isNull() | (why == "cohort_too_small"), F.coalesce("cohort_size", F.lit(0))).alias("cohort_size"), rounded(d, 2).alias("amount_per_job"), rounded(F.when(why.isNull(), F.col("_m")), 2).alias("cohort_median_amount_per_job"), rounded(F.try_divide(d, F.when(why.isNull(), F.col("_m"))), 2).alias("x_cohort_median"))


def raw_composite(signals: DataFrame, per_signal: float = 0.5) -> DataFrame:
    """Per loan the highest raw score plus a bonus per further signal; unlike composite() it compares no percentiles."""
    g = clean_signals(signals).groupBy("loan_number").agg((F.max("score") + per_signal * (F.count(F.lit(1)) - 1)).alias("c"), F.count(F.lit(1)).alias("n_signals"), F.array_join(F.array_sort(F.collect_set("detector_id")), ",").alias("detectors"))
    return g.select("loan_number", rounded("c", 4).alias("composite_score"), "n_signals", "detectors")


def cases_of(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """The cases of some loans, most confident first, those without a confidence last."""
    return cases.distinct().join(targets.select("loan_number").distinct(), "loan_number", "left_semi").orderBy("loan_number", F.col("match_confidence").desc_nulls_last(), "case_id")


def case_files(cases: DataFrame, loans: DataFrame, releases: DataFrame) -> DataFrame:
    """Cases with their loan and, where there is one, the title of their release."""
    c = cases.where(F.col("loan_number").isNotNull()).distinct()
    l = one_per_loan(loans, "borrower_name", "current_approval_amount")
    r = releases.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("source_url")).agg(F.min("title").alias("title"))
    return c.join(l, "loan_number").join(r, "source_url", "left").select("case_id", "loan_number", "borrower_name", "business_name", "current_approval_amount", "match_method", "match_confidence", "source_url", "title")
