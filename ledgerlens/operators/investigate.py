"""One loan, or a few, from all sides: profile, signals, peers, cases, look-alikes, and texts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import group_quantiles
from ..functions.stats import rounded
from ..sources.readers import one_per_loan
from .profile import SLICE, cases_of, peers, raw_composite
from .ranking import positives
from .similar import similar_loans

PROFILE = ("borrower_name", "borrower_address", "borrower_city", "borrower_state", "borrower_zip", "naics_code", "business_type", "current_approval_amount", "jobs_reported", "date_approved", "loan_status", "originating_lender", "forgiveness_amount")


def loan_profile(loans: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target with the columns of PROFILE, pay per job, and found; targets that aren't there have nulls."""
    l = one_per_loan(loans, *PROFILE).withColumn("_have", F.lit(True))
    per_job = F.when(F.col("jobs_reported") >= 1, rounded(F.col("current_approval_amount") / F.col("jobs_reported"), 2))
    return targets.select("loan_number").distinct().join(l, "loan_number", "left").select("loan_number", F.col("_have").isNotNull().alias("found"), *PROFILE, per_job.alias("amount_per_job"))


def loan_signals(signals: DataFrame, targets: DataFrame) -> DataFrame:
    """(loan_number, detector_id, score, evidence_json) of the targets, each row once, highest scores first."""
    s = signals.select("loan_number", "detector_id", "score", "evidence_json").distinct().join(targets.select("loan_number").distinct(), "loan_number", "left_semi")
    return s.orderBy("loan_number", F.col("score").desc_nulls_last(), "detector_id")


def _list(df: DataFrame, key: str, name: str, order: str, *columns: str, most: int | None = None) -> DataFrame:
    """(loan_number, name): rows of each loan as a JSON array, in an order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    items = F.transform(F.slice(rows, 1, most) if most else rows, lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return df.groupBy(F.col(key).alias("loan_number")).agg(F.to_json(items, {"ignoreNullFields": "false"}).alias(name))


def investigate(loans: DataFrame, signals: DataFrame, cases: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """One row a target: found, and profile, signals, composite, peers, cases and similar, each as JSON or null.

    Everything is a join on the targets; nothing is looked up loan by loan.
    """
    t = targets.select("loan_number").distinct()
    packed = lambda df, name: df.select("loan_number", F.to_json(F.struct(*[c for c in df.columns if c != "loan_number"]), {"ignoreNullFields": "false"}).alias(name))
    profile = loan_profile(loans, t)
    mine = signals.join(t, "loan_number", "left_semi")
    near = similar_loans(loans, t, cases, k)
    parts = [
        packed(profile.drop("found"), "profile"), packed(raw_composite(mine), "composite"), packed(peers(loans, t), "peers"),
        _list(loan_signals(signals, t).withColumn("_by", -F.col("score")), "loan_number", "signals", "_by", "detector_id", "score", "evidence_json"),
        _list(cases_of(cases, t).withColumn("_by", -F.coalesce("match_confidence", F.lit(-1.0))), "loan_number", "cases", "_by", "case_id", "business_name", "source_url", "match_method", "match_confidence"),
        _list(near, "target", "similar", "rank", "rank", "loan_number", "borrower_name", "fused_score", "is_fraud"),
    ]
    got = profile.select("loan_number", "found")
    for p in parts:
        got = got.join(p, "loan_number", "left")
    return got.withColumn("profile", F.when(F.col("found"), F.col("profile")))


def neighbour_summary(near: DataFrame) -> DataFrame:
    """(loan_number, summary): one sentence on the look-alikes of each target of similar_loans()."""
    g = near.groupBy(F.col("target").alias("loan_number")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_fraud")).alias("y"), F.count_if(F.col("same_naics")).alias("i"), F.count_if(F.col("same_zip5")).alias("z"), F.avg("amount_delta_pct").alias("d"), F.min_by("borrower_name", "rank").alias("first"))
    text = F.format_string("%d look-alikes; closest: %s. %d of the same industry, %d of the same post code, amounts %s %% apart on average. %d appear in a case.", "n", F.coalesce("first", F.lit("?")), "i", "z", F.format_number(100 * F.col("d"), 1), "y")
    return g.select("loan_number", text.alias("summary"))


def pattern_comparison(loans: DataFrame, cases: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target against the slice: base rate, pay per job relative to the medians of all and of labelled loans, the rate of its industry and state, and whether its sector is the one with most labelled loans."""
    base = one_per_loan(loans, "naics_code", "borrower_state", "current_approval_amount", "jobs_reported").join(positives(cases).withColumn("_y", F.lit(1)), "loan_number", "left")
    inside = base.where(F.col("current_approval_amount") >= SLICE)
    d = F.when((F.col("jobs_reported") >= 1) & (F.col("current_approval_amount") > 0), F.col("current_approval_amount") / F.col("jobs_reported"))
    paid = inside.withColumn("_d", d).where(F.col("_d").isNotNull())
    sector = F.substring("naics_code", 1, 2)
    top = inside.where(F.col("_y").isNotNull() & (F.length(sector) == 2)).groupBy(sector.alias("s")).agg(F.count(F.lit(1)).alias("c")).agg(F.min_by("s", F.struct(-F.col("c"), "s")).alias("_top"))
    one = inside.agg(F.try_divide(F.count("_y"), F.count(F.lit(1))).alias("base_rate"))
    for part in (group_quantiles(paid, [], "_d", {"_all": 0.5}), group_quantiles(paid.where("_y is not null"), [], "_d", {"_labelled": 0.5}), top):
        one = one.join(F.broadcast(part))  # one row each
    cell = inside.groupBy("naics_code", "borrower_state").agg(F.try_divide(F.count("_y"), F.count(F.lit(1))).alias("cell_rate"))
    t = base.join(targets.select("loan_number").distinct(), "loan_number", "left_semi").withColumn("_d", d).join(cell, ["naics_code", "borrower_state"], "left").join(F.broadcast(one))
    off = lambda m: rounded(F.try_divide(F.col("_d") - F.col(m), F.col(m)), 6)
    return t.select("loan_number", rounded("_d", 4).alias("amount_per_job"), rounded("base_rate", 6).alias("base_rate"), off("_all").alias("off_median"), off("_labelled").alias("off_labelled_median"), rounded("cell_rate", 6).alias("cell_rate"), (sector == F.col("_top")).alias("top_sector"))


def exact_tier(cases: DataFrame) -> DataFrame:
    """Cases whose match method is known and doesn't come from a language model."""
    return cases.where(~F.col("match_method").ilike("%llm%"))


def snippet(text: Column, needle: Column, around: int = 180) -> Column:
    """The surroundings of the first place where needle stands in a text; the beginning where it doesn't."""
    at = F.greatest(F.instr(text, needle), F.lit(1))
    start = F.greatest(at - around, F.lit(1))
    return F.substring(text, start, at + F.length(needle) + around - start)


def distinctive_tokens(text: Column, common: tuple[str, ...], least: int = 4) -> Column:
    """Different words of `least` letters and more of a text that aren't common ones, in capitals and sorted."""
    words = F.split(F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*common))))


def sampled(df: DataFrame, n: int, key: str = "loan_number", seed: int = 0) -> DataFrame:
    """n rows of df, as good as drawn at random: those with the smallest hashes of key and seed. Filter before, not after."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
