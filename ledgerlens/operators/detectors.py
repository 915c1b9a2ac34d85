"""Detectors: loans in, one row per flagged loan out: loan_number, score and the evidence as typed columns.

None of them sees labels. Thresholds and caps are parameters. as_signals() packs any of them into the common contract
(loan_number, detector_id, score, evidence_json). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.embed import embed
from ..functions.ordered import group_quantiles, with_q_values, with_ranks
from ..functions.stats import rounded, upper_tail_p, with_robust_z
from ..functions.store import stored
from ..sources.readers import one_per_loan

# Monthly pay caps by industry, sector titles, recency tells.
CAPS = {"72": 29166.67, "": 20833.33}
SECTORS = {
    "11": "Agriculture, Forestry, Fishing and Hunting",
    "21": "Mining, Quarrying, and Oil and Gas Extraction",
    "22": "Utilities",
    "23": "Construction",
    "31": "Manufacturing",
    "32": "Manufacturing",
    "33": "Manufacturing",
    "42": "Wholesale Trade",
    "44": "Retail Trade",
    "45": "Retail Trade",
    "48": "Transportation and Warehousing",
    "49": "Transportation and Warehousing",
    "51": "Information",
    "52": "Finance and Insurance",
    "53": "Real Estate and Rental and Leasing",
    "54": "Professional, Scientific, and Technical Services",
    "55": "Management of Companies and Enterprises",
    "56": "Administrative and Support and Waste Management and Remediation Services",
    "61": "Educational Services",
    "62": "Health Care and Social Assistance",
    "71": "Arts, Entertainment, and Recreation",
    "72": "Accommodation and Food Services",
    "81": "Other Services (except Public Administration)",
    "92": "Public Administration",
}
RECENCY = {"startup, loan funds will open business": 3.0, "new business or 2 years or less": 2.0, "change of ownership": 1.0}
#: Titles that go to the executors at a time.
TITLE_BLOCK = 4096
#: Loan numbers of an entity, and names of a building, that the evidence lists.
LISTED, SAMPLED = 25, 10


def cap_of(naics: str | Column = "naics_code") -> Column:
    c = F.col(naics) if isinstance(naics, str) else naics
    return F.when(c.startswith("72"), CAPS["72"]).otherwise(CAPS[""])


def usable(loans: DataFrame) -> DataFrame:
    """At least one job and a positive amount; pushed down to the scan."""
    return loans.where((F.col("jobs_reported") >= 1) & (F.col("current_approval_amount") > 0))


def cohort_outlier(loans: DataFrame, min_cohort_size: int = 30, fdr: float = 0.01, min_z: float = 3.0, min_mad: float = 0.05) -> DataFrame:
    """Pay per job far above the median of the same industry and state, false discoveries controlled over all cohorts."""
    base = usable(one_per_loan(loans, "borrower_name", "naics_code", "borrower_state", "current_approval_amount", "jobs_reported")).where(F.col("naics_code").isNotNull() & F.col("borrower_state").isNotNull())
    per_job = F.col("current_approval_amount") / F.col("jobs_reported")
    base = base.select("loan_number", "borrower_name", "naics_code", F.col("borrower_state").alias("state"), F.col("current_approval_amount").alias("amount"), "jobs_reported", per_job.alias("amount_per_job"), F.log1p(per_job).alias("_x"), F.concat_ws(" | ", "naics_code", "borrower_state").alias("cohort"))
    size = base.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size")).where(F.col("cohort_size") >= min_cohort_size)
    base = stored(base.join(size, "cohort"), "cohorts")
    rows = with_robust_z(base, ["cohort"], "_x", min_mad, "_z").withColumn("_z", F.greatest(F.coalesce("_z", F.lit(0.0)), F.lit(0.0)))
    rows = with_q_values(rows.withColumn("p_value", upper_tail_p(F.col("_z"))))
    raw = group_quantiles(base, ["cohort"], "amount_per_job", {"cohort_median_amount_per_job": 0.5})
    hit = rows.where((F.col("q_value") <= fdr) & (F.col("_z") >= min_z)).join(raw, "cohort")
    return hit.select(
        "loan_number", rounded("_z", 4).alias("score"), "cohort", "cohort_size", "naics_code", "state", "borrower_name", "amount", "jobs_reported", rounded("amount_per_job", 2).alias("amount_per_job"), rounded("cohort_median_amount_per_job", 2).alias("cohort_median_amount_per_job"),
        rounded(F.col("amount_per_job") / F.col("cohort_median_amount_per_job"), 2).alias("x_cohort_median"), rounded("_z", 4).alias("robust_z"), rounded("p_value", 6).alias("p_value"), rounded("q_value", 6).alias("q_value"), F.lit(fdr).alias("fdr_target"),
    )


def cap_exceedance(loans: DataFrame, min_ratio: float = 1.5) -> DataFrame:
    """Pay per job at least min_ratio times the cap."""
    base = usable(one_per_loan(loans, "borrower_name", "naics_code", "borrower_state", "current_approval_amount", "jobs_reported"))
    per_job = F.col("current_approval_amount") / F.col("jobs_reported")
    ratio = per_job / cap_of()
    return base.where(ratio >= min_ratio).select("loan_number", rounded(ratio, 4).alias("score"), "naics_code", F.col("borrower_state").alias("state"), "borrower_name", F.col("current_approval_amount").alias("amount"), "jobs_reported", rounded(per_job, 2).alias("amount_per_job"), cap_of().alias("per_employee_cap"), rounded(ratio, 2).alias("x_cap"))


def smallest(df: DataFrame, key: str, value: str, k: int, name: str) -> DataFrame:
    """(key, name): the k smallest different values of each key, as an array.

    Limits on row numbers are applied before the shuffle too, so no task holds the values of a large group.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return df.select(key, value).distinct().withColumn("_n", first).where(F.col("_n") <= k).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


_ADDRESS = ("borrower_address", "borrower_city", "borrower_state", "borrower_zip")


def multiple_funded(loans: DataFrame) -> DataFrame:
    """Loans of an entity (name at a building) with more than one loan in a draw, or more than two in all."""
    base = one_per_loan(loans, "borrower_name", *_ADDRESS, "processing_method", "current_approval_amount").select("loan_number", text.entity_key().alias("entity_key"), "processing_method", F.col("current_approval_amount").alias("amount")).where(F.col("entity_key").isNotNull())
    draws = base.groupBy("entity_key", F.coalesce("processing_method", F.lit("")).alias("draw")).agg(F.count(F.lit(1)).alias("c"), F.sum("amount").alias("s"))
    per = draws.groupBy("entity_key").agg(F.sum("c").alias("n_loans"), F.sum(F.greatest(F.col("c") - 1, F.lit(0))).alias("_within"), F.sum("s").alias("total_amount"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("draw", "c")))).alias("per_draw_counts"))
    per = stored(per.withColumn("excess_loans", F.greatest(F.col("_within"), F.col("n_loans") - 2)).where("excess_loans > 0"), "multiple")
    hit = base.join(per.select("entity_key"), "entity_key", "left_semi")
    numbers = smallest(hit, "entity_key", "loan_number", LISTED, "_numbers")
    return base.join(per, "entity_key").join(numbers, "entity_key").select("loan_number", rounded(F.col("excess_loans").cast("double"), 4).alias("score"), "entity_key", "n_loans", "excess_loans", F.to_json("per_draw_counts").alias("per_draw_counts"), rounded("total_amount", 2).alias("total_amount"), F.col("_numbers").alias("loan_numbers"))


def address_ring(loans: DataFrame, min_ring_size: int = 3) -> DataFrame:
    """Buildings shared by several different borrower names; blank names don't count, but their loans are flagged."""
    base = one_per_loan(loans, "borrower_name", *_ADDRESS, "current_approval_amount").select("loan_number", "borrower_name", text.building_key().alias("normalized_address"), F.col("current_approval_amount").alias("amount")).where(F.col("normalized_address").isNotNull())
    # distinct names are counted in two steps, so a building with a third of all loans is spread over tasks
    names = base.groupBy("normalized_address", "borrower_name").agg(F.count(F.lit(1)).alias("c"), F.sum("amount").alias("s"))
    per = names.groupBy("normalized_address").agg(F.count(F.when(F.trim("borrower_name") != "", 1)).alias("ring_size"), F.sum("c").alias("n_loans"), F.sum("s").alias("_sum"))
    per = stored(per.where(F.col("ring_size") >= min_ring_size).withColumn("total_ring_amount", rounded(F.coalesce("_sum", F.lit(0.0)), 2)), "rings")
    some = smallest(names.where(F.trim("borrower_name") != "").join(per.select("normalized_address"), "normalized_address", "left_semi"), "normalized_address", "borrower_name", SAMPLED, "_names")
    score = F.log1p("ring_size") + F.log1p("total_ring_amount")
    return base.join(per, "normalized_address").join(some, "normalized_address").select("loan_number", rounded(score, 4).alias("score"), "normalized_address", "ring_size", "n_loans", "total_ring_amount", F.col("_names").alias("borrower_names_sample"))


def amount_anomaly(loans: DataFrame, cap_band: float = 0.05) -> DataFrame:
    """Round amounts, and amounts just below the cap per job."""
    base = one_per_loan(loans, "borrower_name", "naics_code", "borrower_state", "current_approval_amount", "jobs_reported").where(F.col("current_approval_amount") > 0)
    cents = rounded(F.col("current_approval_amount") * 100, 0).cast("long")
    divisor = F.when(cents % 1_000_000 == 0, 10_000).when(cents % 500_000 == 0, 5_000).when(cents % 100_000 == 0, 1_000)
    share = F.when(divisor == 10_000, 1.0).when(divisor == 5_000, 0.66).when(divisor == 1_000, 0.33).otherwise(0.0)
    cap, per_job = cap_of(), F.when(F.col("jobs_reported") >= 1, F.col("current_approval_amount") / F.col("jobs_reported"))
    low = cap * (1 - cap_band)
    near = F.when((per_job >= low) & (per_job <= cap), (per_job - low) / (cap - low)).otherwise(0.0)
    fired = F.concat_ws(",", F.when(near > 0, "cap_maximization"), F.when(share > 0, "round_amount"))
    return base.withColumn("_r", share).withColumn("_n", near).where("_r + _n > 0").select(
        "loan_number", rounded(F.col("_r") + F.col("_n"), 4).alias("score"), "naics_code", F.col("borrower_state").alias("state"), "borrower_name", F.col("current_approval_amount").alias("amount"), "jobs_reported", divisor.alias("round_divisor"), rounded("_r", 4).alias("round_score"),
        rounded(per_job, 2).alias("per_employee_amount"), cap.alias("per_employee_cap"), rounded("_n", 4).alias("cap_maximization_score"), fired.alias("signals_fired"),
    )


def establishment_overcount(loans: DataFrame, establishments: DataFrame, min_ratio: float = 4.0, naics_digits: int = 6) -> DataFrame:
    """More loans in a post code and industry than establishments counted there; cells without a count are skipped."""
    z, n = F.substring(F.trim("borrower_zip"), 1, 5), F.substring(F.trim("naics_code"), 1, naics_digits)
    base = one_per_loan(loans, "borrower_zip", "naics_code").select("loan_number", z.alias("zip"), n.alias("naics_cell")).where((F.coalesce("zip", F.lit("")) != "") & (F.coalesce("naics_cell", F.lit("")) != ""))
    cells = base.groupBy("zip", "naics_cell").agg(F.count(F.lit(1)).alias("ppp_loan_count"))
    known = establishments.where(F.col("establishments").isNotNull()).groupBy(F.substring(F.trim("zip"), 1, 5).alias("zip"), F.substring(F.trim("naics"), 1, naics_digits).alias("naics_cell")).agg(F.sum("establishments").alias("establishment_count"))
    ratio = F.col("ppp_loan_count") / F.greatest("establishment_count", F.lit(1))
    hot = cells.join(known, ["zip", "naics_cell"]).where(ratio >= min_ratio).withColumn("ratio", ratio)
    return base.join(hot, ["zip", "naics_cell"]).select("loan_number", rounded(F.log("ratio"), 4).alias("score"), "zip", "naics_cell", F.lit(naics_digits).alias("naics_digits"), "ppp_loan_count", "establishment_count", rounded("ratio", 4).alias("ratio"), F.lit(min_ratio).alias("min_ratio"))


def lender_concentration(loans: DataFrame, min_loans: int = 100, min_z: float = 3.0, min_mad: float = 0.01) -> DataFrame:
    """Lenders whose share of loans at or above the cap stands out among lenders with enough loans."""
    base = usable(one_per_loan(loans, "originating_lender", "naics_code", "current_approval_amount", "jobs_reported")).where(F.coalesce("originating_lender", F.lit("")) != "").select("loan_number", "originating_lender", (F.col("current_approval_amount") / F.col("jobs_reported") >= cap_of()).cast("int").alias("_bust"))
    books = base.groupBy("originating_lender").agg(F.count(F.lit(1)).alias("lender_loan_count"), F.sum("_bust").alias("lender_suspicious_count")).where(F.col("lender_loan_count") >= min_loans).withColumn("_rate", F.col("lender_suspicious_count") / F.col("lender_loan_count"))
    books = stored(books, "lenders")
    z = with_robust_z(books, [], "_rate", min_mad, "_z").where(F.col("_z") >= min_z)
    return base.join(z, "originating_lender").select("loan_number", rounded("_z", 4).alias("score"), "originating_lender", "lender_loan_count", "lender_suspicious_count", rounded("_rate", 4).alias("lender_suspicious_rate"), rounded("_z", 4).alias("lender_robust_z"), F.lit(min_loans).alias("min_loans"), F.lit(min_z).alias("min_z"))


def business_recency(loans: DataFrame) -> DataFrame:
    """Borrowers that say they are new, about to open or newly bought; anything else never fires."""
    table = F.create_map(*[F.lit(x) for kv in RECENCY.items() for x in kv])
    tell = F.lower(F.trim("business_age_description"))
    return one_per_loan(loans, "business_age_description", "date_approved").withColumn("score", table[tell]).where(F.col("score").isNotNull()).select("loan_number", "score", "business_age_description", "date_approved", tell.alias("matched_tell"))


def name_mismatch(loans: DataFrame, titles: DataFrame | None = None, min_mismatch: float = 0.6, embedder: Callable[[list[str]], np.ndarray] = embed, block: int = TITLE_BLOCK) -> DataFrame:
    """Names that fit another industry's title better than their own.

    Each distinct name is compared with every title once, in Arrow batches; titles go to the executors in blocks. Of
    equally similar titles the first by letter counts. Codes without a title of their own take that of their sector.
    """
    base = one_per_loan(loans, "borrower_name", "naics_code").where((F.coalesce(F.trim("borrower_name"), F.lit("")) != "") & (F.coalesce("naics_code", F.lit("")) != ""))
    spark = base.sparkSession
    own = None if titles is None else titles.where(F.col("naics_code").isNotNull() & F.col("title").isNotNull()).groupBy(F.trim("naics_code").alias("_code")).agg(F.max(F.trim("title")).alias("_title"))
    own = spark.createDataFrame(list(SECTORS.items()), "_code string, _title string") if own is None or own.isEmpty() else own
    own = stored(own, "titles")
    sector = own.select(F.col("_code").alias("_sector"), F.col("_title").alias("_broad"))
    base = base.join(own, F.col("naics_code") == F.col("_code"), "left").join(sector, F.substring("naics_code", 1, 2) == F.col("_sector"), "left")
    base = stored(base.select("loan_number", "borrower_name", F.coalesce("_title", "_broad").alias("_title")).where(F.col("_title").isNotNull()), "titled")
    pairs = base.select("borrower_name", "_title").distinct()
    unique = with_ranks(own.select("_title").distinct(), [F.col("_title")], "_i")
    n = own.select("_title").distinct().count()

    def compare(sent: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = sent.value
            at = {t: i for i, t in enumerate(names)}
            for b in batches:
                sims = np.round(embedder(b["borrower_name"].tolist()).astype(np.float64) @ matrix.T, 12) + 0.0
                mine = np.array([at.get(t, -1) for t in b["_title"]], np.int64)
                own_sim = np.where(mine >= 0, sims[np.arange(len(b)), mine], np.nan) if len(b) else np.array([])
                best = sims.argmax(1) if len(b) else []
                yield b.assign(own=pd.Series(own_sim, b.index).astype(object).where(mine >= 0, None), best=sims.max(1, initial=-1), least=sims.min(1, initial=1), title=[names[i] for i in best])

        return run

    found = None
    for first in range(0, n, block):
        names = [r[0] for r in unique.where((F.col("_i") > first) & (F.col("_i") <= first + block)).orderBy("_i").select("_title").collect()]
        part = pairs.mapInPandas(compare(spark.sparkContext.broadcast((names, embedder(names).astype(np.float64)))), "borrower_name string, _title string, own double, best double, least double, title string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "borrower_name string, _title string, own double, best double, least double, title string")
    per = found.groupBy("borrower_name", "_title").agg(F.max("own").alias("own"), F.max("best").alias("best"), F.min("least").alias("least"), F.min(F.struct((-F.col("best")).alias("b"), "title"))["title"].alias("title"))
    gap = rounded(F.when(F.col("best") - F.col("least") > 1e-9, (F.col("best") - F.col("own")) / (F.col("best") - F.col("least"))).otherwise(0.0), 4)
    hit = per.withColumn("gap", gap).where(F.col("gap") >= min_mismatch)
    return base.join(hit, ["borrower_name", "_title"]).select(
        "loan_number", F.col("gap").alias("score"), F.col("_title").alias("declared_title"), rounded("own", 4).alias("declared_similarity"), F.col("title").alias("best_match_title"), rounded("best", 4).alias("best_similarity"),
        F.col("gap").alias("mismatch_gap"), F.lit(n).alias("n_titles"),
    )


def as_signals(df: DataFrame, detector_id: str) -> DataFrame:
    """The common contract; evidence keys in alphabetical order, nulls kept."""
    evidence = sorted(c for c in df.columns if c not in ("loan_number", "score"))
    return df.select("loan_number", F.lit(detector_id).alias("detector_id"), "score", F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"}).alias("evidence_json"))


def ring_graph(loans: DataFrame) -> DataFrame:
    from .graph import ring_signals

    return ring_signals(loans)


#: Name of each detector, its function, the tables it needs besides loans, and whether it is in the composite by default.
REGISTRY: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], bool]] = {
    "naics_cohort_outlier": (cohort_outlier, (), True), "payroll_cap_exceedance": (cap_exceedance, (), True), "multiple_funded_loans": (multiple_funded, (), True),
    "duplicate_address_ring": (address_ring, (), False), "amount_anomaly": (amount_anomaly, (), False), "establishment_overcount": (establishment_overcount, ("establishments",), False), "lender_concentration": (lender_concentration, (), False),
    "naics_name_mismatch": (name_mismatch, ("naics_titles",), False), "fraud_ring_graph": (ring_graph, (), False), "business_recency": (business_recency, (), False),
}


def get_detector(detector_id: str) -> Callable[..., DataFrame]:
    """KeyError if there is none of that name."""
    return REGISTRY[detector_id][0]


def run_detectors(read: Callable[[str], DataFrame], names: list[str] | None = None) -> DataFrame:
    """signals of the named detectors (the default ones otherwise). read gives a table by name; labels are never read."""
    out = None
    for n in names if names is not None else [k for k, v in REGISTRY.items() if v[2]]:
        f, tables, _ = REGISTRY[n]
        one = as_signals(f(read("loans"), *[read(t) for t in tables]), n)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no detector named")
    return out
