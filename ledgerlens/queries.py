"""The core queries: each callable takes a session and a folder of tables. Whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.ordered import with_ranks
from .functions.stats import rounded
from .functions.store import stored
from .operators import detectors, features, graph, investigate, labels, learn, profile, ranking, similar, triage
from .plans.benchmark import benchmark, validate_ranking
from .sources.readers import Warehouse, one_per_loan
from .streaming.landing import rolling_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _wh(s: SparkSession, d: str) -> Warehouse:
    return Warehouse(s, d)


def _loans(s: SparkSession, d: str) -> DataFrame:
    return _wh(s, d).read("loans")


def _detector(name: str) -> None:
    f, tables, _ = detectors.REGISTRY[name]

    def run(s: SparkSession, d: str) -> DataFrame:
        wh = _wh(s, d)
        got = f(wh.read("loans"), *[wh.read(t) for t in tables])
        return got.withColumns({c: F.array_join(c, ";") for c, kind in got.dtypes if kind == "array<string>"})

    QUERIES[f"detect_{name}"] = run


for _name in detectors.REGISTRY:
    _detector(_name)


@query
def detect_naics_cohort_outlier_relaxed(s, d):
    return detectors.cohort_outlier(_loans(s, d), 10, 0.25, 1.5)


@query
def detect_establishment_overcount_relaxed(s, d):
    wh = _wh(s, d)
    return detectors.establishment_overcount(wh.read("loans"), wh.read("establishments"), 0.3)


@query
def detect_lender_concentration_relaxed(s, d):
    return detectors.lender_concentration(_loans(s, d), 20, 1.0)


@query
def signals_by_detector(s, d):
    wh = _wh(s, d)
    return detectors.run_detectors(wh.read).groupBy("detector_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.max("score"), 4).alias("top"))


def score_top(s: SparkSession, d: str, k: int = 25) -> DataFrame:
    """Loans to signals to ranking, the flagship pipeline."""
    wh = _wh(s, d)
    signals = stored(detectors.run_detectors(wh.read), "signals")
    return ranking.ranked(ranking.composite(signals, wh.read("loans")), head=k).withColumn("detectors", F.array_join("detectors", ",")).withColumn("composite_score", rounded("composite_score", 6))


QUERIES["score_top25"] = score_top


@query
def rank_composite(s, d):
    wh = _wh(s, d)
    r = ranking.composite(wh.read("signals"), wh.read("loans"))
    return r.withColumn("composite_score", rounded("composite_score", 6)).withColumn("detectors", F.array_join("detectors", ","))


@query
def rank_baseline_top100(s, d):
    return ranking.ranked(ranking.baseline(_loans(s, d), "amount_per_job"), "score", head=100).withColumn("score", rounded("score", 4))


@query
def rank_metrics(s, d):
    wh = _wh(s, d)
    n = wh.loans("current_approval_amount").count()
    r = ranking.ranked(ranking.composite(wh.read("signals"), wh.read("loans")).select("loan_number", rounded("composite_score", 9).alias("composite_score")))
    return ranking.metrics_at(r, ranking.positives(wh.read("fraud_cases")), n)


@query
def rank_positive_stats(s, d):
    wh = _wh(s, d)
    n = wh.loans("current_approval_amount").count()
    r = ranking.ranked(ranking.composite(wh.read("signals"), wh.read("loans")).select("loan_number", rounded("composite_score", 9).alias("composite_score")))
    return ranking.positive_rank_stats(r, ranking.positives(wh.read("fraud_cases")), n)


@query
def rank_fusion_top200(s, d):
    l = _loans(s, d)
    a, b = (ranking.ranked(ranking.baseline(l, k), "score") for k in ("amount_per_job", "raw_amount"))
    return ranking.fuse([a, b], [1.0, 0.5], head=200).withColumn("fused_score", rounded("fused_score", 9))


@query
def rank_bootstrap(s, d):
    wh = _wh(s, d)
    r = stored(ranking.ranked(ranking.composite(wh.read("signals"), wh.read("loans"))).select("loan_number", "rank"), "ranking")
    return ranking.bootstrap_intervals(r, ranking.positives(wh.read("fraud_cases")), wh.loans("current_approval_amount").count())


@query
def detector_overlap(s, d):
    return ranking.overlap(_wh(s, d).read("signals"), "amount_anomaly", "naics_name_mismatch")


@query
def label_positives(s, d):
    return ranking.positives(_wh(s, d).read("fraud_cases"))


@query
def label_temporal_split(s, d):
    return ranking.temporal_split(_wh(s, d).read("fraud_cases"), 2022)


@query
def benchmark_slice(s, d):
    wh = _wh(s, d)
    return benchmark(wh.read("signals"), wh.read("loans"), wh.read("fraud_cases"))


@query
def text_keys(s, d):
    return one_per_loan(_loans(s, d), "borrower_name", "borrower_address", "borrower_city", "borrower_state", "borrower_zip").select("loan_number", text.norm_name("borrower_name").alias("norm_name"), text.building_key().alias("building_key"), text.entity_key().alias("entity_key"))


@query
def text_releases(s, d):
    r = _wh(s, d).read("press_releases").select("id", "title", "body").distinct()
    blob = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))))
    return r.select("id", text.program(blob).alias("program"), text.about_loans(blob).alias("about_loans"), rounded(text.largest_amount("body"), 2).alias("largest"), F.array_join(F.transform(text.dollar_figures("body"), lambda x: x.cast("string")), ",").alias("figures"), text.short_hash(F.col("id")).alias("hash"))


@query
def labels_exact(s, d):
    wh = _wh(s, d)
    return labels.resolve_exact(wh.read("press_releases"), wh.read("loans"))


@query
def labels_amount_candidates(s, d):
    wh = _wh(s, d)
    return labels.amount_candidates(wh.read("press_releases"), wh.read("loans"), wh.read("fraud_cases")).select("url", "loan_number", "borrower_name", "state", "amount", "matched_dollar")


@query
def graph_address_edges(s, d):
    return graph.loan_edges(_loans(s, d), 0.0, ("address",)).select("src", "dst")


@query
def graph_entity_edges(s, d):
    return graph.loan_edges(_loans(s, d), 0.0, ("entity",)).select("src", "dst")


@query
def graph_components(s, d):
    return graph.components(graph.loan_edges(_loans(s, d), 0.0, ("address", "entity")))


@query
def graph_structure(s, d):
    return graph.graph_features(_loans(s, d))


@query
def similar_pool(s, d):
    wh = _wh(s, d)
    return similar.candidate_pool(wh.read("loans"), ranking.positives(wh.read("fraud_cases"))).select("target", "loan_number")


@query
def similar_top(s, d):
    wh = _wh(s, d)
    y = ranking.positives(wh.read("fraud_cases"))
    return similar.similar_loans(wh.read("loans"), y, y)


@query
def similar_homophily(s, d):
    wh = _wh(s, d)
    return similar.homophily(wh.read("loans"), wh.read("fraud_cases"))


@query
def vector_top_k(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet")
    return similar.vector_top_k(v, v.where("vec_id % 100 = 0"), 10)


@query
def features_thin(s, d):
    wh = _wh(s, d)
    f = features.thin_features(wh.read("loans"), wh.read("signals"))
    return f.select("loan_number", *[F.round(c, 6).alias(c) for c in f.columns if c != "loan_number"])


@query
def features_evidence(s, d):
    f = features.evidence_numbers(_wh(s, d).read("signals"))
    return f.select("loan_number", *[F.round(c, 6).alias(c) for c in f.columns if c != "loan_number"])


@query
def features_pay_ratio(s, d):
    return features.pay_ratio(_loans(s, d)).withColumn("pay_ratio_pctile", F.round("pay_ratio_pctile", 9))


@query
def features_categories(s, d):
    return features.categories(_loans(s, d))


@query
def features_rich(s, d):
    wh = _wh(s, d)
    return features.rich_features(wh.read("loans"), wh.read("signals"), graph.graph_features(wh.read("loans")))


@query
def features_rich_plain(s, d):
    """The same without the graph, which SQL can't express."""
    wh = _wh(s, d)
    f = features.rich_features(wh.read("loans"), wh.read("signals"))
    return f.select("loan_number", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes if c != "loan_number" and not c.startswith("g_")])


@query
def learn_holdout(s, d):
    wh = _wh(s, d)
    return learn.holdout_comparison(wh.read("loans"), wh.read("signals"), wh.read("fraud_cases"), 2022)


@query
def profile_summary(s, d):
    return profile.slice_summary(_loans(s, d))


@query
def profile_amounts(s, d):
    return profile.amount_buckets(_loans(s, d))


@query
def profile_jobs(s, d):
    return profile.jobs_buckets(_loans(s, d))


@query
def profile_top_lenders(s, d):
    return profile.top_values(_loans(s, d), "lender")


@query
def profile_top_states_by_amount(s, d):
    return profile.top_values(_loans(s, d), "state", True)


@query
def profile_coverage(s, d):
    wh = _wh(s, d)
    return profile.detector_coverage(wh.read("signals"), wh.read("loans"))


@query
def profile_population(s, d):
    wh = _wh(s, d)
    return profile.population(wh.read("loans"), wh.read("fraud_cases"))


@query
def profile_pay_medians(s, d):
    wh = _wh(s, d)
    return profile.pay_medians(wh.read("loans"), wh.read("fraud_cases"))


@query
def profile_percentile(s, d):
    return profile.percentile_of(_loans(s, d), 20_000.0)


@query
def profile_histogram(s, d):
    return profile.pay_histogram(_loans(s, d))


@query
def profile_sectors(s, d):
    wh = _wh(s, d)
    return profile.sectors(wh.read("loans"), wh.read("fraud_cases"))


@query
def profile_cells(s, d):
    wh = _wh(s, d)
    return profile.cells(wh.read("loans"), wh.read("fraud_cases"))


@query
def profile_density(s, d):
    return profile.density_grid(_loans(s, d))


@query
def profile_peers(s, d):
    wh = _wh(s, d)
    return profile.peers(wh.read("loans"), ranking.positives(wh.read("fraud_cases")))


@query
def profile_raw_composite(s, d):
    return profile.raw_composite(_wh(s, d).read("signals"))


@query
def profile_case_files(s, d):
    wh = _wh(s, d)
    return profile.case_files(wh.read("fraud_cases"), wh.read("loans"), wh.read("press_releases"))


@query
def stream_rolling_counts(s, d):
    r = rolling_counts(s.read.parquet(f"{d}/events.parquet"))
    return r.withColumn("total", F.round("total", 4))


@query
def warehouse_loans(s, d):
    return _wh(s, d).loans()


def _placed(s: SparkSession, d: str) -> DataFrame:
    """(loan_number, rank) of the composite ranking, equal scores to nine places by loan number."""
    wh = _wh(s, d)
    scores = ranking.composite(wh.read("signals"), wh.read("loans")).select("loan_number", rounded("composite_score", 9).alias("composite_score"))
    return stored(ranking.ranked(scores).select("loan_number", "rank"), "ranking")


@query
def benchmark_population(s, d):
    wh = _wh(s, d)
    return benchmark(wh.read("signals"), wh.read("loans"), wh.read("fraud_cases"), min_amount=None)


@query
def benchmark_detector(s, d):
    """A detector alone against the composite, on charges after a year."""
    wh = _wh(s, d)
    r = ranking.ranked(ranking.clean_signals(wh.read("signals")).where("detector_id = 'payroll_cap_exceedance'").groupBy("loan_number").agg(F.max("score").alias("score")), "score")
    return validate_ranking(r, wh.read("signals"), wh.read("loans"), wh.read("fraud_cases"))


@query
def lift_curve(s, d):
    wh = _wh(s, d)
    return triage.lift_curve(_placed(s, d), ranking.positives(wh.read("fraud_cases")), wh.loans("current_approval_amount").count())


@query
def flag_rates(s, d):
    wh = _wh(s, d)
    return triage.flag_rate(wh.read("signals"), wh.read("loans"))


@query
def triage_gate(s, d):
    """The head of the ranking by the number of signals instead of by score, held against the ranking."""
    wh = _wh(s, d)
    full = _placed(s, d)
    several = ranking.clean_signals(wh.read("signals")).groupBy("loan_number").agg(F.count(F.lit(1)).alias("n"))
    head = full.where("rank <= 250").join(several, "loan_number")
    head = with_ranks(head, [F.col("n").desc(), F.col("rank")], "triage_rank")
    return triage.gate(full, triage.ranks_after(full, head), ranking.positives(wh.read("fraud_cases")), wh.loans("current_approval_amount").count())


@query
def loan_profiles(s, d):
    wh = _wh(s, d)
    return investigate.loan_profile(wh.read("loans"), ranking.positives(wh.read("fraud_cases")))


@query
def loan_patterns(s, d):
    wh = _wh(s, d)
    return investigate.pattern_comparison(wh.read("loans"), wh.read("fraud_cases"), ranking.positives(wh.read("fraud_cases")))


@query
def loan_investigations(s, d):
    wh = _wh(s, d)
    return investigate.investigate(wh.read("loans"), wh.read("signals"), wh.read("fraud_cases"), ranking.positives(wh.read("fraud_cases")))


@query
def label_exact_tier(s, d):
    return investigate.exact_tier(_wh(s, d).read("fraud_cases")).select("case_id", "loan_number", "match_method", "match_confidence").distinct()


@query
def label_snippets(s, d):
    """Surroundings of each firm's name in the release of its case, and what is distinctive of the name."""
    wh = _wh(s, d)
    c = wh.read("fraud_cases").select("case_id", "business_name", F.col("source_url").alias("url")).where("business_name is not null").distinct()
    r = wh.read("press_releases").where("url is not null and body is not null").groupBy("url").agg(F.min("body").alias("body"))
    return c.join(r, "url").select("case_id", investigate.snippet(F.col("body"), F.col("business_name")).alias("snippet"), F.array_join(investigate.distinctive_tokens(F.col("business_name"), text.NAME_STOP_WORDS), " ").alias("tokens"))


@query
def sample_loans(s, d):
    """A sampling operator: 500 loans of the slice, drawn after the filter."""
    l = _wh(s, d).loans("current_approval_amount").where("current_approval_amount >= 150000")
    return investigate.sampled(l, 500)
