import json

import pytest

from ledgerlens.operators import enrich, investigate, ranking, triage
from ledgerlens.plans import benchmark


@pytest.fixture(scope="module")
def tables(spark):
    from ledgerlens.sources import demo
    from ledgerlens.sources.schema import LOANS, TABLES

    loans, cases = demo.demo_loans()
    l = spark.createDataFrame([tuple(r.get(f.name) for f in LOANS) for r in loans], LOANS)
    c = spark.createDataFrame([tuple(r.get(f.name) for f in TABLES["fraud_cases"]) for r in cases], TABLES["fraud_cases"])
    from ledgerlens.operators import detectors

    return l, c, detectors.as_signals(detectors.cap_exceedance(l), "payroll_cap_exceedance").cache()


def test_candidates_are_clamped(tables):
    loans, _, signals = tables
    assert triage.candidates(signals, loans, -3).isEmpty() and triage.candidates(signals, loans, 7).count() == 7
    assert "payroll_proceed" in triage.candidates(signals, loans, 10_000).columns


def test_judged_head_is_ranked_again(tables):
    loans, cases, signals = tables

    def by_jobs(b):
        return b.assign(importance=b["jobs_reported"].map(lambda j: 9 if j <= 5 else "none"), reason="few jobs")

    got, counts = triage.triage(signals, loans, by_jobs, 20)
    rows = got.orderBy("triage_rank").collect()
    assert counts["n_candidates"] == 20 and counts["n_failed"] == sum(r["jobs_reported"] > 5 for r in rows)
    assert all(r["importance"] == (3.0 if r["jobs_reported"] <= 5 else 0.0) for r in rows)
    key = [(-r["triage_score"], r["rank"]) for r in rows]
    assert key == sorted(key) and [r["triage_rank"] for r in rows] == list(range(1, 21))
    full = ranking.ranked(ranking.composite(signals, loans))
    after = triage.ranks_after(full, got)
    assert after.count() == full.count() and {r["loan_number"] for r in after.where("rank <= 20").collect()} == {r["loan_number"] for r in rows}
    g = triage.gate(full, after, ranking.positives(cases), 268, (5, 20)).collect()
    assert {r["k"] for r in g} == {5, 20} and len({r["verdict"] for r in g}) == 1
    same = triage.gate(full, full, ranking.positives(cases), 268, (5,)).collect()
    assert same[0]["verdict"] == "neutral" and same[0]["hits_before"] == same[0]["hits_after"]


def test_a_failing_judge_leaves_loans_neutral(tables):
    loans, _, signals = tables

    def broken(b):
        raise OSError("no answer")

    got = triage.judged(triage.candidates(signals, loans, 5), broken, retries=1).collect()
    assert len(got) == 5 and all(r["failed"] and r["importance"] == 0.0 and r["reason"] is None for r in got)


def test_lift_curve_and_full_benchmark(tables):
    loans, cases, signals = tables
    r = ranking.ranked(ranking.composite(signals, loans))
    curve = triage.lift_curve(r, ranking.positives(cases), 268, 10, (5, 100)).orderBy("k").collect()
    ks = [x["k"] for x in curve]
    assert {1, 5, 100, 268} <= set(ks) and [x["hits"] for x in curve] == sorted(x["hits"] for x in curve)
    b = benchmark.full_benchmark(signals, loans, cases, (10, 50), n_boot=50)
    assert set(b) == {"ks", "slice", "full_population", "population", "n_labeled_fraud", "base_rate", "n_ranked", "n_boot", "overall", "overall_ci", "positive_ranks", "baselines", "ablation"}
    assert b["population"] == 268 and b["n_labeled_fraud"] == 15 and len(b["overall"]) == 2 and len(b["overall_ci"]) == 2
    whole = benchmark.full_benchmark(signals, loans, cases, (10,), None, 0)
    assert whole["full_population"] and whole["overall_ci"] == [] and whole["population"] == 268


def test_investigation(spark, tables):
    loans, cases, signals = tables
    known = cases.select("loan_number").first()[0]
    t = spark.createDataFrame([(known,), ("nothing",)], "loan_number string")
    got = {r["loan_number"]: r for r in investigate.investigate(loans, signals, cases, t).collect()}
    assert got[known]["found"] and json.loads(got[known]["cases"])[0]["case_id"] and json.loads(got[known]["profile"])["borrower_state"]
    assert not got["nothing"]["found"] and got["nothing"]["profile"] is None and json.loads(got["nothing"]["peers"])["reason"] == "loan_not_found"
    p = investigate.pattern_comparison(loans, cases, t).collect()
    assert len(p) == 1 and p[0]["base_rate"] == pytest.approx(15 / 268, abs=1e-6) and p[0]["off_median"] > 0
    assert investigate.sampled(loans, 9).count() == 9 and investigate.sampled(loans, 9).collect() == investigate.sampled(loans.repartition(5), 9).collect()


def test_texts_of_an_investigation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a" * 300 + " ACME " + "b" * 300, "ACME"), ("short", "ACME"), (None, "ACME")], "t string, n string")
    s = [r[0] for r in df.select(investigate.snippet(F.col("t"), F.col("n"))).collect()]
    assert "ACME" in s[0] and len(s[0]) == 364 and s[1] == "short" and s[2] is None
    w = df.select(investigate.distinctive_tokens(F.lit("The Blue Harbor Services, blue LLC"), ("SERVICES",))).first()[0]
    assert w == ["BLUE", "HARBOR"]
    c = spark.createDataFrame([("name+amount",), ("amount+LLM",), (None,)], "match_method string")
    assert [r[0] for r in investigate.exact_tier(c).collect()] == ["name+amount"]


def test_enrichment_is_bounded_and_kept(tables, tmp_path):
    loans, _, signals = tables
    r = ranking.ranked(ranking.composite(signals, loans))
    asked = []

    def provider(name, state):
        asked.append(name)
        if len(asked) == 4:
            raise enrich.QuotaReached
        if len(asked) == 2:
            raise OSError("down")
        return {"name": name, "status": "active"} if len(asked) == 1 else None

    got, counts = enrich.enriched(r, enrich.kept(provider, str(tmp_path)), lambda f: -1.0 if f else 0.0, 10)
    rows = got.collect()
    assert counts == {"asked": 3, "found": 1, "failed": 1, "left": 7} and len(asked) == 4 and len(rows) == 10
    assert sum(x["facts"] is not None for x in rows) == 1 and [x["refined_score"] for x in rows] == sorted((x["refined_score"] for x in rows), reverse=True)
    n = len(asked)
    _, again = enrich.enriched(r, enrich.kept(provider, str(tmp_path)), top=1)
    assert len(asked) == n and again["found"] == 1
    for f in tmp_path.iterdir():
        f.write_text("{")
    enrich.enriched(r, enrich.kept(provider, str(tmp_path)), top=1)
    assert len(asked) == n + 1
    assert "status: active" in enrich.dossier(next(x.asDict() for x in rows if x["facts"]))
    table = enrich.from_table([{"name": "Acme, LLC", "state": "TX", "x": 1}, {"name": "Other"}])
    assert table("acme llc", "TX")["x"] == 1 and table("ACME LLC", "NY") is None and table("other", "NY") == {"name": "Other"}


def test_summary_of_look_alikes(spark, tables):
    from ledgerlens.operators import similar

    loans, cases, _ = tables
    t = spark.createDataFrame([("DEMO00003",), ("nothing",)], "loan_number string")
    near = similar.similar_loans(loans, t, cases, 5, min_amount=0.0)
    got = investigate.neighbour_summary(near).collect()
    assert len(got) == 1 and got[0]["loan_number"] == "DEMO00003" and got[0]["summary"].startswith("5 look-alikes; closest: ")
    assert investigate.neighbour_summary(near.limit(0)).isEmpty()


def test_learned_scorers_keep_to_their_parts(tables, tmp_path):
    from ledgerlens.operators import learn

    loans, cases, signals = tables
    rows, counts = learn.nested_validation(loans, signals, cases, 2022, (10, 50), 0.0, n_boot=20, folds=2, options=({"maxDepth": 2, "maxIter": 2}, {"maxDepth": 1, "maxIter": 2}))
    got = rows.collect()
    assert {r["ranking"] for r in got} == {"boosted", "composite", "fused"} and len(got) == 6
    assert counts["verdict"] in ("improved", "neutral", "regressed") and all(r["verdict"] == counts["verdict"] for r in got)
    assert counts["n_train"] + counts["n_test"] == 15 and counts["population"] == 268 - counts["n_train"]
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    data = loans.select("loan_number", "current_approval_amount", "jobs_reported")
    model = Pipeline(stages=[VectorAssembler(inputCols=["current_approval_amount", "jobs_reported"], outputCol="features")]).fit(data)
    learn.save_model(model, str(tmp_path / "m"))
    learn.save_model(model, str(tmp_path / "m"))
    assert learn.load_model(str(tmp_path / "m")).transform(data).count() == 268
