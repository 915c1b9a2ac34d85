import math

from pyspark.sql import functions as F

from ledgerlens.operators import detectors as D


def rows(df):
    return {r["loan_number"]: r for r in df.collect()}


def peers(n=40):
    return [{"loan_number": f"N{i}", "borrower_name": f"Firm {i} LLC", "naics_code": "722511", "borrower_state": "TX", "current_approval_amount": (9000.0 + 75 * i) * 10, "jobs_reported": 10.0} for i in range(n)]


OUTLIER = {"loan_number": "OUT", "borrower_name": "Odd Firm", "naics_code": "722511", "borrower_state": "TX", "current_approval_amount": 1_000_000.0, "jobs_reported": 5.0}


def test_outlier_among_peers(loans):
    got = rows(D.cohort_outlier(loans([*peers(), OUTLIER, OUTLIER])))
    assert set(got) == {"OUT"}
    assert got["OUT"]["cohort"] == "722511 | TX" and got["OUT"]["cohort_size"] == 41 and got["OUT"]["x_cohort_median"] > 5


def test_small_cohorts_and_missing_values_are_left_out(loans):
    bad = [{"loan_number": "A", "naics_code": None, "borrower_state": "TX", "current_approval_amount": 1e9, "jobs_reported": 1.0}, {"loan_number": "B", "naics_code": "1", "borrower_state": "TX", "current_approval_amount": None, "jobs_reported": None}]
    assert rows(D.cohort_outlier(loans([*peers(10), OUTLIER, *bad]))) == {}
    assert rows(D.cohort_outlier(loans([]))) == {}


def test_cap_uses_the_industry(loans):
    got = rows(D.cap_exceedance(loans([OUTLIER, {**OUTLIER, "loan_number": "G", "naics_code": None}, {**OUTLIER, "loan_number": "Z", "jobs_reported": 0.0}])))
    assert set(got) == {"OUT", "G"}
    assert got["OUT"]["per_employee_cap"] == 29166.67 and got["G"]["per_employee_cap"] == 20833.33


ADDRESS = {"borrower_city": "Austin", "borrower_state": "TX", "borrower_zip": "78701-1234"}


def test_multiple_funded(loans):
    base = [{"loan_number": "1", "borrower_name": "Acme LLC", "borrower_address": "1 Main St", "processing_method": "PPP", **ADDRESS}, {"loan_number": "2", "borrower_name": "ACME", "borrower_address": "1 Main Street", "processing_method": "PPP", **ADDRESS}]
    got = rows(D.multiple_funded(loans(base)))
    assert {k: v["score"] for k, v in got.items()} == {"1": 1.0, "2": 1.0}
    base[1]["processing_method"] = "PPS"
    assert rows(D.multiple_funded(loans(base))) == {}
    assert rows(D.multiple_funded(loans([{**base[0], "borrower_name": ""}, {**base[0], "loan_number": "9", "borrower_address": None}]))) == {}


def test_address_ring(loans):
    ring = [{"loan_number": str(i), "borrower_name": n, "borrower_address": a, "current_approval_amount": m, **ADDRESS} for i, (n, a, m) in enumerate([("A", "123 Main Street", 100_000.0), ("B", "123 MAIN ST", 120_000.0), ("C", "123 Main St., Suite 200", 90_000.0)])]
    got = rows(D.address_ring(loans(ring)))
    assert len(got) == 3 and got["0"]["ring_size"] == 3 and got["0"]["total_ring_amount"] == 310_000.0
    assert got["0"]["score"] == round(math.log1p(3) + math.log1p(310_000), 4)
    assert rows(D.address_ring(loans(ring[:2]))) == {}
    assert rows(D.address_ring(loans([{**r, "borrower_name": "same"} for r in ring]))) == {}


def test_amount_shapes(loans):
    mk = lambda n, a, j: {"loan_number": n, "naics_code": "722511", "current_approval_amount": a, "jobs_reported": j}
    got = rows(D.amount_anomaly(loans([mk("a", 350_000.0, 12.0), mk("b", 87_234.57, 10.0), mk("c", 1_000_003.0, 5.0)])))
    assert set(got) == {"a"} and got["a"]["signals_fired"] == "cap_maximization,round_amount"


def test_overcount(spark, loans):
    ls = loans([{"loan_number": str(i), "borrower_zip": "78701-99" if i else "78701", "naics_code": "722511"} for i in range(6)])
    est = spark.createDataFrame([("78701", "722511", 1), ("1", "2", None)], "zip string, naics string, establishments int")
    got = rows(D.establishment_overcount(ls, est))
    assert len(got) == 6 and got["0"]["score"] == round(math.log(6), 4)
    assert D.establishment_overcount(ls, est.limit(0)).isEmpty()


def test_lenders(loans):
    out = []
    for lender, busts in [("BAD", 9), ("A", 0), ("B", 1), ("C", 2), ("D", 0), ("E", 1), ("F", 2)]:
        out += [{"loan_number": f"{lender}{i}", "originating_lender": lender, "current_approval_amount": 300_000.0 if i < busts else 50_000.0, "jobs_reported": 10.0} for i in range(10)]
    got = rows(D.lender_concentration(loans(out), min_loans=10))
    assert set(got) == {f"BAD{i}" for i in range(10)} and got["BAD0"]["lender_suspicious_rate"] == 0.9


def test_recency(loans):
    says = ["Startup, Loan Funds will Open Business", " new business or 2 years or less", "Change of Ownership", "Existing or more than 2 years old", "Unanswered", None, " "]
    got = rows(D.business_recency(loans([{"loan_number": str(i), "business_age_description": s} for i, s in enumerate(says)])))
    assert {k: v["score"] for k, v in got.items()} == {"0": 3.0, "1": 2.0, "2": 1.0}


def test_name_mismatch(spark, loans):
    import numpy as np

    titles = spark.createDataFrame([("23", " Construction "), ("72", "Food"), ("11", "Farms")], "naics_code string, title string")
    at = {"Construction": 0, "Food": 1, "Farms": 2, "Build Co": 0, "Cook Co": 1}
    one_hot = lambda texts: np.eye(3, dtype=np.float32)[[at[t] for t in texts]]
    ls = loans([{"loan_number": "bad", "borrower_name": "Build Co", "naics_code": "722511"}, {"loan_number": "ok", "borrower_name": "Cook Co", "naics_code": "722511"}, {"loan_number": "none", "borrower_name": "Cook Co", "naics_code": "99"}])
    got = rows(D.name_mismatch(ls, titles, 0.85, one_hot))
    assert set(got) == {"bad"} and got["bad"]["best_match_title"] == "Construction"


def test_signals_contract(loans):
    s = D.as_signals(D.cap_exceedance(loans([OUTLIER])), "x")
    assert s.columns == ["loan_number", "detector_id", "score", "evidence_json"]
    assert s.select(F.get_json_object("evidence_json", "$.x_cap")).first()[0] is not None
    assert set(D.REGISTRY) == {"naics_cohort_outlier", "payroll_cap_exceedance", "multiple_funded_loans", "duplicate_address_ring", "amount_anomaly", "establishment_overcount", "lender_concentration", "naics_name_mismatch", "fraud_ring_graph", "business_recency"}


def test_titles_in_blocks_of_one(spark, loans):
    titles = spark.createDataFrame([("23", " Construction "), ("72", "Food"), ("11", "Farms"), ("72", "Eating")], "naics_code string, title string")
    ls = loans([{"loan_number": str(i), "borrower_name": n, "naics_code": c} for i, (n, c) in enumerate([("Build Constructions", "722511"), ("Food and Foods", "722511"), ("Farmsteads", "236"), ("x", "1"), (None, "72"), ("Food", None)])])
    a, b = (sorted(map(tuple, D.name_mismatch(ls, titles, 0.0, block=n).collect())) for n in (1, 4096))
    assert a == b and len(a) == 3


def test_evidence_lists_are_bounded(loans):
    rows = [{"loan_number": f"{i:03d}", "borrower_name": f"Name {i}", "borrower_address": "1 Main St", "borrower_city": "X", "borrower_state": "TX", "borrower_zip": "1", "current_approval_amount": 1.0, "processing_method": "PPP"} for i in range(40)]
    got = D.address_ring(loans(rows)).first()
    assert got["borrower_names_sample"] == sorted(f"Name {i}" for i in range(40))[:10] and got["ring_size"] == 40
    same = [r | {"borrower_name": "One"} for r in rows]
    assert D.multiple_funded(loans(same)).first()["loan_numbers"] == [f"{i:03d}" for i in range(25)]
