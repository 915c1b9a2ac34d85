import inspect
import random

from pyspark.sql import functions as F

from ledgerlens.operators import features, learn


def table(loans, n=120):
    random.seed(3)
    return loans([{"loan_number": f"L{i:03d}", "borrower_name": f"F{i}", "borrower_state": "TX" if i % 2 else None, "naics_code": "722511" if i % 3 else "23", "current_approval_amount": 150_000.0 + 1000 * i if i < 100 else 5e6, "jobs_reported": 10.0 if i < 100 else 1.0, "payroll_proceed": 1e9, "term": 24, "originating_lender": "Big" if i % 4 else f"l{i}", "franchise_name": " "} for i in range(n)])


SIGNALS = "loan_number string, detector_id string, score double, evidence_json string"


def test_features_hold_no_labels_and_fill_blanks(spark, loans):
    s = spark.createDataFrame([("L001", "payroll_cap_exceedance", 2.0, '{"x_cap": 3.5}'), ("L001", "payroll_cap_exceedance", 4.0, "not json")], SIGNALS)
    t = {r["loan_number"]: r for r in features.thin_features(table(loans), s).collect()}
    assert t["L001"]["det_payroll_cap_exceedance"] == 4.0 and t["L002"]["det_payroll_cap_exceedance"] == 0.0 and t["L000"]["payroll_share"] == 2.0 and t["L000"]["round_amount"] == 1.0
    r = features.rich_features(table(loans), s, least=5)
    assert not [c for c in r.columns if "forgiv" in c or "status" in c]
    got = {x["loan_number"]: x for x in r.collect()}
    assert got["L001"]["payroll_x_cap"] == 3.5 and got["L000"]["cat_state"] == "__missing__" and got["L000"]["cat_originating_lender"] == "__rare__" and got["L001"]["cat_originating_lender"] == "Big" and got["L001"]["cat_franchise"] == "N"
    assert features.thin_features(table(loans, 0), s).isEmpty()


def test_models_find_what_positives_share(spark, loans):
    s = spark.createDataFrame([], SIGNALS)
    feats = learn.assemble(features.rich_features(table(loans), s))
    train = spark.createDataFrame([(f"L{i:03d}",) for i in range(100, 110)], "loan_number string")
    for score in (learn.pu_bagging(feats, train, bags=3), learn.boosted(feats, train, maxIter=5)):
        m = dict(score.groupBy(F.when(F.col("loan_number") < "L100", "rest").when(F.col("loan_number") >= "L110", "hidden").otherwise("train").alias("g")).agg(F.avg("score")).collect())
        assert m["hidden"] > m["rest"]


def test_bagging_has_all_trees_of_the_reference():
    assert inspect.signature(learn.pu_bagging).parameters["bags"].default == 50
