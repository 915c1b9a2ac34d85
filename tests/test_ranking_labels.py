import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import graph, labels, profile, ranking, similar
from ledgerlens.plans.benchmark import benchmark


def ranked(spark, order):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(order)], "loan_number string, rank int")


def known(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "loan_number string")


def signals(spark, rows):
    return spark.createDataFrame([(a, b, c, None) for a, b, c in rows], "loan_number string, detector_id string, score double, evidence_json string")


def test_metrics_divide_by_k(spark):
    m = {r["k"]: r for r in ranking.metrics_at(ranked(spark, "abcde"), known(spark, "a", "e", "z"), 30, (2, 10)).collect()}
    assert (m[2]["hits"], m[2]["precision"], m[2]["lift"], m[2]["recall"]) == (1, 0.5, 5.0, 0.3333)
    assert (m[10]["hits"], m[10]["precision"]) == (2, 0.2)
    empty = ranking.metrics_at(ranked(spark, "ab"), known(spark, "x").limit(0), 30, (1,)).first()
    assert empty["lift"] is None and empty["recall"] is None


def test_positive_ranks(spark):
    r = ranking.positive_rank_stats(ranked(spark, "abcd"), known(spark, "a", "d", "z"), 100).first()
    assert (r["n_ranked"], r["n_unranked"], r["mean_rank_ranked"], r["median_rank_ranked"]) == (2, 1, 2.5, 2.5)
    assert r["mean_percentile_in_ranking"] == 0.625 and r["mean_percentile_population_conservative"] == 0.35


def test_fusion(spark):
    f = ranking.fuse([ranked(spark, "abc"), ranked(spark, "cab")]).orderBy("rank").collect()
    assert [r["loan_number"] for r in f] == ["a", "c", "b"]
    with pytest.raises(ValueError):
        ranking.fuse([ranked(spark, "a")], [1.0, 2.0])


def test_composite_counts_signals(spark, loans):
    s = signals(spark, [("a", "x", 1.0), ("b", "x", 2.0), ("a", "y", 9.0), ("a", "y", 9.0), ("c", "x", float("nan")), (None, "x", 1.0), ("d", "y", None)])
    got = {r["loan_number"]: r for r in ranking.composite(s, loans([{"loan_number": "a", "borrower_name": "A"}])).collect()}
    assert set(got) == {"a", "b"} and got["a"]["n_signals"] == 2 and got["a"]["composite_score"] == 1.5 and got["b"]["composite_score"] == 1.0


def test_split_overlap_restrict(spark):
    cases = spark.createDataFrame([("OLD", dt.date(2020, 1, 1)), ("OLD", dt.date(2024, 1, 1)), ("NEW", dt.date(2024, 5, 1)), ("X", None), (None, dt.date(2020, 1, 1))], "loan_number string, charge_date date")
    assert dict(ranking.temporal_split(cases, 2022).collect()) == {"OLD": "train", "NEW": "test"}
    o = ranking.overlap(signals(spark, [("a", "p", 1.0), ("b", "p", 1.0), ("b", "q", 1.0)]), "p", "q").first()
    assert (o["n_a"], o["n_b"], o["intersection"], o["union"], o["jaccard"]) == (2, 1, 1, 2, 0.5)
    r = ranking.restrict(ranked(spark, "abcd"), known(spark, "d", "b")).orderBy("rank").collect()
    assert [(x["loan_number"], x["rank"]) for x in r] == [("b", 1), ("d", 2)]


def test_bootstrap_brackets(spark):
    order = [f"l{i:03d}" for i in range(300)]
    b = ranking.bootstrap_intervals(ranked(spark, order), known(spark, *order[:20:2]), 3000, (50,), 200).first()
    assert b["hits_low"] <= 10 <= b["hits_high"]
    b = ranking.bootstrap_intervals(ranked(spark, order), known(spark, order[49]), 3000, (50,), 200).first()
    assert b["hits_low"] == 0


RELEASE = "id string, source string, url string, title string, published_date date, program string, alleged_amount double, body string"


def test_resolve_exact(spark, loans):
    ls = loans([{"loan_number": "L1", "borrower_name": "Premier Care Staffing Inc", "borrower_state": "NY", "current_approval_amount": 476_420.0}, {"loan_number": "L2", "borrower_name": "Premier Care Staffing", "borrower_state": "TX", "current_approval_amount": 1.0}, {"loan_number": "L3", "borrower_name": "Staffing", "borrower_state": "NY", "current_approval_amount": 476_420.0}])
    r = spark.createDataFrame([("1", "doj", "u1", "Guilty", None, "ppp", None, "Owner of Premier Care Staffing of New York got $476,420."), ("2", "doj", "u2", None, None, "other", None, "Premier Care Staffing $476,420"), ("3", "doj", None, None, None, "ppp", None, None)], RELEASE)
    got = labels.resolve_exact(r, ls).collect()
    assert [x["loan_number"] for x in got] == ["L1"] and got[0]["match_confidence"] == 1.0 and got[0]["match_method"] == "name+state+amount"


def test_exact_names_meet_by_their_first_two_words_without_broadcasts(spark, loans):
    names = ["Blue Sky Cafe", "Blue Sky", "Blue Sky Cafe And Grill House North", "Sky Cafe", "United States", "Blue Grass Farm", "One Two Three Four Five Six Seven", "Last Words"]
    ls = loans([{"loan_number": str(i), "borrower_name": n, "borrower_state": "TX", "current_approval_amount": 50_000.0} for i, n in enumerate(names)])
    body = "United States of Texas: Blue Sky Cafe Grill House North got $50,000, Blue Sky Cafe too, one two three four five six seven, blue and last words"
    r = spark.createDataFrame([("1", "doj", "u1", None, None, "ppp", None, body), ("2", "doj", "u2", None, None, "ppp", None, "Sky"), ("3", "doj", "u3", None, None, "ppp", None, "$50,000 for Last Words")], RELEASE)
    got = labels.resolve_exact(r, ls)
    # the planner takes exploded runs for small, whatever their number
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["source_url"], x["loan_number"], x["match_confidence"]) for x in got.collect()) == [("u1", "0", 1.0), ("u1", "1", 0.95), ("u1", "2", 1.0), ("u1", "3", 0.95), ("u1", "7", 0.95), ("u3", "7", 0.7)]
    words = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (["a"],), ([],)], "w array<string>").withColumn("all", text.run_hashes(F.col("w")))
    one = words.withColumn("p", F.array(F.xxhash64(F.lit("a b")))).select(F.array_sort(text.runs_after_pairs(F.col("w"), F.col("p"))).alias("some"), "all").collect()
    assert len(one[0]["some"]) == 5 and set(one[0]["some"]) < set(one[0]["all"]) and not one[1]["some"] and not one[2]["some"]


def test_amount_blocks_and_judge(spark, loans):
    ls = loans([{"loan_number": "A", "borrower_name": "Solo Bakery", "current_approval_amount": 99_123.0}, {"loan_number": "B", "borrower_name": "B1", "current_approval_amount": 1_452_000.0}, {"loan_number": "C", "borrower_name": "C1", "current_approval_amount": 1_452_000.0}])
    r = spark.createDataFrame([("1", "doj", "u", "t", None, "ppp", None, "sums of $99,123 and $1,452,000")], RELEASE)
    c = labels.amount_candidates(r, ls, max_candidates=1)
    assert [x["loan_number"] for x in c.collect()] == ["A"]
    assert labels.amount_candidates(r, ls, spark.createDataFrame([("A",)], "loan_number string"), max_candidates=1).isEmpty()
    yes = lambda b: pd.DataFrame({"is_match": True, "confidence": 0.9, "matched_name": b["borrower_name"]})
    out = labels.adjudicate(c, r, yes).collect()
    assert out[0]["match_method"] == "amount+llm" and out[0]["loan_number"] == "A"


def test_raw_feed(spark):
    raw = spark.createDataFrame([("Fraud", "<p>A paycheck protection loan of $476,420 &amp; more</p>", "1600000000", "u"), ("Other", "tax matter", "x", "v")], "title string, body string, date string, url string")
    got = labels.parse_releases(raw).collect()
    assert len(got) == 1 and got[0]["body"] == "A paycheck protection loan of $476,420 & more" and got[0]["alleged_amount"] == 476_420 and got[0]["program"] == "ppp" and got[0]["published_date"] == dt.date(2020, 9, 13)


PLACE = {"borrower_city": "Austin", "borrower_state": "TX", "borrower_zip": "78701"}


def test_graph(spark, loans):
    rows = [{"loan_number": f"r{i}", "borrower_name": f"Sunrise Bakery {x}", "borrower_address": "1 Elm St", "current_approval_amount": 200_000.0, **PLACE} for i, x in enumerate(["One", "Two", "Three"])]
    rows += [{"loan_number": f"o{i}", "borrower_name": f"Tenant {i} {'xyzwv'[i] * 9}", "borrower_address": "9 Tower Rd", "current_approval_amount": 300_000.0 + 200_000 * i, **PLACE} for i in range(5)]
    rows += [{"loan_number": "solo", "borrower_name": "Alone", "borrower_address": "5 Oak Ln", "current_approval_amount": 900_000.0, **PLACE}, {"loan_number": "small", "borrower_name": "S", "borrower_address": "1 Elm St", "current_approval_amount": 10.0, **PLACE}]
    f = {r["loan_number"]: r for r in graph.graph_features(loans(rows), max_group=3, threshold=0.6).collect()}
    assert f["r0"]["component_size"] == 3 and f["r0"]["degree"] == 2 and f["r0"]["n_address_edges"] == 2 and f["r0"]["distinct_borrowers"] == 3
    assert f["o0"]["component_size"] == 1 and f["o0"]["degree"] == 0 and "small" not in f and f["solo"]["community_size"] == 1
    ring = graph.ring_signals(loans(rows), max_group=3, threshold=0.6)
    assert {r["loan_number"] for r in ring.collect()} <= {"r0", "r1", "r2"}


def test_components_on_chains(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y")]
    got = dict(graph.components(spark.createDataFrame(edges, "src string, dst string")).collect())
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["y"] == "x"
    assert graph.components(spark.createDataFrame([], "src string, dst string")).isEmpty()


def test_similar_and_reasons(spark, loans):
    rows = [{"loan_number": str(i), "borrower_name": n, "borrower_state": s, "naics_code": "72", "current_approval_amount": a, "borrower_zip": "1"} for i, (n, s, a) in enumerate([("Blue Sky Cafe", "TX", 200_000.0), ("Blue Sky Cafe Two", "TX", 201_000.0), ("Mining", "TX", 200_500.0), ("Blue Sky Cafe", "NY", 200_000.0), ("Blue Sky Cafe", "TX", 400_000.0), (None, "TX", 200_000.0)])]
    t = spark.createDataFrame([("0",), ("5",), ("77",)], "loan_number string")
    got = similar.similar_loans(loans(rows), t).orderBy("rank").collect()
    assert [r["loan_number"] for r in got] == ["1", "2"] and got[0]["same_naics"]
    assert dict(similar.reasons(loans(rows), t).collect()) == {"5": "missing_name", "77": "loan_not_found"}


@pytest.mark.parametrize("same_state, model", [(True, False), (False, True)])
def test_similar_loans_hold_no_pairs_and_cut_pools_as_asked(spark, loans, same_state, model):
    from ledgerlens.functions.embed import embed_text, embed_words, embedding, word_embedding

    words = ["Blue", "Sky", "Cafe", "Mining", "North", "Farm"]
    amounts = [200_000.0, 200_000.0, 200_000.0, 210_000.0, 190_000.0, 251_000.0, 149_000.0, 150_000.0, 160_000.5, 260_000.0]
    rows = [{"loan_number": f"{i * 37 % 101:03d}", "borrower_name": " ".join(words[j] for j in {i % 6, i // 2 % 6, i // 5 % 6}) + " é" * (i % 4 == 0), "borrower_state": ["TX", "NY", None][i % 3 if i % 11 else 2], "naics_code": [None, "72", "11"][i // 3 % 3], "borrower_zip": ["1", "2", None][i % 3], "current_approval_amount": amounts[i * 7 % 10] if i % 9 else None} for i in range(90)]
    t = spark.createDataFrame([(r["loan_number"],) for r in rows[::2]] + [("none",), (None,)], "loan_number string")
    options = {"same_state": same_state, "max_pool": 9}
    pool = similar.candidate_pool(loans(rows), t, **options).collect()
    meaning = embed_text if model else embed_words
    want = []
    for target in {r["target"] for r in pool}:
        p = [r for r in pool if r["target"] == target]
        info = {}
        for r in p:
            sims = [round(float(f(r["borrower_name"]) @ f(r["t_name"])), 6) for f in (embed_text, meaning)]
            same = [r["naics_code"] is not None and r["naics_code"] == r["t_naics"], r["borrower_zip"] is not None and r["borrower_zip"] == r["t_zip"]]
            info[r["loan_number"]] = (*sims, *same, abs(r["current_approval_amount"] - r["t_amount"]) / r["t_amount"])
        place = lambda by: {x: i + 1 for i, x in enumerate(sorted(info, key=by))}
        lex, sem, form = place(lambda x: (-info[x][0], x)), place(lambda x: (-info[x][1], x)), place(lambda x: (not info[x][2], info[x][4], not info[x][3], x))
        score = {x: 1.0 / (60 + sem[x]) + 0.6 / (60 + lex[x]) + 0.8 / (60 + form[x]) for x in info}
        want += [(target, i + 1, x, round(score[x], 6)) for i, x in enumerate(sorted(score, key=lambda x: (-score[x], x))[:4])]
    assert len(want) > 60
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = similar.similar_loans(loans(rows), t, None, 4, embedding if model else word_embedding, **options)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and (model or "ArrowEvalPython" not in plan)
        assert sorted((r["target"], r["rank"], r["loan_number"], r["fused_score"]) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_benchmark_end_to_end(spark, loans):
    rows = [{"loan_number": f"N{i}", "current_approval_amount": 150_000.0 + i, "jobs_reported": 10.0} for i in range(40)] + [{"loan_number": "F", "current_approval_amount": 900_000.0, "jobs_reported": 1.0}]
    s = signals(spark, [("F", "a", 9.0), ("F", "b", 9.0), ("N1", "a", 1.0)])
    c = spark.createDataFrame([("F",)], "loan_number string")
    got = {(r["ranking"], r["k"]): r["hits"] for r in benchmark(s, loans(rows), c, (1, 5)).collect()}
    assert got["composite", 1] == 1 and got["a", 1] == 1 and got["amount_per_job", 1] == 1 and len(got) == 10


def test_peers_name_their_reason(spark, loans):
    rows = [{"loan_number": f"N{i}", "naics_code": "7", "borrower_state": "TX", "current_approval_amount": 100.0, "jobs_reported": 1.0} for i in range(30)] + [{"loan_number": "A", "naics_code": "1", "borrower_state": "TX", "current_approval_amount": 5.0, "jobs_reported": 1.0}, {"loan_number": "B", "naics_code": None, "borrower_state": "TX", "current_approval_amount": 5.0, "jobs_reported": 1.0}, {"loan_number": "C"}]
    t = spark.createDataFrame([(x,) for x in ("N1", "A", "B", "C", "D")], "loan_number string")
    got = {r["loan_number"]: r["reason"] for r in profile.peers(loans(rows), t).collect()}
    assert got == {"N1": None, "A": "cohort_too_small", "B": "missing_cohort_key", "C": "missing_jobs_or_amount", "D": "loan_not_found"}


def test_large_components_get_communities_by_the_same_method(spark):
    n = [f"{i:04d}" for i in range(1200)]
    edges = list(zip(n, n[1:]))
    e = spark.createDataFrame(edges, "src string, dst string")
    comp = spark.createDataFrame([(x, n[0]) for x in n], "loan_number string, component string")
    sizes = spark.createDataFrame([(n[0], len(n))], "component string, component_size long")
    assert dict(graph._communities(e, comp, sizes, 5).collect()) == graph._greedy(n, edges)
