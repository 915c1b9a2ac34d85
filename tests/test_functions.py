import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.functions import ordered, stats, text
from ledgerlens.functions.embed import embed


def test_exact_quantiles_and_ranks(spark):
    random.seed(1)
    data = [(random.choice("abc"), float(random.randint(0, 40)) if random.random() > 0.1 else None) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in ordered.group_quantiles(df, ["k"], "v", {"m": 0.5, "u": 0.9}).collect()}
    for k in "abc":
        v = [x for g, x in data if g == k and x is not None]
        assert math.isclose(got[k]["m"], np.median(v)) and math.isclose(got[k]["u"], np.quantile(v, 0.9))
    cume = ordered.with_cume_dist(df, ["k"], "v").select("k", "v", "cume_dist").distinct().collect()
    for r in cume:
        v = [x for g, x in data if g == r["k"] and x is not None]
        assert math.isclose(r["cume_dist"], sum(x <= r["v"] for x in v) / len(v))


def test_q_values_against_the_definition(spark):
    random.seed(2)
    p = [round(random.random() ** 3, 3) for _ in range(300)]
    got = dict(ordered.with_q_values(spark.createDataFrame([(x,) for x in p], "p_value double")).distinct().collect())
    s = sorted(p)
    q = [min(min(s[j] * len(s) / (j + 1) for j in range(i, len(s))), 1) for i in range(len(s))]
    want = {}
    for x, y in zip(s, q):
        want[x] = min(y, want.get(x, 1))
    assert all(math.isclose(got[x], want[x]) for x in want)


def test_ranks_are_total(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("loan_number"))
    r = ordered.with_ranks(df, [F.col("a").desc(), F.col("loan_number")]).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, 1001))
    assert [(-x["a"], x["loan_number"]) for x in r] == sorted((-x["a"], x["loan_number"]) for x in r)


def test_robust_z_is_null_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 9.0)], "k string, v double")
    z = {(r["k"], r["v"]): r["robust_z"] for r in stats.with_robust_z(df, ["k"], "v").collect()}
    assert z["a", 1.0] is None and math.isclose(z["b", 9.0], 0.6744897501960817 * 7)


def test_upper_tail(spark):
    for z in (0.0, 0.5, 1.96, 3.0, 6.0):
        assert math.isclose(spark.range(1).select(stats.upper_tail_p(F.lit(z))).first()[0], 0.5 * math.erfc(z / 2**0.5), rel_tol=3e-7)


def key(spark, *parts):
    return spark.createDataFrame([parts], "borrower_address string, borrower_city string, borrower_state string, borrower_zip string").select(text.building_key()).first()[0]


def test_building_keys(spark):
    want = "123 MAIN ST | AUSTIN | TX | 78701"
    assert key(spark, "123 Main Street", "Austin", "tx", "78701-1234") == want
    assert key(spark, "123 main st., Suite #200", "Austin.", "TX", "78701") == want
    assert key(spark, "  ", "Austin", "TX", "78701") is None and key(spark, None, None, None, None) is None
    assert key(spark, "Suite 5", "Austin", "TX", "78701") is None
    assert key(spark, "5 Elm Ave", None, "", "1") == "5 ELM AVE | 1"


def test_names_and_runs(spark):
    df = spark.createDataFrame([("The Premier Care Staffing, Inc.",), (None,), ("LLC",)], "n string").select(text.norm_name("n").alias("x"), text.ngrams(text.name_tokens("n")).alias("g"))
    got = df.collect()
    assert [r["x"] for r in got] == ["PREMIER CARE STAFFING", "", ""]
    assert sorted(got[0]["g"]) == ["CARE STAFFING", "PREMIER CARE", "PREMIER CARE STAFFING"] and got[1]["g"] == []


def test_amounts(spark):
    t = "paid $1.5 million, then $ 20,000 and $12345.67, not $999"
    r = spark.createDataFrame([(t,), ("nothing",), (None,)], "t string").select(text.largest_amount("t").alias("m"), text.dollar_figures("t").alias("f")).collect()
    assert r[0]["m"] == 1_500_000 and r[0]["f"] == [12345, 20000]
    assert r[1]["m"] is None and r[1]["f"] == [] and r[2]["m"] is None


def test_embedder():
    v = embed(["Acme Bakery", "acme bakery ", "Zyx Mining", "", None])
    assert np.allclose(v[0], v[1]) and v[0] @ v[2] < 0.5 and not v[3].any() and not v[4].any()
    assert np.allclose(np.linalg.norm(v[:3], axis=1), 1)


def test_hot_values_join_as_the_others_do(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ledgerlens.functions.ordered import with_cume_dist, with_q_values

    rows = [("a", 0.5)] * 900 + [("a", i / 2000) for i in range(60)] + [("b", 0.5)] * 3 + [("b", 0.25)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("i", F.monotonically_increasing_id())
    got = {r["i"]: r["cume_dist"] for r in with_cume_dist(df, ["g"], "v").collect()}
    want = {r["i"]: r["c"] for r in df.withColumn("c", F.cume_dist().over(Window.partitionBy("g").orderBy("v"))).collect()}
    assert got == want
    q = with_q_values(df.withColumnRenamed("v", "p_value")).collect()
    assert len(q) == len(rows) and all(0 < r["q_value"] <= 1 or r["p_value"] == 0 for r in q)


def test_vectors_in_blocks_of_one(spark):
    from ledgerlens.operators.similar import vector_top_k

    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(30)] + [(99, None)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0")
    a, b = (sorted(map(tuple, vector_top_k(v, q, 4, block=n).collect())) for n in (1, 4096))
    assert a == b and len(a) == 12 and vector_top_k(v, q.limit(0), 4).isEmpty()


def test_stored_tables_are_counted_and_forgotten(spark):
    from ledgerlens.functions import store

    df, n = store.stored_counted(spark.range(7), "seven")
    none, zero = store.stored_counted(spark.range(7).where("id < 0").distinct(), "none")
    assert (n, zero, df.count(), none.count()) == (7, 0, 7, 0)
    files = df.inputFiles()
    store.forget(spark)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
