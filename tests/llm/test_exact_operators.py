"""Operators whose result is defined exactly: held against brute force on small tables full of awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import boilerplate, components, digests, leakage, ranking


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_groups_match_union_find(spark):
    random.seed(5)
    pairs = [(f"n{random.randint(0, 300)}", f"n{random.randint(0, 300)}") for _ in range(220)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)]
    rows = [(a, b, "x") for a, b in pairs] + [("q", None, "x"), (None, "q", "x"), (None, None, "x"), ("z", "z", "x")] + [(b, a, "x") for a, b in pairs[:50]]
    df = spark.createDataFrame(rows, "loan_a string, loan_b string, root string")
    got = {r["node"]: r["group_id"] for r in components.boruvka_groups(df).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    assert components.boruvka_groups(df.limit(0)).isEmpty()


def brute_lines(rows, least=3, share=0.05):
    ids, at, docs = {}, set(), {}
    for i, s, b in rows:
        if i is None:
            continue
        ids.setdefault(s, set()).add(i)
        for n, line in enumerate((b or "").split("\n"), 1):
            k = "".join(c for c in line.lower() if c.isalpha())
            if k:
                at.add((i, n, s, k))
                docs.setdefault((s, k), set()).add(i)
    return {(i, n) for i, n, s, k in at if len(docs[s, k]) >= max(least, share * len(ids[s]))}


def release_rows():
    random.seed(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    fixed = ["Share this: Mail | Print", "(c) 2020 ALL RIGHTS reserved", "X", "é très bien", "Ad"]
    rows = []
    for i in range(120):
        body = [" ".join(random.choices(words, k=12)) for _ in range(4)]
        for f in fixed:
            if random.random() < 0.2:
                body.insert(random.randint(0, len(body)), f.upper() if random.random() < 0.5 else f + f" {i}")
        rows.append((f"r{i}", "big" if i % 3 else None if i % 2 else "small", "\n".join(body)))
    return [*rows, rows[0], rows[1], ("e1", "big", ""), ("e2", "big", None), (None, "big", "Ad"), ("e3", "big", "\n\n1 2 3\n"), ("long", "big", "word " * 200_000 + "\nAd")]


def test_repeated_lines_match_brute_force(spark):
    rows = release_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, source string, body string, text string, line_no int")
    got = {(r["id"], r["line_no"]) for r in boilerplate.repeated_lines(df).collect()}
    assert got == brute_lines(rows) and got
    cleaned = {(r["id"], r["source"]): r for r in boilerplate.without_repeated_lines(df).collect()}
    assert cleaned["e2", "big"]["body"] is None
    for i, s, b in rows:
        if i and b is not None:
            want = "\n".join(x for n, x in enumerate(b.split("\n"), 1) if (i, n) not in got)
            assert cleaned[i, s]["body"] == want
    assert boilerplate.repeated_lines(df.limit(0)).isEmpty()


def test_chunks_depend_on_content_only():
    a = boilerplate.chunks_of(["abcdefghijklmnopqrstuvwxyz" * 9, "QQQQ abcdefghijklmnopqrstuvwxyz" * 9], False)
    assert len(set(a[a["doc"] == 0]["hash"]) & set(a[a["doc"] == 1]["hash"])) >= 1
    lines = boilerplate.chunks_of(["one two three four\nSHARE this page 12", "share THIS page\nother"], True)
    first = lines[(lines["doc"] == 0) & (lines["line"] == 2)]["hash"].tolist()
    assert first == lines[(lines["doc"] == 1) & (lines["line"] == 1)]["hash"].tolist()
    for t in ("a😀b" * 50, "", "\n", "123"):
        c = boilerplate.chunks_of([t], False)
        assert (c["end"] > c["start"]).all()


def test_chunk_removal_keeps_the_rest(spark):
    random.seed(8)
    notice = "This notice is sent to all readers of the bulletin and must not be copied without leave of the editor in writing"
    rows = [(f"d{i}", "s", " ".join(random.choices("red green blue black white".split(), k=30)) + str(i) + " " + notice + " " + "".join(random.choices("abcdefghij ", k=80))) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, source string, body string")
    for r in boilerplate.without_repeated_chunks(df, min_docs=10).collect():
        b = dict((x[0], x[2]) for x in rows)[r["id"]]
        assert len(b) - len(r["body"]) >= r["letters_cut"] > 40 and r["body"][:10] == b[:10]


def test_leaks_match_brute_force(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (93, "Same Text " * 20), (94, "same text " * 20)]
    docs = []
    for d in range(60):
        w = random.choices(vocabulary, k=random.randint(0, 200))
        if d % 2:
            src = items[d % 30][1].split()
            n = random.choice([11, 12, 13, 14, 40])
            a = random.randint(0, max(0, len(src) - n))
            p = random.randint(0, len(w))
            w[p:p] = [x.upper() + "!" for x in src[a : a + n]]
        docs.append((d, ", ".join(w)))
    docs += [(900, None), (901, ""), (902, "same text, SAME text " * 3000), (None, "same text " * 30)]
    grams = {}
    for i, t in items:
        w = leakage.words_of(t)
        for j in range(len(w) - 12):
            grams.setdefault(tuple(w[j : j + 13]), set()).add(i)
    want = {(d, i) for d, t in docs if d is not None for w in [leakage.words_of(t)] for j in range(len(w) - 12) for i in grams.get(tuple(w[j : j + 13]), ())}
    a = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, similarity double")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = leakage.leaked_items(a, b, slice_bytes=2000).where("exact_windows > 0")
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want
    assert leakage.leaked_items(a.limit(0), b).isEmpty() and leakage.leaked_items(a, b.limit(0)).isEmpty()


def test_multi_index_finds_all_within_radius():
    r = np.random.default_rng(1)
    index = leakage.Index([(0, " ".join(f"x{i}" for i in range(80)))], 13, 3)
    base = index.print[r.integers(0, len(index.print), 200)]
    flips = np.zeros(200, np.uint64)
    for i in range(200):
        for b in r.choice(64, i % 6, replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    i, j = index.candidates(base ^ flips)
    want = {(a, c) for a in range(200) for c in range(len(index.print)) if bin(int((base[a] ^ flips[a]) ^ index.print[c])).count("1") <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def brute_flows(rows, q, p):
    best = {}
    for a, d, s in rows:
        if a is not None and d is not None and s is not None and not math.isnan(s):
            best[d, a] = max(s, best.get((d, a), -math.inf))
    by = {}
    for (d, a), s in best.items():
        by.setdefault(d, {})[a] = s
    out = {}
    for d, xs in by.items():
        n = len(xs)
        pct = {a: (sum(v < s for v in xs.values()) + sum(v == s for v in xs.values()) / 2) / n for a, s in xs.items()}
        pref = lambda x: min(max((x - q) / (p - q), 0), 1)
        for a in xs:
            o = out.setdefault(a, [0, 0.0, 0.0])
            o[0] += 1
            o[1] += sum(pref(pct[a] - pct[b]) for b in xs) / max(n - 1, 1) / len(by)
            o[2] += sum(pref(pct[b] - pct[a]) for b in xs) / max(n - 1, 1) / len(by)
    return out


def test_flows_match_all_pairs(spark):
    random.seed(10)
    rows = [(f"l{random.randint(0, 60)}", d, round(random.random() * scale, k)) for d, scale, k in (("a", 1, 1), ("b", 1e9, 3), ("c", -50, 0)) for _ in range(80)]
    rows += [("l1", "a", None), ("l2", "a", float("nan")), (None, "a", 1.0), ("l3", None, 1.0), ("only", "one", 5.0), ("l4", "b", float("inf"))] + rows[:10]
    df = spark.createDataFrame([(*r, 1) for r in rows], "loan_number string, detector_id string, score double, rank int")
    want = brute_flows(rows, 0.05, 0.5)
    got = {r["loan_number"]: r for r in ranking.net_flow_ranking(df).collect()}
    assert set(got) == set(want)
    for a, (n, plus, minus) in want.items():
        assert got[a]["n_scores"] == n and math.isclose(got[a]["plus_flow"], plus, abs_tol=1e-8) and math.isclose(got[a]["minus_flow"], minus, abs_tol=1e-8)
    flows = sorted((-r["net_flow"], r["rank"]) for r in got.values())
    assert all(r == 1 + sum(f < g for f, _ in flows) for g, r in flows)
    scaled = df.withColumn("score", F.when(F.col("detector_id") == "b", F.col("score") * 1e6).otherwise(F.col("score")))
    assert {r["loan_number"]: r["rank"] for r in ranking.net_flow_ranking(scaled).collect()} == {k: v["rank"] for k, v in got.items()}
    assert ranking.net_flow_ranking(df.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        ranking.net_flow_ranking(df, preference=0.01)


def test_digests_are_certified_and_mergeable(spark):
    random.seed(11)
    rows = [("hot", random.lognormvariate(10, 2)) for _ in range(4000)] + [(f"g{i % 30}", float(i % 7)) for i in range(900)] + [(None, 5.0), ("hot", None), ("hot", float("nan")), ("tiny", -3.0), ("empty", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "naics_code string, v double, n string").repartition(5)
    qs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = digests.certified_percentiles(df, ["naics_code"], ["v"], qs, delta=100).collect()
    by = {(r["naics_code"], r["q"]): r for r in got}
    assert {k for k, _ in by} == {r[0] for r in rows} - {"empty"}
    for (k, q), r in by.items():
        v = sorted(x for g, x in rows if g == k and x is not None and not math.isnan(x))
        assert r["n"] == len(v) and r["n_below"] == sum(x < r["estimate"] for x in v) and r["n_upto"] == sum(x <= r["estimate"] for x in v)
        assert r["rank_error"] <= 0.02 + 1.0 / len(v)
    assert by["hot", 0.0]["estimate"] == min(x for g, x in rows if g == "hot" and x is not None and not math.isnan(x)) and by["tiny", 0.5]["estimate"] == -3.0
    halves = [digests.digests(df.where(c), ["naics_code"], "v", 100) for c in ("v < 3", "v >= 3")]
    both = {r["naics_code"]: r for r in digests.estimates(digests.merge(halves[0].unionByName(halves[1]), ["naics_code"], 100), ["naics_code"], qs).collect()}
    v = np.array(sorted(x for g, x in rows if g == "hot" and x is not None and not math.isnan(x)))
    assert both["hot"]["n"] == 4000 and abs((v <= both["hot"]["estimates"][2]).mean() - 0.5) < 0.02
    assert digests.certified_percentiles(df.limit(0), ["naics_code"], ["v"], qs).isEmpty()
    with pytest.raises(ValueError):
        digests.certified_percentiles(df, ["n"], ["v"], qs)
