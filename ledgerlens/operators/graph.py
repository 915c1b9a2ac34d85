"""A graph of loans that share a building, an entity, or a look-alike name in a block of state and amount."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.embed import embed
from ..functions.store import stored
from ..functions.stats import rounded
from ..sources.readers import one_per_loan

COLUMNS = ("borrower_name", "borrower_address", "borrower_city", "borrower_state", "borrower_zip", "current_approval_amount")


def _nodes(loans: DataFrame, min_amount: float) -> DataFrame:
    return one_per_loan(loans, *COLUMNS).where(F.col("current_approval_amount") >= min_amount)


def cliques(keyed: DataFrame, key: str, kind: str, max_group: int) -> DataFrame:
    """(src, dst, type) of all pairs of loans with the same key, in groups of 2 to max_group.

    Larger groups are no relation (an office tower, a placeholder); they are dropped by count before the self-join,
    so the pairs of a group are bounded.
    """
    fit = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, max_group)).select(key)
    rows = keyed.join(fit, key)
    a, b = rows.select(key, F.col("loan_number").alias("src")), rows.select(key, F.col("loan_number").alias("dst"))
    return a.join(b, key).where("src < dst").select("src", "dst", F.lit(kind).alias("type"))


def _look_alikes(nodes: DataFrame, threshold: float, band: float, max_group: int) -> DataFrame:
    key = F.concat_ws("|", "borrower_state", rounded(F.col("current_approval_amount") / band, 0).cast("long"))
    rows = nodes.where((F.coalesce("borrower_state", F.lit("")) != "") & (F.trim(F.coalesce("borrower_name", F.lit(""))) != "")).select("loan_number", "borrower_name", key.alias("block"))
    fit = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, max_group)).select("block")

    def near(b: pd.DataFrame) -> pd.DataFrame:
        v = embed(b["borrower_name"].tolist())
        i, j = np.nonzero(np.triu(v @ v.T >= threshold, 1))
        n = b["loan_number"].to_numpy()
        lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return pd.DataFrame({"src": lo, "dst": hi, "type": "similarity"})

    return rows.join(fit, "block").groupBy("block").applyInPandas(near, "src string, dst string, type string")  # at most max_group rows a group


def loan_edges(loans: DataFrame, min_amount: float = 150_000.0, kinds: tuple[str, ...] = ("address", "entity", "similarity"), max_group: int = 50, threshold: float = 0.85, band: float = 50_000.0) -> DataFrame:
    """(src, dst, types) with src < dst: relations of the loans from min_amount on."""
    nodes = _nodes(loans, min_amount)
    parts = []
    if "address" in kinds:
        parts.append(cliques(nodes.select("loan_number", text.building_key().alias("k")), "k", "address", max_group))
    if "entity" in kinds:
        parts.append(cliques(nodes.select("loan_number", text.entity_key().alias("k")), "k", "entity", max_group))
    if "similarity" in kinds:
        parts.append(_look_alikes(nodes, threshold, band, max_group))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("src", "dst").agg(F.array_sort(F.collect_set("type")).alias("types"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(loan_number, component): component is the smallest loan number reachable. Loans without edges don't appear.

    Alternating large-star and small-star: each round is an aggregation by node and a join, edges shrink to stars, and
    rounds grow with the logarithm of the longest path. Every round is written, so a lost executor costs one round.
    """
    e = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges")
    # edges are distinct, so a changed set shows in its size or in the sum of its hashes
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        new = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        e, last, before = new, before, state(new)
        if last == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("loan_number"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("loan_number"), F.col("v").alias("component"))).distinct()


def _greedy(nodes: list[str], pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Size of each node's community: merges the two groups that gain most modularity while any gain is left.

    Gains wait in a heap; a merge adds the new gains of its group, and those that no longer hold are passed over.
    """
    m = len(pairs)
    names = sorted(nodes)
    at = {n: i for i, n in enumerate(names)}
    group = {i: [i] for i in range(len(names))}
    links: list[dict[int, int]] = [{} for _ in names]
    for a, b in ((at[a], at[b]) for a, b in pairs):
        links[a][b] = links[a].get(b, 0) + 1
        links[b][a] = links[b].get(a, 0) + 1
    share = [sum(x.values()) / (2 * m) for x in links]
    gain = lambda a, b: links[a][b] / m - 2 * share[a] * share[b]
    heap = [(-gain(a, b), -a, -b) for a, x in enumerate(links) for b in x if a < b]
    heapq.heapify(heap)
    while heap and heap[0][0] < -1e-12:
        g, a, b = heapq.heappop(heap)
        a, b = -a, -b
        if b not in links[a] or gain(a, b) != -g:
            continue
        group[a] += group.pop(b)
        share[a] += share[b]
        for c, w in links[b].items():
            links[c].pop(b)
            if c != a:
                links[a][c] = links[a].get(c, 0) + w
                links[c][a] = links[a][c]
        links[b] = {}
        for c in links[a]:
            lo, hi = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(lo, hi), -lo, -hi))
    return {names[n]: len(g) for g in group.values() for n in g}


def _communities(edges: DataFrame, comp: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(loan_number, community_size) in components of `least` loans and more, each component in one task."""
    inside = edges.join(comp.select(F.col("loan_number").alias("src"), "component"), "src").join(sizes.where(F.col("component_size") >= least), "component").select("component", "src", "dst")

    def greedy(b: pd.DataFrame) -> pd.DataFrame:
        got = _greedy(sorted({*b["src"], *b["dst"]}), list(zip(b["src"], b["dst"])))
        return pd.DataFrame({"loan_number": list(got), "community_size": np.array(list(got.values()), np.int64)})

    return inside.groupBy("component").applyInPandas(greedy, "loan_number string, community_size long")


def graph_features(loans: DataFrame, min_amount: float = 150_000.0, least: int = 5, edges: DataFrame | None = None, **options) -> DataFrame:
    """One row per loan from min_amount on: component and its size, degree, edges by relation, borrowers, community size.

    edges are those of loan_edges() where they are at hand.
    """
    edges = stored(loan_edges(loans, min_amount, **options), "graph") if edges is None else edges
    comp = stored(components(edges), "components")
    nodes = _nodes(loans, min_amount).select("loan_number", text.norm_name("borrower_name").alias("_name"))
    of = nodes.join(comp, "loan_number", "left").withColumn("component", F.coalesce("component", "loan_number"))
    names = of.groupBy("component", "_name").agg(F.count(F.lit(1)).alias("c"))
    per = names.groupBy("component").agg(F.sum("c").alias("component_size"), F.count(F.when(F.col("_name") != "", 1)).alias("distinct_borrowers"))
    per = stored(per, "component_sizes")
    ends = edges.select("src", "types").unionByName(edges.select(F.col("dst").alias("src"), "types")).groupBy(F.col("src").alias("loan_number")).agg(F.count(F.lit(1)).alias("degree"), *[F.count(F.when(F.array_contains("types", k), 1)).alias(f"n_{k}_edges") for k in ("address", "entity", "similarity")])
    com = _communities(edges, comp, per, least)
    got = of.join(per, "component").join(ends, "loan_number", "left").join(com, "loan_number", "left")
    return got.select("loan_number", "component", "component_size", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "n_address_edges", "n_entity_edges", "n_similarity_edges")], "distinct_borrowers", F.coalesce("community_size", "component_size").alias("community_size"))


def ring_signals(loans: DataFrame, min_edge_types: int = 2, min_borrowers: int = 2, **options) -> DataFrame:
    """Loans of components with several relations and several borrowers."""
    edges = stored(loan_edges(loans, **{k: v for k, v in options.items() if k != "least"}), "graph")
    feats = stored(graph_features(loans, edges=edges, **{k: v for k, v in options.items() if k in ("min_amount", "least")}), "graph_features")
    kinds = edges.join(feats.select(F.col("loan_number").alias("src"), "component"), "src").select("component", F.explode("types").alias("t")).groupBy("component").agg(F.array_sort(F.collect_set("t")).alias("edge_types"))
    best = feats.groupBy("component").agg(F.max("community_size").alias("_most"))
    hit = feats.join(kinds.where(F.size("edge_types") >= min_edge_types), "component").join(best, "component").where(F.col("distinct_borrowers") >= min_borrowers)
    score = F.log1p("distinct_borrowers") + F.log1p("_most")
    return hit.select("loan_number", rounded(score, 4).alias("score"), "component_size", "distinct_borrowers", F.array_join("edge_types", ",").alias("edge_types"), "n_address_edges", "n_entity_edges", "n_similarity_edges", "community_size")
