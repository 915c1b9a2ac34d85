"""Problem 7: percentiles by merging centroid digests, with rank errors certified by a second pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import stored

DIGEST = "means array<double>, weights array<double>, lo double, hi double, n double"


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of many groups at once: (group, mean, weight), groups and means ascending.

    The values of a group are sorted; with q the share of weight up to a value's middle, the size function
    k(q) = delta / (2 pi) * asin(2q - 1) is cut at whole numbers, so clusters are small at both ends and no cluster
    of several values spans more than one unit of k.
    """
    order = np.lexsort((mean, group))
    g, m, w = group[order], mean[order], weight[order]
    if not len(g):
        return g, m, w
    first = np.r_[True, g[1:] != g[:-1]]
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(g)])
    cum = np.cumsum(w)
    base = np.repeat(cum[at] - w[at], size)
    total = np.repeat(np.add.reduceat(w, at), size)
    q = np.clip((cum - base - w / 2) / total, 0, 1)
    k = np.floor(delta / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2)).astype(np.int64)
    new = np.flatnonzero(first | np.r_[True, k[1:] != k[:-1]])
    ws = np.add.reduceat(w, new)
    # the mean is kept inside its cluster, whatever the rounding
    ms = np.clip(np.add.reduceat(m * w, new) / ws, m[new], m[np.r_[new[1:], len(m)] - 1])
    return g[new], ms, ws


def quantile(means: np.ndarray, weights: np.ndarray, lo: float, hi: float, qs: np.ndarray) -> np.ndarray:
    """Interpolated between centroid middles; the ends are the exact smallest and largest values."""
    mid = np.cumsum(weights) - weights / 2
    n = weights.sum()
    return np.interp(qs * n, np.r_[0, mid, n], np.r_[lo, means, hi])


#: Digests of one group that are merged at a time, about.
FAN = 32


def digests(df: DataFrame, keys: list[str], value: str, delta: float = 200.0, fan: int = FAN) -> DataFrame:
    """One digest (means, weights, lo, hi, n) for each group; such tables of separate rows or days can be merged.

    Every batch of rows is reduced to digests before anything is shuffled, so a group with most of the rows costs
    at most delta centroids a batch; digests are merged by a tree, about fan of a group at a time.
    Null and NaN values are left out; a group without any value has no digest. Null keys are groups of their own.
    """
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    d = delta

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= 200_000:
                yield pack(pd.concat(held, ignore_index=True))
                held, rows = [], 0
        if held:
            yield pack(pd.concat(held, ignore_index=True))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        g = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        v = b["_v"].to_numpy(dtype=float)
        heads = b.iloc[np.sort(np.unique(g, return_index=True)[1])][keys].reset_index(drop=True)
        gs, ms, ws = cluster(g, v, np.ones(len(v)), d)
        at = np.flatnonzero(np.r_[True, gs[1:] != gs[:-1]]) if len(gs) else np.array([], int)
        order = np.lexsort((v, g))
        ends = np.flatnonzero(np.r_[np.diff(g[order]) != 0, True]) if len(g) else np.array([], int)
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        out = heads.copy()
        out["means"] = pd.Series(np.split(ms, at[1:]), index=out.index, dtype=object) if len(at) else pd.Series(dtype=object)
        out["weights"] = pd.Series(np.split(ws, at[1:]), index=out.index, dtype=object) if len(at) else pd.Series(dtype=object)
        out["lo"], out["hi"] = v[order][starts], v[order][ends]
        out["n"] = np.diff(np.r_[starts, len(v)]).astype(float)
        return out

    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    parts = rows.mapInPandas(reduce_rows, f"{ids}, {DIGEST}")
    parts = stored(parts, "digests")
    most = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    while most > fan:
        # as many salted parts of a group as leave about fan digests in each
        salts = -(-most // fan)
        parts = stored(merge(parts.withColumn("_salt", F.pmod(F.xxhash64("lo", "hi", "n", "means"), F.lit(salts))), [*keys, "_salt"], d).drop("_salt"), "digests")
        most = salts
    return merge(parts, keys, d)


def merge(parts: DataFrame, keys: list[str], delta: float = 200.0) -> DataFrame:
    """Digests of the same group merged by re-clustering their centroids.

    All centroid lists of a group are gathered, each fixed in size; digests() sees to it that they are few. Groups are
    then clustered many at a time, in Arrow batches.
    """
    d = delta

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            count = b["means"].map(len).to_numpy()
            gs, ms, ws = cluster(np.repeat(np.arange(len(b)), count), np.concatenate(b["means"].to_numpy()), np.concatenate(b["weights"].to_numpy()), d)
            at = np.flatnonzero(np.r_[True, gs[1:] != gs[:-1]])
            b["means"], b["weights"] = pd.Series(np.split(ms, at[1:]), index=b.index, dtype=object), pd.Series(np.split(ws, at[1:]), index=b.index, dtype=object)
            yield b

    got = parts.groupBy(*keys).agg(F.flatten(F.collect_list("means")).alias("means"), F.flatten(F.collect_list("weights")).alias("weights"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema)
    return got.mapInPandas(again, f"{ids}, {DIGEST}")


def estimates(parts: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, n, estimates): the values at qs, in order."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, "n"]].copy()
            out["estimates"] = pd.Series([quantile(np.asarray(m), np.asarray(w), lo, hi, np.array(qs)) for m, w, lo, hi in zip(b["means"], b["weights"], b["lo"], b["hi"])], index=b.index, dtype=object)
            yield out

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema)
    return parts.mapInPandas(ask, f"{ids}, n double, estimates array<double>")


def certified_percentiles(df: DataFrame, keys: list[str], values: list[str], qs: list[float], delta: float = 200.0) -> DataFrame:
    """(keys, measure, q, n, estimate, n_below, n_upto, rank_error), one row per group, value column and q.

    A second pass counts, for every estimate, the rows below it and up to it: the true ranks that the estimate
    holds. rank_error is the distance from q to that range as a share of n, and so a certificate, not a bound from
    theory. Rows are counted per group and distinct value first, so ties and hot groups shrink before the join.
    Keys with null are kept as groups; null and NaN values don't count; empty in, empty out.
    """
    clash = {"measure", "q", "n", "estimate", "n_below", "n_upto", "rank_error"} & {*keys}
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}")
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])).alias("_e")).select(*keys, F.col("_e.measure").alias("measure"), F.col("_e.x").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    by = [*keys, "measure"]
    est = stored(estimates(digests(rows, by, "x", delta), by, qs), "estimates")
    cells = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    e = est.select(*[F.col(k).alias(f"_{k}") for k in by], "estimates")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    at = range(len(qs))
    counted = (
        cells.join(e, same)
        .groupBy(*by)
        .agg(*[F.sum(F.when(F.col("x") < F.col("estimates")[i], F.col("c")).otherwise(0)).alias(f"_l{i}") for i in at], *[F.sum(F.when(F.col("x") <= F.col("estimates")[i], F.col("c")).otherwise(0)).alias(f"_u{i}") for i in at])
    )
    c = counted.select(*[F.col(k).alias(f"_{k}") for k in by], *[f"_{s}{i}" for s in "lu" for i in at])
    got = est.join(c, same).select(*by, "n", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col("estimates")[i].alias("estimate"), F.col(f"_l{i}").alias("n_below"), F.col(f"_u{i}").alias("n_upto")) for i, q in enumerate(qs)])).alias("r")).select(*by, F.col("n").cast("long").alias("n"), "r.*")
    want = F.col("q") * F.col("n")
    return got.withColumn("rank_error", F.greatest(F.col("n_below") - want, want - F.col("n_upto"), F.lit(0.0)) / F.col("n"))
