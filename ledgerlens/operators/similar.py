"""Look-alike retrieval: blocked candidates, three rankings, rank fusion; for one loan or a table of targets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import counts, word_embedding
from ..functions.ordered import with_ranks
from ..functions.stats import rounded
from ..functions.store import stored
from ..sources.readers import one_per_loan

COLUMNS = ("borrower_name", "borrower_city", "borrower_state", "borrower_zip", "naics_code", "current_approval_amount", "jobs_reported")
#: Query vectors that go to the executors at a time.
BLOCK = 4096
#: Targets that are compared with their pools at a time.
TARGETS = 64
WEIGHTS = {"semantic": 1.0, "lexical": 0.6, "structured": 0.8}


def _zip5(c: str = "borrower_zip") -> Column:
    return F.nullif(F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, 5), F.lit(""))


def candidate_pool(loans: DataFrame, targets: DataFrame, min_amount: float = 150_000.0, amount_tol: float = 0.25, same_state: bool = True, max_pool: int = 3000) -> DataFrame:
    """(target, loan_number, ...) of loans within the amount band of each target, in its state, closest amounts first.

    A banded range join: amounts fall into logarithmic bands as wide as the tolerance, and a target meets its own and
    the two neighbouring bands by an equi-join. max_pool is the size of the pool that the operator is asked for.
    """
    l = one_per_loan(loans, *COLUMNS).where((F.col("current_approval_amount") >= min_amount) & (F.coalesce("borrower_name", F.lit("")) != ""))
    step = -F.log(F.lit(1 - amount_tol))
    band = lambda c: F.floor(F.log(c) / step).cast("int")
    t = one_per_loan(loans, *COLUMNS).join(targets.select("loan_number").distinct(), "loan_number", "left_semi").where((F.trim(F.coalesce("borrower_name", F.lit(""))) != "") & (F.col("current_approval_amount") > 0))
    t = t.select(F.col("loan_number").alias("target"), F.col("borrower_name").alias("t_name"), F.col("borrower_state").alias("t_state"), F.col("naics_code").alias("t_naics"), _zip5().alias("t_zip"), F.col("current_approval_amount").alias("t_amount"))
    t = t.withColumn("band", F.explode(F.sequence(band(F.col("t_amount")) - 1, band(F.col("t_amount")) + 1)))
    l = l.withColumn("band", band(F.col("current_approval_amount")))
    keys = (F.col("l.band") == F.col("t.band")) & (F.col("l.borrower_state") == F.col("t.t_state") if same_state else F.lit(True))
    got = l.alias("l").join(t.alias("t"), keys).drop("band").where((F.col("loan_number") != F.col("target")) & F.col("current_approval_amount").between(F.col("t_amount") * (1 - amount_tol), F.col("t_amount") * (1 + amount_tol)))
    near = Window.partitionBy("target").orderBy(F.abs(F.col("current_approval_amount") - F.col("t_amount")), "loan_number")
    return got.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= max_pool).drop("_n")


class _Nearest:
    """The rows of one group (state and amount band) in order of amount: candidates near the next targets, and targets that still wait for candidates above them.

    A target's pool is the max_pool rows closest in amount, so max_pool + 1 rows (itself may be one) on either side
    of it are enough, and of those with one amount the first max_pool + 1 by number.
    """

    def __init__(self, k: int, tol: float, most: int):
        self.k, self.tol, self.most = k, tol, most
        self.have = self.waiting = None
        self.vectors: dict[str, np.ndarray] = {}
        self.made = np.zeros(0, bool)

    def add(self, b: pd.DataFrame) -> None:
        c, t = b[b["cand"].to_numpy(bool)].reset_index(drop=True), b[b["asked"].to_numpy(bool)]
        self.have = c if self.have is None else pd.concat([self.have, c], ignore_index=True)
        self.waiting = t if self.waiting is None else pd.concat([self.waiting, t], ignore_index=True)
        self.made = np.append(self.made, np.zeros(len(c), bool))
        self.vectors = {w: np.concatenate([v, np.zeros((len(c), v.shape[1]), v.dtype)]) for w, v in self.vectors.items()}
        x = self.have["amount"].to_numpy()
        self._keep(np.arange(len(x)) - np.searchsorted(x, x, "left") <= self.most)
        self.end = b["amount"].iloc[-1]

    def _keep(self, rows: np.ndarray) -> None:
        if not rows.all():
            self.have, self.made = self.have[rows].reset_index(drop=True), self.made[rows]
            self.vectors = {w: v[rows] for w, v in self.vectors.items()}

    def _vectors(self, start: int, stop: int) -> dict[str, np.ndarray]:
        """Of the candidates from start to stop; each is made once."""
        todo = start + np.flatnonzero(~self.made[start:stop])
        for w, v in _embedded(self.have.iloc[todo]).items():
            if w not in self.vectors:
                self.vectors[w] = np.zeros((len(self.have), v.shape[1]), v.dtype)
            self.vectors[w][todo] = v
        self.made[todo] = True
        return {w: v[start:stop] for w, v in self.vectors.items()}

    def ready(self, over: bool) -> Iterator[pd.DataFrame]:
        """The results of the targets whose pool is whole; of all when the group is over."""
        x, t = self.have["amount"].to_numpy(), self.waiting["amount"].to_numpy()
        edge = np.searchsorted(x, t, "right") + self.most
        full = np.append(x, np.inf)[np.minimum(edge, len(x))] < self.end
        done = np.ones(len(t), bool) if over else full | (t * (1 + self.tol) < self.end)
        n = len(t) if done.all() else int(np.argmin(done))  # in order of amount
        for i in range(0, n, TARGETS):
            yield from self._block(self.waiting.iloc[i : min(i + TARGETS, n)])
        self.waiting = self.waiting.iloc[n:].reset_index(drop=True)
        # rows below that no later target needs
        first = t[n] if n < len(t) else self.end
        below = np.searchsorted(x, first, "right") - self.most - 1
        least = x[below] if below >= 0 and len(x) else -np.inf
        self._keep(x >= max(least, first * (1 - self.tol)))

    def _block(self, ts: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, t = self.have["amount"].to_numpy(), ts["amount"].to_numpy()
        at = np.searchsorted(x, t, "right")
        low, high = np.searchsorted(x, t * (1 - self.tol), "left"), np.searchsorted(x, t * (1 + self.tol), "right")
        if len(x):
            low = np.maximum(low, np.searchsorted(x, x[np.maximum(at - self.most - 1, 0)], "left"))
            high = np.minimum(high, np.searchsorted(x, x[np.minimum(at + self.most, len(x) - 1)], "right"))
        start, stop = int(low.min()), int(high.max())
        if stop <= start:
            return
        c = self.have.iloc[start:stop]
        n, x = len(c), x[start:stop]
        both = pd.concat([c, ts], ignore_index=True)
        order = np.empty(len(both), np.int64)
        order[np.array(sorted(range(len(both)), key=both["loan_number"].tolist().__getitem__))] = np.arange(len(both))
        numbers, names = both["loan_number"].to_numpy(object), both["borrower_name"].to_numpy(object)
        codes = {w: pd.factorize(both[w])[0] for w in ("loan_number", "naics_code", "zip5", "state")}
        of, to = self._vectors(start, stop), _embedded(ts)
        lexical, semantic = (_cosines(of[w], to[w]) for w in ("lexical", "semantic"))
        order, out = order[:n], []
        for i in range(len(ts)):
            same = {w: (v[:n] == v[n + i]) & (v[n + i] >= 0) for w, v in codes.items()}
            rows = np.arange(low[i] - start, high[i] - start)
            rows = rows[~same["loan_number"][rows]]
            gap = np.abs(x[rows] - t[i])
            if len(rows) > self.most:
                last = np.partition(gap, self.most - 1)[self.most - 1]
                inside, ties = rows[gap < last], rows[gap == last]
                rows = np.concatenate([inside, ties[np.argsort(order[ties])][: self.most - len(inside)]])
                gap = np.abs(x[rows] - t[i])
            if not len(rows):
                continue
            o, by = order[rows], lambda *keys: np.argsort(np.lexsort(keys[::-1])) + 1
            lex, sem, pct = lexical[rows, i], semantic[rows, i], gap / t[i]
            naics, zip5 = same["naics_code"][rows], same["zip5"][rows]
            f = WEIGHTS["semantic"] / (60 + by(-sem, o)) + WEIGHTS["lexical"] / (60 + by(-lex, o)) + WEIGHTS["structured"] / (60 + by(~naics, pct, ~zip5, o))
            best = np.lexsort((o, -f))[: self.k]
            r = rows[best]
            out.append(pd.DataFrame({"target": numbers[n + i], "rank": np.arange(1, len(r) + 1, dtype=np.int32), "loan_number": numbers[r], "borrower_name": names[r], "semantic_sim": sem[best], "lexical_sim": lex[best], "amount_delta_pct": pct[best], "same_naics": naics[best], "same_state": same["state"][r], "same_zip5": zip5[best], "_f": f[best]}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _embedded(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Counts of grams, and of words or the vectors of a model; nothing for no rows."""
    names = rows["borrower_name"].tolist()
    if not names:
        return {}
    return {"lexical": counts(names), "semantic": np.stack(rows["m"].to_numpy()).astype(np.float64) if "m" in rows else counts(names, True)}


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b, to six places. Counts (single precision) are whole numbers: their products are exact."""
    size = lambda v: np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)), 1e-300) if v.dtype == np.float32 else np.ones(len(v))
    return np.rint((a @ b.T).astype(np.float64) / size(a)[:, None] / size(b) * 1e6) / 1e6 + 0.0


def similar_loans(loans: DataFrame, targets: DataFrame, labelled: DataFrame | None = None, k: int = 20, semantic: Callable[[str], Column] = word_embedding, min_amount: float = 150_000.0, amount_tol: float = 0.25, same_state: bool = True, max_pool: int = 3000) -> DataFrame:
    """The k most similar loans of every target in its candidate_pool(), best first.

    Rankings by meaning of the names, by their character n-grams and by structure (same industry, amount gap, same
    post code) are fused by reciprocal ranks. semantic makes an array column of unit vectors from a column of names;
    no model of meaning is at hand, so by default whole words in common stand for it. Targets that aren't found, or
    without a name or amount, have no rows (see reasons()).

    The pairs of the pool are never rows of a table: loans go to their own and the two neighbouring bands of amounts,
    each band of a state is read in order of amount, and only the k best of a target come out.
    """
    asked = targets.where(F.col("loan_number").isNotNull()).select("loan_number").distinct().withColumn("_asked", F.lit(True))
    l = one_per_loan(loans, *COLUMNS).where(F.coalesce("borrower_name", F.lit("")) != "").join(asked, "loan_number", "left")
    amount, name = F.col("current_approval_amount"), F.col("borrower_name")
    l = l.withColumns({"cand": amount >= min_amount, "asked": F.coalesce("_asked", F.lit(False)) & (F.trim(name) != "") & (amount > 0), "band": F.floor(F.log(amount) / -F.log(F.lit(1 - amount_tol))).cast("int")})
    where = F.col("borrower_state") if same_state else F.lit("")
    l = l.where((F.col("cand") | F.col("asked")) & where.isNotNull() & F.col("band").isNotNull() & ~F.isnan(amount))
    l = stored(l.select(where.alias("part"), "band", "loan_number", "borrower_name", "naics_code", _zip5().alias("zip5"), F.col("borrower_state").alias("state"), amount.alias("amount"), "cand", "asked"), "banded")
    if semantic is not word_embedding:
        names = stored(l.select("borrower_name").distinct().withColumn("m", semantic("borrower_name")), "meanings")
        l = l.join(names, "borrower_name")
    groups = l.where("asked").select("part", "band").distinct()
    own = F.col("band") == F.col("_own")
    rows = l.withColumnRenamed("band", "_own").withColumn("band", F.explode(F.when(F.col("cand"), F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    rows = rows.withColumn("asked", F.col("asked") & own).drop("_own").join(groups, ["part", "band"], "left_semi")
    rows = rows.repartition("part", "band").sortWithinPartitions("part", "band", "amount", "loan_number")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, None
        for b in batches:
            part, band = b["part"].to_numpy(object), b["band"].to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (band[1:] != band[:-1])) + 1), len(b)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if (part[i], band[i]) != key:
                    if group:
                        yield from group.ready(True)
                    key, group = (part[i], band[i]), _Nearest(k, amount_tol, max_pool)
                group.add(b.iloc[i:j])
                yield from group.ready(False)
        if group:
            yield from group.ready(True)

    top = rows.mapInPandas(run, "target string, rank int, loan_number string, borrower_name string, semantic_sim double, lexical_sim double, amount_delta_pct double, same_naics boolean, same_state boolean, same_zip5 boolean, _f double")
    if labelled is None:
        top = top.withColumn("is_fraud", F.lit(False))
    else:
        top = top.join(labelled.where(F.col("loan_number").isNotNull()).select("loan_number").distinct().withColumn("_y", F.lit(True)), "loan_number", "left").withColumn("is_fraud", F.coalesce("_y", F.lit(False)))
    return top.select("target", "rank", "loan_number", "borrower_name", rounded("semantic_sim", 4).alias("semantic_sim"), rounded("lexical_sim", 4).alias("lexical_sim"), rounded("amount_delta_pct", 4).alias("amount_delta_pct"), "same_naics", "same_state", "same_zip5", "is_fraud", rounded("_f", 6).alias("fused_score"))


def reasons(loans: DataFrame, targets: DataFrame) -> DataFrame:
    """(loan_number, reason) of targets that can't be compared: loan_not_found, missing_name, missing_amount."""
    l = one_per_loan(loans, "borrower_name", "current_approval_amount").withColumn("_have", F.lit(True))
    why = F.when(F.col("_have").isNull(), "loan_not_found").when(F.trim(F.coalesce("borrower_name", F.lit(""))) == "", "missing_name").when(F.coalesce("current_approval_amount", F.lit(0.0)) <= 0, "missing_amount")
    return targets.select("loan_number").distinct().join(l, "loan_number", "left").select("loan_number", why.alias("reason")).where(F.col("reason").isNotNull())


def homophily(loans: DataFrame, labelled: DataFrame, k: int = 10, **options) -> DataFrame:
    """One row: how much likelier the neighbours of labelled loans are labelled than the population."""
    y = labelled.where(F.col("loan_number").isNotNull()).select("loan_number").distinct()
    near = similar_loans(loans, y, y, k, **options).agg(F.avg(F.col("is_fraud").cast("double")).alias("neighbour_rate"), F.countDistinct("target").alias("n_targets"))
    base = one_per_loan(loans, "current_approval_amount").where(F.col("current_approval_amount") >= options.get("min_amount", 150_000.0)).join(y.withColumn("_y", F.lit(1)), "loan_number", "left").agg(F.avg(F.coalesce("_y", F.lit(0)).cast("double")).alias("base_rate"))
    return near.join(F.broadcast(base)).select("n_targets", rounded("neighbour_rate", 6).alias("neighbour_rate"), rounded("base_rate", 6).alias("base_rate"), rounded(F.when(F.col("base_rate") > 0, F.col("neighbour_rate") / F.col("base_rate")), 4).alias("lift"))  # one row each


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, id, cosine, rank): the k nearest vectors of each query by cosine, exact.

    The queries are the stated set: they go to the executors in blocks of `block` vectors at most, every vector is
    read once a block, each batch keeps its own k best of a query, and only those are shuffled.
    """
    kind = vectors.schema[id].dataType.simpleString()
    asked = stored(with_ranks(queries.select(id, vector).where(F.col(vector).isNotNull() & F.col(id).isNotNull()), [F.col(id)], "_n"), "queries")

    def scan(sent: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for b in batches:
                b = b[b[vector].notna()]
                if not len(b):
                    continue
                v = np.stack(b[vector].to_numpy()).astype(np.float64)
                sims = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                n = min(k + 1, len(b))
                at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                # all that tie with the last one kept go along, so that ties are broken by id later
                edge = np.take_along_axis(sims, at, 1).min(1)
                i, j = np.nonzero(sims >= edge[:, None])
                yield pd.DataFrame({"query": [ids[x] for x in i], id: b[id].to_numpy()[j], "cosine": sims[i, j]})

        return run

    schema = f"query {kind}, {id} {kind}, cosine double"
    part = vectors.sparkSession.createDataFrame([], schema)
    for first in range(0, asked.count(), block):
        rows = asked.where((F.col("_n") > first) & (F.col("_n") <= first + block)).select(id, vector).collect()
        q = np.array([r[1] for r in rows], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        part = part.unionByName(vectors.select(id, vector).mapInPandas(scan(vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], q))), schema))
    part = part.where(F.col("query") != F.col(id)).withColumn("cosine", rounded("cosine", 6))
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), id)
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
