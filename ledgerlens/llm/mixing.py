"""Problem 9: mixing sources to target shares of all tokens, by soft membership and projected gradients."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import stored
from .ranking import _prefix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Hashed word features of the source classifier, and the sharpness values tried on held-out rows.
FEATURES, SHARPNESS = 4096, (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)


def _features(text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter((xxhash.xxh32_intdigest(w) % FEATURES for w in words), np.int32, len(words))


def train_sources(rows: DataFrame, sources: list[str]) -> np.ndarray:
    """Log shares of hashed words by source, over all labelled rows(source, text, held): those not held out.

    Counts are combined within each batch and then by (source, feature): at most len(sources) * FEATURES numbers
    reach the driver, however many rows there are.
    """
    at = {s: i for i, s in enumerate(sources)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(at), FEATURES))
        for b in batches:
            for s, t in zip(b["source"], b["text"]):
                if isinstance(t, str):
                    total[at[s]] += np.bincount(_features(t), minlength=FEATURES)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"s": i.astype("int32"), "f": j.astype("int32"), "n": total[i, j]})

    got = np.full((len(sources), FEATURES), 0.5)
    for r in rows.where("not held").select("source", "text").mapInPandas(count, "s int, f int, n double").groupBy("s", "f").agg(F.sum("n").alias("n")).collect():
        got[r["s"], r["f"]] += r["n"]
    return np.log(got / got.sum(1, keepdims=True))


def _posterior(mean: np.ndarray, prior: np.ndarray, sharp: float) -> np.ndarray:
    x = sharp * mean * 10 + prior
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def mixing_rates(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, soft_weight: float = 0.1, ridge: float = 0.02, rounds: int = 24, tolerance: float = 1e-4, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens, rate, max_repeats, posterior): how often to use each document of the target sources.

    A classifier of the source (naive Bayes on hashed words, trained on nine tenths of the labelled rows, its
    sharpness chosen on the rest) gives each document posteriors. Projected-gradient least squares fits rates between
    0 and max_repeats so that the token totals by source, and with soft_weight the expected totals by posterior, meet
    the targets; a small ridge holds the rates of a source together. Each round is one aggregation of 2 * sources
    sums; documents replay the few gradients of earlier rounds, so no state is written.

    The total is the largest that max_repeats allows, or total_tokens if smaller. Targets are one row a source.
    Documents of other or null sources, with null ids, or without tokens have no rate. A target source without
    documents can't be met: a warning names it, and the others share the whole in their proportions. ValueError if none
    has documents.
    """
    t = [r for r in targets.where(f"{source} is not null and target_share > 0 and max_repeats > 0").orderBy(source).collect()]  # a row for each source to mix
    names = [r[source] for r in t]
    k = len(names)
    kind = docs.schema[id].dataType.simpleString()
    empty = docs.sparkSession.createDataFrame([], f"`{id}` {kind}, source string, tokens long, rate double, max_repeats int, posterior array<double>")
    if not k:
        return empty
    at = {s: i for i, s in enumerate(names)}
    own = docs.where(F.col(source).isin(names) & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).dropDuplicates(["id"])
    labelled = own.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(10)) == 0)
    logs = train_sources(labelled, names)

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["text"]]
            sizes = [len(e.ids) for i in range(0, len(texts), 64) for e in tok.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
            m = [logs[:, f].mean(1) if len(f := _features(x)) else np.zeros(k) for x in texts]
            yield pd.DataFrame({"id": b["id"], "k": [at[s] for s in b["source"]], "held": b["held"], "tokens": np.array(sizes, np.int64), "mean": m})

    base = stored(labelled.mapInPandas(means, f"id {kind}, k int, held boolean, tokens long, mean array<double>").where("tokens > 0"), "mix")
    have = {r["k"]: (r["n"], r["tokens"]) for r in base.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()}
    tokens = np.array([float(have.get(i, (0, 0))[1]) for i in range(k)])
    there = tokens > 0
    if not there.any():
        raise ValueError("no documents of any target source: nothing can be mixed")
    if not there.all():
        warnings.warn(f"no documents of {[n for n, x in zip(names, there) if not x]}: the other sources share the whole", stacklevel=2)
    prior = np.log([have[i][0] if i in have else 1e-9 for i in range(k)])
    share = np.array([r["target_share"] for r in t], float) * there
    share /= share.sum()
    caps = np.array([r["max_repeats"] for r in t], float)
    total = float(((caps * tokens)[there] / share[there]).min())
    total = min(total, total_tokens) if total_tokens else total
    want = total * share

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(len(SHARPNESS))
        for b in batches:
            if len(b):
                m = np.stack(b["mean"].to_numpy())
                got += [np.log(_posterior(m, prior, s)[np.arange(len(b)), b["k"].to_numpy()] + 1e-12).sum() for s in SHARPNESS]
        yield pd.DataFrame({"i": np.arange(len(SHARPNESS), dtype="int32"), "ll": got})

    best = {r["i"]: r["ll"] for r in base.where("held").mapInPandas(held_out, "i int, ll double").groupBy("i").agg(F.sum("ll").alias("ll")).collect()}
    sharp = SHARPNESS[max(best, key=best.get)] if best else 0.0
    some = np.maximum(tokens, 1.0)  # sources without documents have no rates either
    start, step = want / some, 0.9 * total / (2 * some * (1 + soft_weight))

    def replay(kk: np.ndarray, q: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
        r = start[kk].copy()
        for g in history:
            r -= step[kk] * (g[:k][kk] + soft_weight * q @ g[k:] + ridge * (r - start[kk]))
            np.clip(r, 0, caps[kk], out=r)
        return r

    history: list[np.ndarray] = []
    for _ in range(rounds):

        def totals(batches: Iterator[pd.DataFrame], history=tuple(history)) -> Iterator[pd.DataFrame]:
            got = np.zeros(2 * k)
            for b in batches:
                if len(b):
                    kk, q = b["k"].to_numpy(), _posterior(np.stack(b["mean"].to_numpy()), prior, sharp)
                    w = replay(kk, q, list(history)) * b["tokens"].to_numpy()
                    got[:k] += np.bincount(kk, w, k)
                    got[k:] += w @ q
            yield pd.DataFrame({"i": np.arange(2 * k, dtype="int32"), "a": got})

        a = np.zeros(2 * k)
        for r in base.mapInPandas(totals, "i int, a double").groupBy("i").agg(F.sum("a").alias("a")).collect():
            a[r["i"]] = r["a"]
        gap = (a - np.r_[want, want]) / total
        scale = want / np.maximum(a[:k], 1e-9)
        if np.abs(gap[:k]).max() < tolerance and len(history) > 4:
            break
        history.append(2 * gap)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kk, q = b["k"].to_numpy(), _posterior(np.stack(b["mean"].to_numpy()), prior, sharp) if len(b) else np.zeros((0, k))
            r = np.clip(replay(kk, q, history) * scale[kk], 0, caps[kk])
            yield pd.DataFrame({id: b["id"], "source": np.array(names, object)[kk], "tokens": b["tokens"], "rate": r, "max_repeats": caps[kk].astype("int32"), "posterior": list(q)})

    return base.mapInPandas(rates, f"`{id}` {kind}, source string, tokens long, rate double, max_repeats int, posterior array<double>")


def mix(docs: DataFrame, targets: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """(id, source, tokens, rate, repeats) of every document that is used; repeats is at most its source's max_repeats.

    Rates are made whole by systematic sampling: within a source, in the order of tokens, the fractions are summed up
    and every time the sum passes a whole number the document is used once more. So the tokens of a source differ
    from its target by about one document.
    """
    return _mixed(docs, targets, id, **options).select(id, "source", "tokens", F.round("rate", 6).alias("rate"), "repeats")


def _mixed(docs: DataFrame, targets: DataFrame, id: str, **options) -> DataFrame:
    r = stored(mixing_rates(docs, targets, id=id, **options), "rates")
    most = r.agg(F.max("tokens")).first()[0] or 1
    spread = F.pmod(F.xxhash64(id), F.lit(1 << 20)) / float(1 << 20)
    at = (F.log1p("tokens") / math.log1p(most + 1)) * 0.999 + spread * 1e-6
    part = r.withColumn("at", at).withColumn("_kind", F.lit(0)).withColumn("part", F.col("rate") - F.floor("rate"))
    cum = _prefix(part, ["source"], "at", {"before": F.col("part")}, 512)
    once = F.floor(F.col("before") + F.col("part") + 0.5 + 1e-9) - F.floor(F.col("before") + 0.5 + 1e-9)
    got = cum.withColumn("repeats", F.least((F.floor("rate") + once).cast("int"), F.col("max_repeats")))
    return got.where("repeats > 0").select(id, "source", "tokens", "rate", "repeats", "posterior")


def mix_report(docs: DataFrame, targets: DataFrame, id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, share, expected_share, most_repeats) of the mix of mix().

    share counts tokens by the documents' own source, expected_share by the posteriors of their texts: where the two
    differ, texts under one label read like those of another. Sources without documents have shares of 0 and null.
    """
    names = [r[0] for r in targets.where(f"{source} is not null and target_share > 0 and max_repeats > 0").select(source).orderBy(source).collect()]  # a row for each source to mix
    mixed = stored(_mixed(docs, targets, id, **options).withColumn("used", F.col("tokens") * F.col("repeats")), "mixed")
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("used").alias("tokens"), F.max("repeats").alias("most_repeats"))
    soft = mixed.select("used", F.posexplode("posterior").alias("i", "q")).groupBy(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("source")).agg(F.sum(F.col("used") * F.col("q")).alias("soft")) if names else mixed.select("source", F.lit(0.0).alias("soft")).limit(0)
    total = mixed.agg(F.sum("used").alias("total"))
    t = targets.select(F.col(source).alias("source"), "target_share", "max_repeats").where("source is not null")
    got = t.join(used, "source", "left").join(soft, "source", "left").join(F.broadcast(total))  # one row
    return got.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.round(F.col("soft") / F.col("total"), 6).alias("expected_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
