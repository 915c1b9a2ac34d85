"""Learned scorers from positives and unlabelled loans, with the models of Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ordered import with_ranks
from ..functions.store import stored
from ..sources.readers import one_per_loan
from .features import rich_features, thin_features
from .ranking import bootstrap_intervals, composite, fuse, metrics_at, ranked, temporal_split

DEPTHS = ({"maxDepth": 4, "maxIter": 40}, {"maxDepth": 5, "maxIter": 60}, {"maxDepth": 3, "maxIter": 80})


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash: the same in every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def assemble(df: DataFrame) -> DataFrame:
    """(loan_number, features): numbers as they are, text categories as indices by frequency."""
    cats = [c for c, t in df.dtypes if t == "string" and c != "loan_number"]
    nums = [c for c, t in df.dtypes if t in ("double", "int", "bigint")]
    stages = [StringIndexer(inputCols=cats, outputCols=[f"{c}_i" for c in cats], handleInvalid="keep")] if cats else []
    stages.append(VectorAssembler(inputCols=[*nums, *[f"{c}_i" for c in cats]], outputCol="features"))
    return Pipeline(stages=stages).fit(df).transform(df).select("loan_number", "features")


def _positive(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("loan_number", vector_to_array("probability")[1].alias("score"))


def pu_bagging(features: DataFrame, train: DataFrame, bags: int = 50, depth: int = 8, least: int = 5, seed: int = 42) -> DataFrame:
    """(loan_number, score): mean out-of-bag score of trees that each see all positives and as many unlabelled loans.

    Unlabelled loans are drawn with replacement, a Poisson number of times by a hash, so bags are reproducible; both
    kinds weigh the same in a bag. A loan that was in every bag gets the mean of all its trees.
    """
    y = train.select("loan_number").distinct().withColumn("label", F.lit(1.0))
    df = stored(features.join(y, "loan_number", "left").fillna(0.0, ["label"]), "bagging")
    n_pos, n = df.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not n_pos or n_pos == n:
        raise ValueError("needs loans of either kind")
    rate = min(1.0, n_pos / (n - n_pos))
    borders = [math.exp(-rate) * sum(rate**i / math.factorial(i) for i in range(j + 1)) for j in range(6)]

    def times(b: int) -> Column:
        u = _uniform(F.col("loan_number"), F.lit(b), F.lit(seed))
        return F.when(F.col("label") == 1, 1.0).otherwise(sum((F.when(u >= x, 1.0).otherwise(0.0) for x in borders), F.lit(0.0)))

    others = df.where("label = 0").agg(*[F.sum(times(b)) for b in range(bags)]).first()
    scores = None
    for b in range(bags):
        if not others[b]:
            continue
        drawn = df.withColumn("times", times(b))
        bag = drawn.where("times > 0").withColumn("w", F.when(F.col("label") == 1, others[b] / n_pos).otherwise(F.col("times")))
        model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, maxBins=64, seed=seed, weightCol="w").fit(bag)
        one = model.transform(drawn).select("loan_number", vector_to_array("probability")[1].alias("p"), (F.col("times") > 0).alias("used"))
        scores = one if scores is None else scores.unionByName(one)
    if scores is None:
        raise ValueError("no bag holds loans of either kind")
    per = scores.groupBy("loan_number").agg(F.avg(F.when(~F.col("used"), F.col("p"))).alias("out"), F.avg("p").alias("all"))
    return per.select("loan_number", F.coalesce("out", "all").alias("score"))


def boosted(features: DataFrame, train: DataFrame, unlabelled_per_positive: int = 30, seed: int = 42, **params) -> DataFrame:
    """(loan_number, score) of gradient-boosted trees on all positives against a hashed share of the rest, weighted to balance."""
    y = train.select("loan_number").distinct().withColumn("label", F.lit(1.0))
    df = stored(features.join(y, "loan_number", "left").fillna(0.0, ["label"]), "boosted")
    n_pos, n = df.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not n_pos or n_pos == n:
        raise ValueError("needs loans of either kind")
    share = min(1.0, unlabelled_per_positive * n_pos / (n - n_pos))
    fit = df.where((F.col("label") == 1) | (_uniform(F.col("loan_number"), F.lit(seed)) < share)).withColumn("w", F.when(F.col("label") == 1, (n - n_pos) * share / n_pos).otherwise(1.0))
    return _positive(GBTClassifier(weightCol="w", maxBins=128, seed=seed, **({"maxDepth": 4, "maxIter": 30} | params)).fit(fit), df)


def entity_groups(loans: DataFrame) -> DataFrame:
    """(loan_number, group): the entity of each loan, itself where that can't be told."""
    return one_per_loan(loans, "borrower_name", "borrower_address", "borrower_city", "borrower_state", "borrower_zip").select("loan_number", F.coalesce(text.entity_key(), F.concat(F.lit("__loan__"), "loan_number")).alias("group"))


def tune(features: DataFrame, train: DataFrame, groups: DataFrame, folds: int = 3, options: tuple[dict, ...] = DEPTHS) -> dict:
    """The options with the best mean AUC over folds that keep entities together; the first ones if none can be judged."""
    y = train.select("loan_number").distinct().withColumn("label", F.lit(1.0))
    df = stored(features.join(groups, "loan_number").join(y, "loan_number", "left").fillna(0.0, ["label"]).withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(folds))), "tuning")
    judge, best = BinaryClassificationEvaluator(rawPredictionCol="score"), (-1.0, options[0])
    for o in options:
        got = []
        for f in range(folds):
            tr, te = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
            try:
                s = boosted(tr.select("loan_number", "features").unionByName(te.select("loan_number", "features")), tr.where("label = 1").select("loan_number"), **o)
                got.append(judge.evaluate(s.join(te.select("loan_number", "label"), "loan_number")))
            except ValueError:
                continue
        if got and sum(got) / len(got) > best[0]:
            best = (sum(got) / len(got), o)
    return best[1]


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline written to a folder, in place of what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def nested_validation(loans: DataFrame, signals: DataFrame, cases: DataFrame, year: int = 2023, ks: tuple[int, ...] = (100, 1000, 2000, 5000), min_amount: float = 150_000.0, graph: DataFrame | None = None, n_boot: int = 2000, folds: int = 3, options: tuple[dict, ...] = DEPTHS) -> tuple[DataFrame, dict]:
    """(rows, summary): the boosted scorer, tuned on earlier charges only, against the composite on later ones.

    Options are chosen by folds inside the training part that keep entities together; the test part is looked at once.
    rows are those of holdout_comparison with the bootstrap interval of the hits (hits_low, hits_high) and the verdict:
    improved, regressed or neutral by the sum of hits of the learned ranking over all k. summary: counts and options.
    """
    split = stored(temporal_split(cases, year), "split")
    train = split.where("part = 'train'")
    feats = stored(assemble(rich_features(loans, signals, graph, min_amount)), "features")
    known = stored(train.join(feats, "loan_number", "left_semi"), "known")
    best = tune(feats, known, entity_groups(loans), folds, options)
    rankings, test, population = _holdout(loans, signals, split, feats, boosted(feats, known, **best), "boosted")
    at = tuple(k for k in ks if k <= population) or (population,)
    out = None
    for name, r in rankings.items():
        m = metrics_at(r, test, population, at).join(bootstrap_intervals(r, test, population, at, n_boot).select("k", "hits_low", "hits_high"), "k").withColumn("ranking", F.lit(name))
        out = m if out is None else out.unionByName(m)
    out = stored(out, "nested")
    hits = {r["ranking"]: r["h"] for r in out.groupBy("ranking").agg(F.sum("hits").alias("h")).collect()}  # three rows
    change = hits["boosted"] - hits["composite"]
    verdict = "improved" if change > 0 else "regressed" if change < 0 else "neutral"
    counts = {"n_train": known.count(), "n_test": test.count(), "population": population, "options": best, "verdict": verdict}
    return out.withColumn("verdict", F.lit(verdict)).select("ranking", "k", "hits", "hits_low", "hits_high", "precision", "lift", "recall", "verdict"), counts


def _holdout(loans: DataFrame, signals: DataFrame, split: DataFrame, feats: DataFrame, score: DataFrame, model: str) -> tuple[dict[str, DataFrame], DataFrame, int]:
    """(rankings, test positives, population) without the training positives: the model, the composite, both fused."""
    rest = stored(feats.select("loan_number").join(split.where("part = 'train'"), "loan_number", "left_anti"), "rest")
    test = stored(split.where("part = 'test'").join(rest, "loan_number", "left_semi"), "test")
    learned = with_ranks(score.join(rest, "loan_number", "left_semi"), [F.col("score").desc(), F.col("loan_number")])
    comp = ranked(composite(signals, loans).join(rest, "loan_number", "left_semi"))
    # loans without a signal follow in the order of their numbers
    full = with_ranks(rest.join(comp.select("loan_number", "rank"), "loan_number", "left").withColumn("_r", F.coalesce("rank", F.lit(1 << 30))).drop("rank"), [F.col("_r"), F.col("loan_number")])
    learned, full = stored(learned.select("loan_number", "rank"), "ranking"), stored(full.select("loan_number", "rank"), "ranking")
    fused = stored(fuse([learned, full]).select("loan_number", "rank"), "ranking")
    return {model: learned, "composite": full, "fused": fused}, test, rest.count()


def holdout_comparison(loans: DataFrame, signals: DataFrame, cases: DataFrame, year: int = 2023, model: str = "pu-bagging", ks: tuple[int, ...] = (100, 1000, 5000), min_amount: float = 150_000.0, graph: DataFrame | None = None) -> DataFrame:
    """(ranking, k, hits, precision, lift, recall): a model trained on earlier charges against the composite, on later ones.

    Training positives are taken out of both rankings and of the population.
    """
    split = stored(temporal_split(cases, year), "split")
    f = thin_features(loans, signals, min_amount) if model == "pu-bagging" else rich_features(loans, signals, graph, min_amount)
    feats = stored(assemble(f), "features")
    known = split.where("part = 'train'").join(feats, "loan_number", "left_semi")
    score = pu_bagging(feats, known) if model == "pu-bagging" else boosted(feats, known)
    rankings, test, population = _holdout(loans, signals, split, feats, score, model)
    out = None
    for name, r in rankings.items():
        m = metrics_at(r, test, population, tuple(k for k in ks if k <= population) or (population,)).withColumn("ranking", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("ranking", "k", "hits", "precision", "lift", "recall")
