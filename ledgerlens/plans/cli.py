"""Command line: python -m ledgerlens.plans.cli VERB --warehouse DIR ..."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import forget, stored
from ..operators import detectors, enrich, graph, investigate, labels, learn, ranking, similar, triage
from ..sources import demo, readers, remote, sinks
from .benchmark import benchmark, full_benchmark, validate_ranking

#: Verbs that need loans, and those of them that need labels too.
NEED_LOANS = {"resolve-labels", "resolve-labels-llm", "detect", "score", "benchmark", "similar", "investigate", "triage", "learn-score", "enrich", "validate", "serve"}
NEED_LABELS = {"benchmark", "learn-score", "validate"}
VERBS = ["info", "demo", "ingest", "ingest-establishments", "ingest-naics", "fetch-labels", "read-labels", *sorted(NEED_LOANS)]


def plugged(name: str) -> Callable:
    """A function named module:function, for judges and providers that come with an outside service."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _targets(spark: SparkSession, numbers: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in numbers], "loan_number string")


def _composite(wh: readers.Warehouse) -> DataFrame:
    return stored(ranking.ranked(ranking.composite(wh.read("signals"), wh.read("loans"))), "ranking")


def _load(a: argparse.Namespace, wh: readers.Warehouse) -> None:
    """The verbs that bring data in."""
    spark = wh.spark
    if a.verb == "info":
        for t in sinks.TABLES:
            print(t, wh.read(t).count())
    elif a.verb == "demo":
        print(json.dumps(demo.build_demo(spark, a.warehouse)))
    elif a.verb == "ingest":
        # a catalogue's address is resolved and its files are kept in the raw folder; anything else is a path or glob
        paths = [p for x in a.path for p in (remote.landed(remote.resources(x, a.slice), a.raw) if x.startswith(("http:", "https:")) else [x])]
        print(sinks.insert_new(wh, "loans", readers.read_loans_csv(spark, paths)))
    elif a.verb == "ingest-establishments":
        print(sinks.insert_new(wh, "establishments", readers.read_establishments_csv(spark, a.path[0])))
    elif a.verb == "ingest-naics":
        print(sinks.insert_new(wh, "naics_titles", readers.read_naics_titles_csv(spark, a.path[0])))
    elif a.verb == "fetch-labels":
        print(remote.land_pages(remote.pages(lambda n: a.path[0].format(page=n), a.since, most=a.pages), a.raw))
    elif a.verb == "read-labels":
        print(sinks.insert_new(wh, "press_releases", labels.parse_releases(readers.read_raw_releases(spark, a.raw))))


def _judge(a: argparse.Namespace, wh: readers.Warehouse) -> None:
    """The verbs that label, rank and look closer."""
    spark, loans = wh.spark, wh.read("loans")
    if a.verb == "resolve-labels":
        print(sinks.replace_labels(wh, labels.resolve_exact(wh.read("press_releases"), loans, a.threshold)))
    elif a.verb == "resolve-labels-llm":
        c = labels.amount_candidates(wh.read("press_releases"), loans, wh.read("fraud_cases"))
        print(sinks.add_labels(wh, labels.adjudicate(c, wh.read("press_releases"), plugged(a.judge), a.threshold)))
    elif a.verb == "detect":
        print(sinks.replace(wh, "signals", detectors.run_detectors(wh.read, list(detectors.REGISTRY) if a.all_detectors else None)))
    elif a.verb == "score":
        ranking.ranked(ranking.composite(wh.read("signals"), loans), head=a.top).show(a.top, truncate=False)
    elif a.verb == "benchmark" and a.full:
        print(json.dumps(full_benchmark(wh.read("signals"), loans, wh.read("fraud_cases"), min_amount=None if a.full_population else 150_000.0), indent=1))
    elif a.verb == "benchmark":
        benchmark(wh.read("signals"), loans, wh.read("fraud_cases"), min_amount=None if a.full_population else 150_000.0).orderBy("ranking", "k").show(500, truncate=False)
    elif a.verb == "validate":
        r = ranking.ranked(ranking.clean_signals(wh.read("signals")).where(F.col("detector_id") == a.path[0]).groupBy("loan_number").agg(F.max("score").alias("score")), "score")
        validate_ranking(r, wh.read("signals"), loans, wh.read("fraud_cases"), a.year).orderBy("ranking", "k").show(100, truncate=False)
    elif a.verb == "similar":
        near = similar.similar_loans(loans, _targets(spark, a.path), wh.read("fraud_cases"), a.top)
        near.orderBy("target", "rank").show(a.top * len(a.path), truncate=False)
        investigate.neighbour_summary(near).show(len(a.path), truncate=False)
    elif a.verb == "investigate":
        for r in investigate.investigate(loans, wh.read("signals"), wh.read("fraud_cases"), _targets(spark, a.path), a.top).orderBy("loan_number").toJSON().collect():  # one row a number asked for
            print(r)
    elif a.verb == "triage":
        got, counts = triage.triage(wh.read("signals"), loans, plugged(a.judge), a.top)
        got.orderBy("triage_rank").show(a.top, truncate=False)
        print(json.dumps(counts))
        if a.gate:
            full = _composite(wh)
            triage.gate(full, triage.ranks_after(full, got), ranking.positives(wh.read("fraud_cases")), wh.loans("current_approval_amount").count()).orderBy("k").show()
    elif a.verb == "learn-score":
        if a.model == "pu-bagging":
            learn.holdout_comparison(loans, wh.read("signals"), wh.read("fraud_cases"), a.year).orderBy("ranking", "k").show(100, truncate=False)
        else:
            rows, counts = learn.nested_validation(loans, wh.read("signals"), wh.read("fraud_cases"), a.year, graph=graph.graph_features(loans))
            rows.orderBy("ranking", "k").show(100, truncate=False)
            print(json.dumps(counts))
    elif a.verb == "enrich":
        got, counts = enrich.enriched(_composite(wh), enrich.kept(plugged(a.judge), a.raw), top=a.top)
        for r in got.collect():  # at most enrich.MOST rows
            print(enrich.dossier(r.asDict()) + "\n")
        print(json.dumps(counts))
    elif a.verb == "serve":
        serve(wh, sys.stdin)


def serve(wh: readers.Warehouse, requests: Iterable[str]) -> None:
    """Answers requests, one JSON object {"tool", "loans"} a line, with one JSON object a line; tools only read."""
    loans, signals, cases = wh.read("loans"), wh.read("signals"), wh.read("fraud_cases")
    tools = {
        "loan_profile": lambda t: investigate.loan_profile(loans, t), "loan_signals": lambda t: investigate.loan_signals(signals, t),
        "similar_loans": lambda t: similar.similar_loans(loans, t, cases, 10).orderBy("target", "rank"), "investigate": lambda t: investigate.investigate(loans, signals, cases, t),
    }
    for line in requests:
        try:
            asked = json.loads(line)
            rows = [json.loads(x) for x in tools[asked["tool"]](_targets(wh.spark, list(asked["loans"]))).toJSON().collect()]  # of the loans asked for
            print(json.dumps({"rows": rows}), flush=True)
        except (KeyError, TypeError, ValueError) as e:
            print(json.dumps({"error": f"{type(e).__name__}: {e}", "tools": sorted(tools)}), flush=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerlens")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("path", nargs="*")
    p.add_argument("--warehouse", required=True)
    p.add_argument("--raw", default="raw", help="folder of landed files and kept answers")
    p.add_argument("--slice", default="", help="part of the names of a catalogue's files")
    p.add_argument("--since", type=int, default=1_577_836_800, help="epoch seconds from which on releases are fetched")
    p.add_argument("--pages", type=int, default=400)
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--year", type=int, default=2023)
    p.add_argument("--threshold", type=float, default=0.6)
    p.add_argument("--judge", default="", help="module:function of a judge or provider")
    p.add_argument("--model", choices=["pu-bagging", "boosted"], default="pu-bagging")
    for flag in ("--all-detectors", "--gate", "--full", "--full-population"):
        p.add_argument(flag, action="store_true")
    a = p.parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("ledgerlens").getOrCreate()
    wh = readers.Warehouse(spark, a.warehouse, missing_ok=True)
    try:
        if a.verb in NEED_LOANS and wh.read("loans").isEmpty():
            print("no loans in the warehouse", file=sys.stderr)
            return 1
        if a.verb in NEED_LABELS and ranking.positives(wh.read("fraud_cases")).isEmpty():
            print("no labels in the warehouse", file=sys.stderr)
            return 1
        (_judge if a.verb in NEED_LOANS else _load)(a, wh)
    finally:
        if own:
            forget(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
