"""Facts of an outside registry for the head of a ranking: a bounded number of look-ups, kept, and joined back."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name

MOST = 50
#: A look-up: name and state of a borrower in, facts of the company or None out.
Provider = Callable[[str, str | None], dict[str, Any] | None]


class QuotaReached(Exception):
    """Raised by a provider that will answer no more."""


def from_table(facts: list[dict[str, Any]]) -> Provider:
    """A provider of fixed facts: each has a name, and a state where it counts for that state only."""

    def words(name: str | None) -> str:
        return " ".join("".join(c if c.isalnum() else " " for c in (name or "").upper()).split())

    table = {(words(f["name"]), f.get("state")): f for f in facts}
    return lambda name, state: table.get((words(name), state)) or table.get((words(name), None))


def kept(provider: Provider, folder: str) -> Provider:
    """The same provider, which keeps each answer in a JSON file of the folder; files that can't be read are asked for anew."""
    os.makedirs(folder, exist_ok=True)

    def ask(name: str, state: str | None) -> dict[str, Any] | None:
        path = os.path.join(folder, hashlib.sha256(f"{name}|{state or ''}".encode()).hexdigest()[:32] + ".json")
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)["facts"]
        except (OSError, ValueError, KeyError, TypeError):
            facts = provider(name, state)
            aside = f"{path}.{os.getpid()}"
            with open(aside, "w", encoding="utf-8") as f:
                json.dump({"name": name, "state": state, "facts": facts}, f)
            os.replace(aside, path)
            return facts

    return ask


def enriched(ranking: DataFrame, provider: Provider, adjust: Callable[[dict[str, Any] | None], float] = lambda facts: 0.0, top: int = MOST) -> tuple[DataFrame, dict[str, int]]:
    """(the first loans of a ranking with facts, as JSON, and refined_score; counts).

    At most MOST loans are looked up, on the driver, one after another: a registry's quota is the bound. A look-up that
    fails leaves its loan without facts; QuotaReached ends all further ones. refined_score is composite_score plus what
    adjust makes of the facts (nothing by default), and the order of the result.
    """
    head = ranking.orderBy("rank").limit(max(0, min(top, MOST)))
    rows = [(r["loan_number"], r["borrower_name"], r["state"]) for r in head.select("loan_number", "borrower_name", "state").collect()]  # at most MOST
    counts = {"asked": 0, "found": 0, "failed": 0, "left": 0}
    facts: list[tuple[str, str | None, float]] = []
    stopped = False
    for number, name, state in rows:
        got = None
        if stopped or not (name or "").strip():
            counts["left"] += 1
        else:
            counts["asked"] += 1
            try:
                got = provider(name, state)
                counts["found"] += got is not None
            except QuotaReached:
                stopped = True
                counts["asked"] -= 1
                counts["left"] += 1
            except Exception:  # noqa: BLE001
                counts["failed"] += 1
        facts.append((number, None if got is None else json.dumps(got, sort_keys=True, default=str), float(adjust(got))))
    table = ranking.sparkSession.createDataFrame(facts, "loan_number string, facts string, adjusted double")
    return head.join(F.broadcast(table), "loan_number").withColumn("refined_score", F.col("composite_score") + F.col("adjusted")).orderBy(F.col("refined_score").desc(), "rank"), counts


def dossier(row: dict[str, Any]) -> str:
    """A few lines of text on one loan of enriched()."""
    facts = json.loads(row["facts"]) if row.get("facts") else None
    lines = [f"{row.get('borrower_name') or 'Unnamed borrower'} ({row['loan_number']}), {row.get('state') or 'state unknown'}", f"Rank {row['rank']}, score {row['refined_score']:.4f}"]
    lines += [f"{k}: {v}" for k, v in sorted(facts.items())] if facts else ["No facts found."]
    return "\n".join([*lines, "A statistical lead for review, never proof."])


def name_agrees(a: str, b: str):
    """Column: whether two name columns are the same name, legal forms and punctuation aside."""
    return (norm_name(a) == norm_name(b)) & (norm_name(a) != "")
