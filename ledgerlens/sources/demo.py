"""A small warehouse of invented loans, so that everything can be tried without data."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import SparkSession

from .readers import Warehouse
from .schema import LOANS, TABLES
from .sinks import insert_new

#: Industries and states of the cohorts: plain loans and far too well paid ones in each.
COHORTS = (("722511", "TX"), ("236115", "FL"), ("561720", "CA"), ("484110", "GA"), ("621210", "NY"))
PLAIN, EXTREME, RING, REPEATED = 46, 5, 6, 7


def demo_loans(seed: int = 42) -> tuple[list[dict], list[dict]]:
    """(loans, cases): cohorts with outliers, a ring of names at one building, and one borrower with many loans."""
    rng = random.Random(seed)
    loans: list[dict] = []
    cases: list[dict] = []

    def add(name: str, naics: str, state: str, amount: float, jobs: float, address: str, city: str, zip_: str, method: str = "PPP", known: bool = False) -> None:
        n = f"DEMO{len(loans) + 1:05d}"
        day = dt.date(2020, 4, 3) + dt.timedelta(days=rng.randrange(300))
        loans.append({"loan_number": n, "borrower_name": name, "borrower_address": address, "borrower_city": city, "borrower_state": state, "borrower_zip": zip_, "naics_code": naics, "current_approval_amount": round(amount, 2), "initial_approval_amount": round(amount, 2), "jobs_reported": jobs, "processing_method": method, "date_approved": day, "originating_lender": rng.choice(("First Demo Bank", "Second Demo Bank", "Third Demo Bank")), "business_type": "Corporation", "term": 24})
        if known:
            cases.append({"case_id": f"demo-{n}", "loan_number": n, "business_name": name, "alleged_amount": round(amount, 2), "charge_date": dt.date(2021 + len(cases) % 4, 6, 1), "source": "demo", "source_url": f"https://demo.example/{n}", "match_method": "name+state+amount", "match_confidence": 0.95})

    for c, (naics, state) in enumerate(COHORTS):
        for i in range(PLAIN + EXTREME):
            out = i >= PLAIN
            jobs = float(rng.randint(4, 9) if out else rng.randint(18, 60))
            add(f"Demo {state} {naics} Number {i + 1} LLC", naics, state, jobs * (rng.uniform(45_000, 90_000) if out else rng.uniform(8_500, 11_500)), jobs, f"{100 + 7 * i} Demo Street {c + 1}", "Demoville", f"7{c}0{i:02d}", known=out and i < PLAIN + 2)
    for i in range(RING):
        add(f"Ring Holdings {'ABCDEF'[i]} Inc", "531110", "NV", 160_000.0 + 250 * i, 11.0, f"1 Ring Plaza Suite {i + 1}", "Ringtown", "89001", known=i < 3)
    for i in range(REPEATED):
        add("Repeat Demo Services LLC", "541611", "IL", 155_000.0 + 1000 * i, 12.0, "9 Repeat Road", "Repeatburg", "60601", known=i < 2)
    return loans, cases


def build_demo(spark: SparkSession, folder: str, seed: int = 42) -> dict[str, int]:
    """Writes the demo warehouse; a folder that has loans already is left as it is. Rows added by table."""
    wh = Warehouse(spark, folder, missing_ok=True)
    if not wh.read("loans").isEmpty():
        return {"loans": 0, "fraud_cases": 0}
    loans, cases = demo_loans(seed)
    made = {"loans": spark.createDataFrame([tuple(r.get(f.name) for f in LOANS) for r in loans], LOANS), "fraud_cases": spark.createDataFrame([tuple(r.get(f.name) for f in TABLES["fraud_cases"]) for r in cases], TABLES["fraud_cases"])}
    return {t: insert_new(wh, t, df) for t, df in made.items()}
