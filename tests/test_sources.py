import json

import pytest

from ledgerlens.sources import readers, sinks
from ledgerlens.sources.schema import LOANS, raw_header
from ledgerlens.streaming.landing import land_releases


def write_csv(path, rows):
    heads = [raw_header(f.name) for f in LOANS] + ["Extra"]
    with open(path, "w") as f:
        f.write(",".join(heads) + "\n")
        for r in rows:
            f.write(",".join(f'"{r.get(h, "")}"' for h in heads) + "\n")


def test_loans_csv_is_typed_and_idempotent(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [{"LoanNumber": "1", "DateApproved": "05/01/2020", "BorrowerName": "A, Inc", "CurrentApprovalAmount": "769358.78", "JobsReported": "", "Term": "x"}, {"LoanNumber": "2", "DateApproved": "99/99/2020"}, {"BorrowerName": "no number"}])
    wh = readers.Warehouse(spark, str(tmp_path / "wh"))
    df = readers.read_loans_csv(spark, str(tmp_path / "*.csv"))
    assert sinks.insert_new(wh, "loans", df) == 2 and sinks.insert_new(wh, "loans", df) == 0
    got = {r["loan_number"]: r for r in wh.read("loans").collect()}
    assert str(got["1"]["date_approved"]) == "2020-05-01" and got["1"]["current_approval_amount"] == 769358.78 and got["1"]["jobs_reported"] is None and got["1"]["term"] is None and got["1"]["borrower_name"] == "A, Inc"
    assert got["2"]["date_approved"] is None


def test_small_csvs(spark, tmp_path):
    (tmp_path / "z.csv").write_text("ZIP,Naics,EST\n78701,722511,4\n1,2,x\n")
    assert [r["establishments"] for r in readers.read_establishments_csv(spark, str(tmp_path / "z.csv")).collect()] == [4, None]
    (tmp_path / "n.csv").write_text("Code,Description\n 72 , Food \n")
    assert tuple(readers.read_naics_titles_csv(spark, str(tmp_path / "n.csv")).first()) == ("72", "Food")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_naics_titles_csv(spark, str(tmp_path / "b.csv"))


def test_replace_and_missing_tables(spark, tmp_path):
    wh = readers.Warehouse(spark, str(tmp_path))
    assert wh.read("signals").isEmpty()
    s = spark.createDataFrame([("1", "d", 1.0)], "loan_number string, detector_id string, score double")
    assert sinks.replace(wh, "signals", s) == 1
    assert sinks.replace(wh, "signals", wh.read("signals").unionByName(wh.read("signals"))) == 2


def test_one_row_a_loan(loans):
    import datetime as dt

    df = loans([{"loan_number": "1", "loan_status": "B", "loan_status_date": dt.date(2021, 1, 1)}, {"loan_number": "1", "loan_status": "A", "loan_status_date": dt.date(2020, 1, 1)}, {"loan_number": None}])
    assert [r["loan_status"] for r in readers.one_per_loan(df).collect()] == ["A"] and readers.one_per_loan(df, "borrower_name").count() == 1


def test_landing_stream_inserts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rec = {"title": "t", "body": "a ppp loan of $5,000", "date": "1600000000", "url": "u", "topic": []}
    (tmp_path / "in" / "1.json").write_text(json.dumps(rec) + "\n" + json.dumps(rec) + "\n")
    wh = readers.Warehouse(spark, str(tmp_path / "wh"))
    land_releases(spark, str(tmp_path / "in"), wh, str(tmp_path / "cp")).awaitTermination()
    assert wh.read("press_releases").count() == 1
    (tmp_path / "in" / "2.json").write_text(json.dumps(rec) + "\n")
    land_releases(spark, str(tmp_path / "in"), wh, str(tmp_path / "cp")).awaitTermination()
    assert wh.read("press_releases").count() == 1


def test_images(spark, tmp_path):
    for d in ("authentic", "forged"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.JPG").write_bytes(d.encode())
    (tmp_path / "forged" / "x.txt").write_text("no")
    got = readers.read_labelled_images(spark, str(tmp_path))
    assert sorted(r["label"] for r in got.collect()) == [0, 1]
