import io
import json

import pytest

from ledgerlens.plans import cli
from ledgerlens.sources import demo, remote, sinks
from ledgerlens.sources.readers import Warehouse
from ledgerlens.sources.schema import TABLES


def opener(answers, log=None):
    def open_(url):
        if log is not None:
            log.append(url)
        got = answers[url].pop(0) if isinstance(answers[url], list) else answers[url]
        if isinstance(got, Exception):
            raise got
        return io.BytesIO(got if isinstance(got, bytes) else json.dumps(got).encode())

    return open_


def test_catalogue_and_downloads(tmp_path):
    files = [{"name": "big b", "url": "http://x/b.CSV"}, {"name": "big a", "url": "http://x/a.csv"}, {"name": "big", "url": "http://x/c.pdf"}, {"name": "small", "url": "http://x/d.csv"}]
    log = []
    o = opener({"http://x/p": {"result": {"resources": files}}, "http://x/a.csv": b"one", "http://x/b.CSV": b"two" * 700_000}, log)
    found = remote.resources("http://x/p", "BIG", o)
    assert [f["name"] for f in found] == ["big a", "big b"]
    with pytest.raises(LookupError):
        remote.resources("http://x/p", "none", o)
    paths = remote.landed(found, str(tmp_path), o)
    assert [open(p, "rb").read()[:3] for p in paths] == [b"one", b"two"]
    n = len(log)
    assert remote.landed(found, str(tmp_path), o) == paths and len(log) == n


def test_pages_end_when_too_old_and_retry(tmp_path):
    new, old = {"title": "n", "date": "200"}, {"title": "o", "date": "5"}
    o = opener({"p0": [OSError("x"), {"results": [new, new]}], "p1": {"results": [new, old]}, "p2": {"results": [old, old]}})
    feed = list(remote.pages("p{}".format, 100, 2, opener=o, wait=0))
    assert [len(p) for p in feed] == [2, 1]
    assert remote.land_pages(iter(feed), str(tmp_path)) == 3 and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(RuntimeError):
        remote.fetched("q", opener({"q": [OSError("x")] * 3}), wait=0)
    assert list(remote.pages("e{}".format, 0, opener=opener({"e0": {}}), wait=0)) == []


def test_demo_warehouse_and_verbs(spark, tmp_path, capsys):
    d = str(tmp_path / "wh")
    assert cli.main(["score", "--warehouse", d], spark) == 1
    assert demo.build_demo(spark, d) == {"loans": 268, "fraud_cases": 15} and demo.build_demo(spark, d) == {"loans": 0, "fraud_cases": 0}
    assert cli.main(["detect", "--warehouse", d], spark) == 0
    assert cli.main(["investigate", "DEMO00001", "--warehouse", d], spark) == 0 and cli.main(["score", "--top", "3", "--warehouse", d], spark) == 0
    out = capsys.readouterr().out
    assert "DEMO00001" in out
    wh = Warehouse(spark, d)
    assert {r[0] for r in wh.read("signals").select("detector_id").distinct().collect()} == {"naics_cohort_outlier", "payroll_cap_exceedance", "multiple_funded_loans"}
    cli.serve(wh, ['{"tool": "loan_profile", "loans": ["DEMO00002"]}', '{"tool": "no"}', "junk"])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert said[0]["rows"][0]["loan_number"] == "DEMO00002" and "error" in said[1] and "error" in said[2]


def test_label_sinks(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path), missing_ok=True)
    rows = [("c1", "1", 0.9, 1), ("c1", "2", 0.5, 2), ("c2", "3", None, 3)]
    df = spark.createDataFrame(rows, "case_id string, loan_number string, match_confidence double, n int")
    assert sinks.replace_labels(wh, df, "n") == 2
    assert {(r["case_id"], r["loan_number"]) for r in wh.read("fraud_cases").collect()} == {("c1", "2"), ("c2", "3")}
    assert sinks.replace_labels(wh, df) == 2 and {(r["case_id"], r["loan_number"]) for r in wh.read("fraud_cases").collect()} == {("c1", "1"), ("c2", "3")}
    more = spark.createDataFrame([("c1", "9"), ("c3", "4")], "case_id string, loan_number string")
    assert sinks.add_labels(wh, more) == 1 and sinks.add_labels(wh, more) == 0 and wh.read("fraud_cases").count() == 3
    assert wh.read("fraud_cases").columns == TABLES["fraud_cases"].names
    # a table may be replaced by what is derived from it
    assert sinks.replace(wh, "fraud_cases", wh.read("fraud_cases").where("case_id <> 'c3'")) == 2 and [p.name for p in tmp_path.iterdir() if p.name.startswith("_")] == []
    with pytest.warns(UserWarning):
        assert Warehouse(spark, str(tmp_path)).read("signals").isEmpty()
