"""The ledger as a versioned table, and the guards."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewindow.operators import guards
from tidewindow.operators.ledger import ENTRY, update_ledger
from tidewindow.plans import ledger_table as T
from tidewindow.plans import versions as V

DAY = date(2026, 8, 1)
ACTIVE = "id string, bank string, code string, pct double, endDate date, pos bigint"


def entries(spark, n):
    return spark.createDataFrame([(k, f"b-{k}", "B", str(k), float(k), DAY, DAY, None, (0.5, None, None, DAY) if k % 2 else None) for k in range(n)], ENTRY)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_versions_rewrite_what_changed(spark, tmp_path):
    path = str(tmp_path / "ledger")
    usable, none = T.read_entries(spark, path)
    assert usable and none.count() == 0 and none.columns == entries(spark, 1).columns
    first = T.write_entries(entries(spark, 200), path)
    assert len(first) > 40 and sorted(map(tuple, T.read_entries(spark, path)[1].collect())) == sorted(map(tuple, entries(spark, 200).collect()))
    assert T.write_entries(T.read_entries(spark, path)[1], path) == [] and V.manifest(path)["version"] == 1
    before, held = files(path), T.read_entries(spark, path)[1]
    active = spark.createDataFrame([("b-7", "B", "7", 99.0, None, 0), ("new", "N", "1", 5.0, None, 1)], ACTIVE)
    stepped = update_ledger(held, active, date(2026, 8, 3))
    want = sorted(map(tuple, stepped.collect()))
    changed = T.write_entries(stepped, path)
    assert 1 <= len(changed) <= 2 and V.manifest(path)["version"] == 2
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) == len(changed)
    assert sorted(map(tuple, T.read_entries(spark, path)[1].collect())) == want and held.count() == 200  # a reader of the old version still has it
    # entries that go take their bucket along
    emptied = T.write_entries(T.read_entries(spark, path)[1].filter("id = 'new'"), path)
    assert len(emptied) >= 39 and [r["id"] for r in T.read_entries(spark, path)[1].collect()] == ["new"]
    assert V.prune(path) and len(files(path)) == 1 and T.read_entries(spark, path)[1].count() == 1


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    T.write_entries(entries(spark, 5), path)
    before = (tmp_path / "ledger" / V.MANIFEST).read_bytes()
    monkeypatch.setattr(V.json, "dumps", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        T.write_entries(entries(spark, 9), path)
    monkeypatch.undo()
    assert (tmp_path / "ledger" / V.MANIFEST).read_bytes() == before and T.read_entries(spark, path)[1].count() == 5
    for broken in ("{", '{"version": 1}', "[]", "null"):
        (tmp_path / "ledger" / V.MANIFEST).write_text(broken)
        assert not T.read_entries(spark, path)[0]
        with pytest.raises(ValueError, match="manifest"):
            T.write_entries(entries(spark, 9), path)
        assert (tmp_path / "ledger" / V.MANIFEST).read_text() == broken
    (tmp_path / "ledger" / V.MANIFEST).write_bytes(before)
    assert json.loads(before)["version"] == 1 and T.read_entries(spark, path)[1].count() == 5


def test_guards(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",), ("x",)], "source string")
    report = guards.source_report(rows, ["a", "b", "c", "d"])
    assert {tuple(r) for r in report.collect()} == {("a", 3, False), ("b", 1, False), ("c", 0, True), ("d", 0, True)}
    none = guards.source_report(rows.limit(0), ["a"])
    some = lambda n: spark.range(n).filter(F.lit(True))
    for rep, had, now, failed, fell in ((report, 4, 2, False, False), (report, 4, 1, False, True), (report, 3, 0, False, False), (none, 0, 5, True, False)):
        r = guards.verdict(rep, some(had), some(now)).first()
        assert (r["too_many_failed"], r["fell"], r["ok"]) == (failed, fell, not failed and not fell)
    assert guards.verdict(guards.source_report(rows, ["a", "c", "d"]), some(0), some(0)).first()["too_many_failed"]
