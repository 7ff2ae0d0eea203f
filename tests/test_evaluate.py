import math
from datetime import date
from itertools import islice

import pytest
from test_forecast import windows, yearly
from test_functions import mulberry32

from tidewindow.operators import evaluate as E

ROW = "id string, cut int, year int, nTrain int, ship double, clim double, y int"
ROWS = [("a", 1, 0, 2, 0.2, 0.5, 0), ("a", 2, 0, 3, 0.9, 0.5, 1), ("b", 1, 0, 5, 0.7, 0.25, 0), ("b", 3, 0, 6, 1.0, 0.75, 1), ("c", 3, 0, 4, 0.1, 0.5, 1)]


def rows(spark, data=ROWS):
    return spark.createDataFrame(data, ROW)


def test_scores(spark):
    r = E.scores(rows(spark)).first()
    brier = sum((x[4] - x[6]) ** 2 for x in ROWS) / 5
    ref = sum((x[5] - x[6]) ** 2 for x in ROWS) / 5
    assert r["brier"] == pytest.approx(brier) and r["skill_pct"] == pytest.approx((1 - brier / ref) * 100)
    assert E.scores(rows(spark, [])).first()["n"] == 0
    assert {r["thin"]: r["n"] for r in E.by_thickness(rows(spark)).collect()} == {True: 2, False: 3}
    assert [r["id"] for r in E.worst_misses(rows(spark)).collect()] == ["c", "b"]


def test_calibration(spark):
    got = {r["bin"]: r["n"] for r in E.calibration(rows(spark)).collect()}
    assert got == {"20-30%": 1, "90-100%": 2, "70-80%": 1, "10-20%": 1}
    edge = E.calibration(rows(spark, [("a", 1, 0, 1, 0.3, 0.5, 0), ("a", 2, 0, 1, 0.6, 0.5, 1)])).collect()
    assert {r["bin"] for r in edge} == {"30-40%", "60-70%"}


@pytest.mark.parametrize("by", ["cut", "id"])
def test_bootstrap_is_that_of_the_sequential_generator(spark, by):
    reps = 200
    groups: dict = {}
    for x in sorted(ROWS, key=lambda x: (x[1], x[0])):
        groups.setdefault(x[1] if by == "cut" else x[0], []).append(x)
    gs = list(groups.values())
    stat = lambda sample: sum((x[5] - x[6]) ** 2 - (x[4] - x[6]) ** 2 for g in sample for x in g) / sum(map(len, sample))
    draw = mulberry32(42)
    draws = sorted(stat([gs[int(u * len(gs))] for u in islice(draw, len(gs))]) for _ in range(reps))
    r = E.bootstrap_delta(rows(spark), by=by, reps=reps).first()
    assert r["clusters"] == len(gs) and r["delta"] == pytest.approx(stat(gs))
    assert r["lo"] == pytest.approx(draws[5]) and r["hi"] == pytest.approx(draws[195])
    assert r["pNeg"] == pytest.approx(sum(d <= 0 for d in draws) / reps)


def test_walk_forward(spark):
    w = windows(spark, yearly("Avianca LifeMiles", range(18, 27)) + yearly("Virgin Atlantic", range(20, 26), "05/20", "06/10"))
    cuts = E.month_starts(date(2024, 1, 1), date(2025, 12, 1))
    got = E.eval_rows(w, cuts).collect()
    assert len(cuts) == 24 and got
    by = {(r["id"], r["cut"]): r for r in got}
    assert ("amex-av", 2024 * 12 + 2) not in by, "live at the cutoff"
    assert by["amex-av", 2024 * 12 + 0]["y"] == 1 and by["amex-av", 2024 * 12 + 3]["y"] == 0
    assert by["amex-av", 2024 * 12 + 0]["nTrain"] == 6
    r = E.effective_events(E.eval_rows(w, cuts), w).first()
    assert r["positiveRows"] == sum(x["y"] for x in got) and r["distinctWindows"] == 4
    assert tuple(E.route_sizes(w).first()) == (6, 9, 9)


def test_no_rows(spark):
    w = windows(spark, [])
    assert E.eval_rows(w, E.month_starts(date(2024, 1, 1), date(2024, 2, 1))).count() == 0
    assert tuple(E.effective_events(rows(spark, []), w).first()) == (0, 0, 0.0)
    assert E.bootstrap_delta(rows(spark, []), reps=10).count() <= 1


def test_bootstrap_without_rows_equals_its_sql(spark, tmp_path):
    """0 / 0 draws are no number, and the SQL counts clusters beside the draws, of which there are none."""
    from tidewindow.plans.queries import bootstrap_delta

    r = E.bootstrap_delta(rows(spark, []), reps=10).first()
    assert (r["delta"], r["lo"], r["hi"], r["clusters"]) == (None, None, None, 0) and math.isnan(r["pNeg"])
    tables = {
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        "customer": "c_custkey bigint, c_nationkey bigint, c_mktsegment string",
        "nation": "n_nationkey bigint, n_name string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [tuple(x) for x in bootstrap_delta(spark, str(tmp_path)).collect()]
    assert len(got) == 1 and math.isnan(got[0][3]) and got[0][:3] + got[0][4:] == (None,) * 4
