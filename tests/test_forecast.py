import random
from datetime import date, timedelta

import pytest

from tidewindow.functions.shared import numbered
from tidewindow.operators.forecast import at_dates, derive_history, history_lines, observed_months
from tidewindow.operators.windows import overlap_pairs, resolve_windows, uncovered

NOW = date(2026, 7, 24)
RAW = "ord bigint, bankName string, partnerName string, pct double, startDateRaw string, endDateRaw string"


def windows(spark, rows):
    return resolve_windows(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RAW))


def yearly(partner, years, start="03/01", end="03/31", pct=30.0, bank="Amex"):
    return [(bank, partner, pct, f"{start}/{y}", f"{end}/{y}") for y in years]


def history(spark, rows, now=NOW, **kw):
    return {r["id"]: r for r in derive_history(windows(spark, rows), [now], **kw).collect()}


def test_monthly_probabilities(spark):
    rows = [("Citi ThankYou Rewards", "Avianca LifeMiles", 50.0, "06/14/26", "07/18/26"), ("Citi", "Avianca", 25.0, "06/02/25", "06/02/25")]
    r = history(spark, rows)["citi-av"]
    assert r["mp"] == [0.103] * 5 + [0.555] + [0.111] * 6
    assert r["typical"] == "+25–50%"
    assert tuple(r["ended"]) == (50.0, date(2026, 7, 18))
    lines = history_lines(windows(spark, rows)).first()["hist"]
    assert [tuple(x) for x in lines] == [("JUN 2026", 50.0, "35 days"), ("JUN 2025", 25.0, "1 day")]


@pytest.mark.parametrize(("years", "want"), [(("24", "25", "26"), ("Mar 2027", 60)), (("17", "18"), ("Mar 2027", 2)), (("26",), None)])
def test_next(spark, years, want):
    r = history(spark, yearly("Avianca LifeMiles", years))["amex-av"]
    assert (r["next"] and tuple(r["next"])) == want


def test_single_recent_window_has_no_wait(spark):
    r = history(spark, [("Amex", "Avianca", 20.0, "06/01/26", "06/20/26")])["amex-av"]
    assert r["wait"] is None and r["next"] is None


def test_bad_rows_go(spark):
    rows = [("Amex", "Avianca", 20.0, "02/30/26", "03/01/26"), ("Amex", "Avianca", 20.0, "sometime", "03/01/26"), ("Amex", "Avianca", 20.0, "03/02/26", "03/01/26"), ("Amex", "Avianca", 0.0, "03/01/26", "03/02/26"), ("Amex", "Marriott Bonvoy", 20.0, "03/01/26", "03/02/26"), (None, None, None, None, None)]
    assert history(spark, rows) == {}


@pytest.mark.parametrize(("end", "want"), [("06/01/26", None), ("06/25/26", date(2026, 6, 25)), ("07/24/26", None), ("08/31/26", None)])
def test_recently_ended(spark, end, want):
    r = history(spark, [("Amex", "Avianca", 20.0, "05/01/26", end)])["amex-av"]
    assert (r["ended"] and r["ended"]["endedAt"]) == want


def test_prior_pools_over_the_banks_other_routes(spark):
    thin = yearly("Cathay Pacific", ("24", "25"), "01/05", "01/20")
    busy = yearly("Avianca LifeMiles", range(21, 27), "03/01", "03/28") + yearly("Virgin Atlantic", range(21, 27), "05/01", "05/28")
    alone, pooled = history(spark, thin)["amex-cx"], history(spark, thin + busy)["amex-cx"]
    assert pooled["p2"][8] > alone["p2"][8]
    assert alone["p2"].index(max(alone["p2"])) == pooled["p2"].index(max(pooled["p2"])) == 0
    assert pooled["p2"][0] > 2 * pooled["p2"][8]


def test_wait_never_falls(spark):
    r = history(spark, yearly("Avianca LifeMiles", range(21, 27), "03/01", "03/28", 40.0))["amex-av"]
    assert 0 < r["wait"][0] <= r["wait"][1] <= r["wait"][2] < 0.5
    rows = [("Amex", "Avianca", 20.0, "02/01/16", "02/10/16"), ("Amex", "Avianca", 20.0, "01/01/26", "01/10/26")]
    raw, raised = (history(spark, rows, date(2026, 2, 15), monotone=m)["amex-av"] for m in (False, True))
    assert raw["wait"] == [0.009, 0.008, 0.009] and raised["wait"] == [0.009, 0.009, 0.009] and raised["wait_raised"]


def test_pooled_prior_of_a_ledger_with_repeats(spark):
    """A route without an own stretch: p2 is 5 / (n + 5) of the bank's rate, three places."""
    busy = yearly("Avianca LifeMiles", range(21, 27), "03/01", "03/28", bank="Rove")
    for n in (1, 2, 5, 31):
        r = history(spark, busy + [("Rove", "Qantas", 50.0, "08/15/26", "08/15/26")] * n, date(2026, 8, 15))
        full = history(spark, busy, date(2026, 8, 15))["rove-av"]
        assert len(set(r["rove-qf"]["p2"])) == 1 and r["rove-av"]["mp"] == full["mp"]
        one = history(spark, busy + [("Rove", "Qantas", 50.0, "08/15/26", "08/15/26")], date(2026, 8, 15))["rove-qf"]["p2"][0]
        assert r["rove-qf"]["p2"][0] == pytest.approx(one * 6 / (n + 5), abs=1e-3)


def test_many_dates_agree_with_single_ones(spark):
    rows = yearly("Avianca LifeMiles", range(20, 27)) + yearly("Virgin Atlantic", (22, 24), "05/01", "06/28")
    dates = [date(2024, 1, 1), date(2025, 6, 1), NOW]
    many = {(r["now"], r["id"]): r for r in derive_history(windows(spark, rows), dates, only_ended=True).collect()}
    for d in dates:
        for r in derive_history(windows(spark, rows), [d], only_ended=True).collect():
            assert many[d, r["id"]] == r


def test_observed_months_end_before_now(spark):
    months = observed_months(at_dates(windows(spark, [("Amex", "Avianca", 20.0, "06/10/26", "09/01/26")]), [NOW])).collect()
    assert [(r["m"], r["hit"]) for r in months] == [(2026 * 12 + 5, True)]


def test_overlaps_are_by_day(spark):
    rows = [("Amex", "Avianca", 20.0, "11/07/25", "11/20/25"), ("Amex", "Avianca", 20.0, "11/21/25", "12/05/25"), ("Amex", "Avianca", 20.0, "12/05/25", "12/06/25")]
    got = overlap_pairs(windows(spark, rows)).collect()
    assert [(r["a_start"], r["b_start"]) for r in got] == [(date(2025, 11, 21), date(2025, 12, 5))]
    assert uncovered(windows(spark, rows[:1]), windows(spark, rows[1:])).count() == 1
    assert uncovered(windows(spark, rows[1:2]), windows(spark, rows[2:])).count() == 0


def test_overlaps_of_a_hot_route(spark):
    """Random windows, most of them on one route, against a loop over all pairs."""
    r = random.Random(1)
    kind = "id string, start date, end date, ord bigint"

    def some(n):
        out = []
        for k in range(n):
            start = date(2024, 1, 1) + timedelta(days=r.randrange(900))
            out.append((r.choice(("hot", "hot", "hot", "a", "b")), start, start + timedelta(days=r.choice((0, 1, 5, 30, 31, 95))), k))
        return out

    one, two = some(250), some(60)
    meet = lambda x, y: x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    ordered = sorted(one, key=lambda x: (x[1], x[3]))
    want = sorted((x[0], *x[1:3], *y[1:3]) for k, x in enumerate(ordered) for y in ordered[k + 1 :] if meet(x, y))
    assert sorted(map(tuple, overlap_pairs(spark.createDataFrame(one, kind)).collect())) == want
    left = uncovered(spark.createDataFrame(one + one[:3], kind), spark.createDataFrame(two, kind)).collect()
    assert sorted(map(tuple, left)) == sorted(x for x in one + one[:3] if not any(meet(x, y) for y in two))


def test_numbers_follow_the_order(spark):
    rows = [((k * 37) % 101, str(k)) for k in range(101)]
    got = numbered(spark.createDataFrame(rows, "x int, y string").repartition(7), "x", "n").collect()
    assert sorted((r["n"], r["x"]) for r in got) == [(k, k) for k in range(101)]
    assert numbered(spark.createDataFrame([], "x int"), "x", "n").count() == 0


def test_empty(spark):
    assert history(spark, []) == {}
