"""Seasonality and forecasts of routes, for any number of dates in one plan.

A window counts from the first date after its end, a month from the first date on which it
is past and known to have had a window or not; neither is taken back later. So a month is
put down once, at the date from which it counts, and the masses at all dates are running
sums over dates: a route has a row a month and a row a date, never one for each pair of
them. The weight of a month at a date halves with the years between; it is a factor of the
month, summed, times a factor of the date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.arrays import made_once
from tidewindow.functions.dates import length_label, month_index, month_label, window_label
from tidewindow.functions.numbers import plain, round3

# Shrinkage, years in which a weight halves, pooling, horizons, cap, recency.
TAU, HALF_LIFE, POOL, HORIZONS, MOST, RECENT_DAYS = 2.0, 3.0, 5.0, (1, 3, 6), 0.95, 30
#: The year from which the factors of months and dates count, so that neither leaves the range of doubles.
BASE_YEAR = 2000


def year_weight(now_month: Column, month: Column) -> Column:
    """Half for every HALF_LIFE calendar years that a month lies back."""
    return F.pow(F.lit(0.5), (F.floor(now_month / 12) - F.floor(month / 12)) / HALF_LIFE)


def at_dates(windows: DataFrame, nows: list[date], *, only_ended: bool = False) -> DataFrame:
    """``windows`` once for each date, with ``now`` and its month ``t``; with ``only_ended`` only what had ended by then."""
    dates = F.array(*(F.lit(d) for d in nows))
    if only_ended:
        dates = F.filter(dates, lambda d: d > F.col("end"))
    return windows.withColumn("now", F.explode(dates)).withColumn("t", month_index(F.col("now")))


def observed_months(dated: DataFrame) -> DataFrame:
    """``now, id, m, w, hit``: each month from a route's first window to the one before ``now``."""
    firsts = dated.groupBy("now", "id", "t").agg(F.min("s").alias("first")).filter("first < t")
    grid = firsts.select("now", "id", "t", F.explode(F.sequence("first", F.col("t") - 1)).alias("m"))
    hits = dated.filter("s < t").select("now", "id", F.explode(F.sequence("s", F.least("e", F.col("t") - 1))).alias("m")).distinct().withColumn("hit", F.lit(True))
    return grid.join(hits, ["now", "id", "m"], "left").select("now", "id", "m", year_weight(F.col("t"), F.col("m")).alias("w"), F.coalesce("hit", F.lit(False)).alias("hit"))


class Dates:
    """The dates of a forecast in order, as SQL over their numbers from 0."""

    def __init__(self, nows: list[date]):
        self.nows = sorted(set(nows))
        self.t = [d.year * 12 + d.month - 1 for d in self.nows]
        epoch = date(1970, 1, 1)
        self.days = f"array({', '.join(str((d - epoch).days) for d in self.nows)})"

    def after(self, day: str) -> str:
        """The number of the first date after a day (days since 1970); as many as there are dates if none is."""
        return f"size(filter({self.days}, d -> d <= {day}))"

    def next_of_month(self, cal: str, j: str) -> str:
        """The number of the first date from ``j`` on whose next month is calendar month ``cal``; null if none is."""
        rows = []
        for c in range(12):
            found, row = None, []
            for k in reversed(range(len(self.t))):
                found = k if (self.t[k] + 1) % 12 == c else found
                row.append("NULL" if found is None else str(found))
            rows.append(f"array({', '.join([*reversed(row), 'NULL'])})")
        return f"CAST(array({', '.join(rows)})[{cal}][{j}] AS INT)"


def known_months(windows: DataFrame, last: int, known: str) -> DataFrame:
    """``id, m, opened, known1, known2, known3, known6`` of each month from a route's first window to the one before ``last``.

    ``known``: SQL for the day from whose morrow on a window is known. ``opened``: that day of
    the first known window that starts up to this month; ``knownH``: of a window in one of the
    H months from it.
    """
    rows = windows.filter(F.col("s") < last).selectExpr("id", "s", f"least(e, {last - 1}) AS e", f"{known} AS known")
    none = "CAST(NULL AS INT)"
    touched = rows.selectExpr("id", "explode(sequence(s, e)) AS m", "known", f"{none} AS opened")
    opening = rows.selectExpr("id", "s AS m", f"{none} AS known", "known AS opened")
    every = rows.groupBy("id").agg(F.min("s").alias("s")).selectExpr("id", f"explode(sequence(s, {last - 1})) AS m", f"{none} AS known", f"{none} AS opened")
    months = touched.unionByName(opening).unionByName(every).groupBy("id", "m").agg(F.min("known").alias("known"), F.min("opened").alias("opened"))
    order = Window.partitionBy("id").orderBy("m")
    ahead = {f"known{h}": F.min("known").over(order.rowsBetween(0, h - 1)) for h in (1, 2, 3, 6)}
    return months.select("id", "m", F.min("opened").over(order).alias("opened"), *(c.alias(n) for n, c in ahead.items()))


def masses(windows: DataFrame, nows: list[date], *, only_ended: bool = False) -> DataFrame:
    """One row per (now, id): counts and ends, and the weighted masses that probabilities are made of.

    ``cal1``/``cal2``: struct(k, n) for each calendar month and each two months from it;
    ``stretch``: the same over all two-month stretches, and ``plain`` without weights;
    ``horizon``: struct(k, n, prior) of the coming months and of any. With ``only_ended`` a
    window counts for dates after its end alone.
    """
    dates = Dates(nows)
    size = len(dates.nows)
    ended = dates.after("unix_date(end)")
    months = known_months(windows, max(dates.t, default=0), "unix_date(end)" if only_ended else "-1000000")
    # the first date on which h months from m are past and the route has a known window before them
    past = lambda h: f"greatest({dates.after('opened')}, {dates.after(f'unix_date(make_date(CAST(floor((m + {h}) / 12) AS INT), (m + {h}) % 12 + 1, 1)) - 1')})"
    months = months.selectExpr("id", "m % 12 AS cal", f"pow(2D, (floor(m / 12) - {BASE_YEAR}) / {HALF_LIFE}D) AS v", *(f"{past(h)} AS p{h}" for h in (1, 2, 3, 6)), *(f"CASE WHEN known{h} IS NOT NULL THEN {dates.after(f'known{h}')} END AS q{h}" for h in (1, 2, 3, 6)))
    # greatest() passes over nulls, but what is never known counts for no date
    both = lambda h, seen: f"CASE WHEN q{h} IS NOT NULL THEN greatest(p{seen}, q{h}) END"
    counted = [(f"n{h}", f"p{h}") for h in (1, 2, 3, 6)] + [(f"k{h}", both(h, h)) for h in (1, 2, 3, 6)]
    furthest = max(HORIZONS)
    coming = [("an", f"p{furthest}"), *((f"ak{h}", both(h, furthest)) for h in HORIZONS)]
    pairs = [f"struct('{kind}' AS kind, {j} AS j)" for kind, j in counted] + [f"struct('{kind}' AS kind, {dates.next_of_month('cal', f'({j})')} AS j)" for kind, j in coming]
    empty = ["CAST(NULL AS STRING) AS kind", "CAST(NULL AS INT) AS cal", "CAST(NULL AS DOUBLE) AS v"]
    facts = {"one": "int", "bank": "string", "code": "string", "last_end": "date", "lo": "double", "hi": "double", "newest": "struct<end:date,start:date,first:bigint,pct:double>"}
    no = lambda *but: [f"CAST(NULL AS {kind}) AS {n}" for n, kind in facts.items() if n not in but]
    put = months.selectExpr("id", "cal", "v", f"inline(array({', '.join(pairs)}))").filter(F.col("j") < size).selectExpr("id", "j", "kind", "cal", "v", *no())
    counts_from = ended if only_ended else "0"
    seen = windows.selectExpr("id", f"{counts_from} AS j", *empty, "1 AS one", "bank", "code", "end AS last_end", "CAST(pct AS DOUBLE) AS lo", "CAST(pct AS DOUBLE) AS hi", *no("one", "bank", "code", "last_end", "lo", "hi")).filter(F.col("j") < size)
    over = windows.selectExpr("id", f"{ended} AS j", *empty, *no("newest"), "struct(end, start, -CAST(ord AS BIGINT) AS first, CAST(pct AS DOUBLE) AS pct) AS newest").filter(F.col("j") < size)
    each = seen.groupBy("id").agg(F.min("j").alias("j")).selectExpr("id", f"explode(sequence(j, {size - 1})) AS j", *empty, *no())
    sums: dict[str, str] = {}
    for c in range(12):
        for name, h in (("one", 1), ("two", 2)):
            for part in "nk":
                sums[f"{name}{c}_{part}"] = f"sum(CASE WHEN kind = '{part}{h}' AND cal = {c} THEN v END)"
    for name, kind in (("stretch_n", "n2"), ("stretch_k", "k2"), *((f"any{h}_{part}", f"{part}{h}") for h in HORIZONS for part in "nk")):
        sums[name] = f"sum(CASE WHEN kind = '{kind}' THEN v END)"
    sums |= {f"plain_{part}": f"sum(CASE WHEN kind = '{part}2' THEN 1 END)" for part in "nk"} | {kind: f"sum(CASE WHEN kind = '{kind}' THEN v END)" for kind, _ in coming}
    marks = {"n": "sum(one)", "bank": "max(bank)", "code": "max(code)", "last_end": "max(last_end)", "lo": "min(lo)", "hi": "max(hi)", "newest": "max(newest)"}
    rows = put.unionByName(seen).unionByName(over).unionByName(each).groupBy("id", "j").agg(*(F.expr(f"{x} AS {n}") for n, x in (sums | marks).items()))
    if size > 1:
        cal_of = f"(array({', '.join(str((t + 1) % 12) for t in dates.t)})[j])"
        till = lambda n: "min" if n == "lo" else "max" if n in marks and n != "n" else "sum"
        running = [f"{till(n)}({n}) OVER (PARTITION BY id{f', {cal_of}' if n in dict(coming) else ''} ORDER BY j) AS {n}" for n in (*sums, *marks)]
        rows = rows.selectExpr("id", "j", *running)
    at = lambda values: f"array({', '.join(values)})[j]"
    rows = rows.filter("n > 0").selectExpr("*", at([f"DATE '{d}'" for d in dates.nows] or ["CAST(NULL AS DATE)"]) + " AS now", at([str(t) for t in dates.t] or ["0"]) + " AS t")
    rows = rows.selectExpr("*", f"pow(0.5D, (floor(t / 12) - {BASE_YEAR}) / {HALF_LIFE}D) AS f")
    mass = lambda k, n: f"struct(coalesce({k}, 0D) * f AS k, coalesce({n}, 0D) * f AS n)"
    pair = lambda name: mass(f"{name}_k", f"{name}_n")
    horizon = [f"struct(coalesce(ak{h}, 0D) * f AS k, coalesce(an, 0D) * f AS n, CASE WHEN any{h}_n > 0 THEN coalesce(any{h}_k, 0D) / any{h}_n ELSE 0D END AS prior, coalesce(any{h}_n, 0D) > 0 AS some)" for h in HORIZONS]
    return rows.selectExpr(
        "now", "t", "id", "bank", "code", "CAST(n AS BIGINT) AS n", "last_end", "lo", "hi",
        f"CASE WHEN datediff(now, newest.end) BETWEEN 1 AND {RECENT_DAYS} THEN struct(newest.pct AS pct, newest.end AS endedAt) END AS ended",
        f"array({', '.join(pair(f'one{c}') for c in range(12))}) AS cal1", f"array({', '.join(pair(f'two{c}') for c in range(12))}) AS cal2",
        f"{pair('stretch')} AS stretch", "struct(coalesce(plain_k, 0) AS k, coalesce(plain_n, 0) AS n) AS plain", f"array({', '.join(horizon)}) AS horizon",
    )


def shrunk(mass: str, prior: str) -> Column:
    """The rate of a mass (a struct of k and n), drawn to a prior."""
    return F.expr(f"({mass}.k + {TAU}D * {prior}) / ({mass}.n + {TAU}D)")


def typical(lo: Column, hi: Column) -> Column:
    """``+25–50%``, ``+25%`` or a dash."""
    return F.when(lo.isNull(), F.lit("—")).when(lo == hi, F.concat(F.lit("+"), plain(lo), F.lit("%"))).otherwise(F.concat(F.lit("+"), plain(lo), F.lit("–"), plain(hi), F.lit("%")))


def with_priors(mass: DataFrame) -> DataFrame:
    """``prior_route``, ``prior_bank`` (all of a bank's routes but this one) and ``prior2``, pooled by the number of windows."""
    banks = mass.groupBy("now", "bank").agg(F.sum("stretch.k").alias("bank_k"), F.sum("stretch.n").alias("bank_n"))
    own = F.when(F.col("stretch.n") > 0, F.col("stretch.k") / F.col("stretch.n")).otherwise(0.0)
    rest_k, rest_n = F.col("bank_k") - F.col("stretch.k"), F.col("bank_n") - F.col("stretch.n")
    joined = mass.join(banks, ["now", "bank"]).withColumn("prior_route", own)
    # a single route leaves a rest of rounding errors at most
    joined = joined.withColumn("prior_bank", F.when(rest_n > 1e-9, rest_k / rest_n).otherwise(F.col("prior_route")))
    share = F.col("n") / (F.col("n") + POOL)
    return joined.withColumn("prior2", share * F.col("prior_route") + (1 - share) * F.col("prior_bank"))


def finished(mass: DataFrame, *, monotone: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Probabilities and labels from masses, and columns to ``keep``; see :func:`derive_history`."""
    rows = with_priors(mass)
    t = F.col("t")
    all_k, all_n = (" + ".join(f"cal1[{c}].{f}" for c in range(12)) for f in "kn")
    rows = made_once(rows, {"prior1": F.expr(f"CASE WHEN {all_n} > 0 THEN ({all_k}) / ({all_n}) ELSE 0D END")})
    # the values of calendar month c as columns of their own: no lambda, and each computed once
    mp = {f"mp{c}": round3(shrunk(f"cal1[{c}]", "prior1")) for c in range(12)}
    capped = lambda rate: round3(F.least(F.lit(MOST), rate))
    p2 = F.array(*(capped(shrunk(f"cal2[{c}]", "prior2")) for c in range(12)))
    wait = F.array(*(capped(shrunk(f"horizon[{k}]", f"horizon[{k}].prior")) for k in range(len(HORIZONS))))
    enough = F.expr(" AND ".join(f"horizon[{k}].some" for k in range(len(HORIZONS))))
    rows = made_once(rows, {**mp, "p2": p2, "raw_wait": F.when(enough, wait)})
    # soon: minus the months until calendar month c, 1 to 12
    rows = made_once(rows, {"best": F.expr(f"greatest({', '.join(f'struct(mp{c} AS p, -(pmod({c} - t - 1, 12) + 1) AS soon)' for c in range(12))})")})
    since = F.datediff("now", "last_end") / 30.44
    recency = F.when(since < 12, 1.0).when(since <= 24, 0.75).otherwise(0.5)
    prob = F.least(F.lit(95), F.floor(100 * F.col("best.p") * recency + 0.5).cast("int"))
    raw = F.col("raw_wait")
    raised = F.when(raw.isNotNull(), F.array(raw[0], F.greatest(raw[0], raw[1]), F.greatest(raw[0], raw[1], raw[2])))
    rows = made_once(rows, {"prob": prob, "wait": raised if monotone else raw})
    following = F.struct(month_label(t - F.col("best.soon")).alias("label"), "prob")
    return rows.select(
        "now", "id", "bank", "code", "n", F.array(*(F.col(f"mp{c}") for c in range(12))).alias("mp"), "p2", "wait", (F.col("wait") != raw).alias("wait_raised"), typical(F.col("lo"), F.col("hi")).alias("typical"),
        F.when((F.col("n") >= 2) & (F.col("best.p") > 0) & (F.col("prob") > 0), following).alias("next"), "ended", "last_end", *keep,
    )


def derive_history(windows: DataFrame, nows: list[date], *, only_ended: bool = False, monotone: bool = True) -> DataFrame:
    """One row per (now, id): ``bank, code, n, mp, p2, wait, wait_raised, typical, next, ended, last_end``.

    ``mp``: a window in each calendar month; ``p2``: in the two months from it; ``wait``:
    within 1, 3 and 6 months, null without evidence for all three (with ``monotone`` never
    falling, and ``wait_raised`` tells where that changed it); ``next``: the likeliest of
    the coming twelve months, null below two windows.
    """
    return finished(masses(windows, nows, only_ended=only_ended), monotone=monotone)


def history_lines(windows: DataFrame) -> DataFrame:
    """``id, hist``: labels of a route's windows, the latest start first, ties in their order."""
    line = F.struct((-F.unix_date("start")).alias("late"), "ord", F.struct(window_label(F.col("start")).alias("w"), "pct", length_label(F.col("start"), F.col("end")).alias("len")).alias("line"))
    return windows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("hist"))
