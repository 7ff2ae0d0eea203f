"""DuckDB SQL for the queries of :mod:`tidewindow.plans.queries`, on the same tables."""

from __future__ import annotations

from tidewindow.functions.names import DISPLAY_NAMES
from tidewindow.plans.tables import CUTOFFS, LARGE, NOW


def _windows(name: str, priority: str) -> str:
    return f"""{name} AS (
  SELECT lower(c_mktsegment) || '-' || lower(n_name) AS id, c_mktsegment AS bank, n_name AS code, CAST(o_orderdate AS DATE) AS a,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 35 AS INTEGER) AS z, CAST(10 + 5 * (o_orderkey % 10) AS DOUBLE) AS pct, o_orderkey AS ord
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderpriority = '{priority}' AND o_totalprice > {LARGE})"""


WIN = f"""{_windows("raw", "1-URGENT")},
win AS (SELECT *, year(a) * 12 + month(a) - 1 AS s, year(z) * 12 + month(z) - 1 AS e FROM raw)"""
HIGH = _windows("high", "2-HIGH")
ONE = f"""{WIN},
dated AS (SELECT DATE '{NOW}' AS now, {NOW.year * 12 + NOW.month - 1} AS t, * FROM win)"""
MANY = f"""{WIN},
cuts AS (SELECT CAST(unnest(generate_series(DATE '{CUTOFFS[0]}', DATE '{CUTOFFS[1]}', INTERVAL 1 MONTH)) AS DATE) AS now),
dated AS (SELECT now, year(now) * 12 + month(now) - 1 AS t, win.* FROM win JOIN cuts ON z < now)"""
MONTHS = """
firsts AS (SELECT now, t, id, min(s) AS f FROM dated GROUP BY ALL HAVING min(s) < t),
grid AS (SELECT now, t, id, unnest(generate_series(f, t - 1)) AS m FROM firsts),
hits AS (SELECT DISTINCT now, id, unnest(generate_series(s, least(e, t - 1))) AS m FROM dated WHERE s < t),
hit1 AS (SELECT g.*, pow(0.5, (g.t // 12 - g.m // 12) / 3.0) AS w, CASE WHEN h.m IS NULL THEN 0 ELSE 1 END AS h1 FROM grid g LEFT JOIN hits h USING (now, id, m)),
hit AS (
  SELECT *, max(h1) OVER (o ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS h2, max(h1) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h3,
         max(h1) OVER (o ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS h6
  FROM hit1 WINDOW o AS (PARTITION BY now, id ORDER BY m))"""
FINISH = """
routes AS (SELECT now, t, id, bank, code, count(*) AS n, max(z) AS last_end, min(pct) AS lo, max(pct) AS hi FROM dated GROUP BY ALL),
sums AS (
  SELECT now, id, coalesce(sum(w) FILTER (m + 1 < t), 0) AS sn, coalesce(sum(w) FILTER (m + 1 < t AND h2 = 1), 0) AS sk,
         sum(w) AS n1, coalesce(sum(w) FILTER (h1 = 1), 0) AS k1
  FROM hit GROUP BY ALL),
own AS (SELECT r.*, coalesce(sn, 0) AS sn, coalesce(sk, 0) AS sk, CASE WHEN n1 > 0 THEN k1 / n1 ELSE 0 END AS prior1, CASE WHEN sn > 0 THEN sk / sn ELSE 0 END AS prior_route FROM routes r LEFT JOIN sums USING (now, id)),
rest AS (SELECT *, sum(sk) OVER b - sk AS bk, sum(sn) OVER b - sn AS bn FROM own WINDOW b AS (PARTITION BY now, bank)),
banked AS (SELECT *, CASE WHEN bn > 1e-9 THEN bk / bn ELSE prior_route END AS prior_bank FROM rest),
prior AS (SELECT *, n / (n + 5.0) * prior_route + (1 - n / (n + 5.0)) * prior_bank AS prior2 FROM banked),
cal AS (SELECT p.*, c.cal FROM prior p CROSS JOIN (SELECT unnest(range(12)) AS cal) c),
calsum AS (
  SELECT now, id, m % 12 AS cal, sum(w) AS n1, coalesce(sum(w) FILTER (h1 = 1), 0) AS k1,
         coalesce(sum(w) FILTER (m + 1 < t), 0) AS n2, coalesce(sum(w) FILTER (m + 1 < t AND h2 = 1), 0) AS k2
  FROM hit GROUP BY ALL),
prob AS (
  SELECT cal.*, coalesce(k2, 0) AS k2, coalesce(n2, 0) AS n2,
         floor((coalesce(calsum.k1, 0) + 2 * prior1) / (coalesce(calsum.n1, 0) + 2) * 1000 + 0.5) / 1000 AS mp,
         floor(least(0.95, (coalesce(k2, 0) + 2 * prior2) / (coalesce(n2, 0) + 2)) * 1000 + 0.5) / 1000 AS p2
  FROM cal LEFT JOIN calsum USING (now, id, cal)),
waits AS (
  SELECT r.now, r.id, h.h,
         coalesce(sum(w) FILTER (m % 12 = (r.t + 1) % 12 AND m + 5 < r.t), 0) AS n,
         coalesce(sum(w) FILTER (m % 12 = (r.t + 1) % 12 AND m + 5 < r.t AND CASE h.h WHEN 1 THEN h1 WHEN 3 THEN h3 ELSE h6 END = 1), 0) AS k,
         sum(w) FILTER (m + h.h - 1 < r.t) AS pn,
         coalesce(sum(w) FILTER (m + h.h - 1 < r.t AND CASE h.h WHEN 1 THEN h1 WHEN 3 THEN h3 ELSE h6 END = 1), 0) AS pk
  FROM routes r CROSS JOIN (SELECT unnest([1, 3, 6]) AS h) h LEFT JOIN hit USING (now, id) GROUP BY ALL),
wait AS (SELECT now, id, h, CASE WHEN min(coalesce(pn, 0)) OVER (PARTITION BY now, id) > 0 THEN floor(least(0.95, (k + 2 * pk / pn) / (n + 2)) * 1000 + 0.5) / 1000 END AS p FROM waits),
best AS (
  SELECT now, t, id, n, last_end, mp, cal, (cal - t - 1) % 12 + CASE WHEN (cal - t - 1) % 12 < 0 THEN 13 ELSE 1 END AS ahead FROM prob
  QUALIFY row_number() OVER (PARTITION BY now, id ORDER BY mp DESC, ahead) = 1),
chance AS (
  SELECT *, least(95, CAST(floor(100 * mp * CASE WHEN (now - last_end) / 30.44 < 12 THEN 1.0 WHEN (now - last_end) / 30.44 <= 24 THEN 0.75 ELSE 0.5 END + 0.5) AS BIGINT)) AS prob
  FROM best WHERE n >= 2 AND mp > 0),
upcoming AS (
  SELECT now, id, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][(t + ahead) % 12 + 1] || ' ' || (t + ahead) // 12 AS label, prob
  FROM chance WHERE prob > 0),
ended AS (
  SELECT now, id, pct, z FROM dated WHERE now - z BETWEEN 1 AND 30
  QUALIFY row_number() OVER (PARTITION BY now, id ORDER BY z DESC, a DESC, ord) = 1)"""
EVAL = f"""{MANY},{MONTHS},{FINISH},
clim AS (SELECT r.now, r.id, coalesce(avg(h2) FILTER (m + 1 < hit.t), 0.5) AS clim FROM routes r LEFT JOIN hit USING (now, id) GROUP BY ALL),
evals AS (
  SELECT p.id, p.t AS cut, p.t // 12 AS year, p.n AS nTrain, p.p2 AS ship, c.clim,
         CAST(EXISTS (SELECT 1 FROM win w WHERE w.id = p.id AND w.s <= p.t + 2 AND w.e >= p.t + 1) AS INTEGER) AS y
  FROM prob p JOIN upcoming USING (now, id) JOIN clim c USING (now, id)
  WHERE p.cal = (p.t + 1) % 12 AND NOT EXISTS (SELECT 1 FROM win w WHERE w.id = p.id AND w.s <= p.t AND w.e >= p.t))"""
_LOSS = "avg(-CASE WHEN y = 1 THEN ln(least(0.999, greatest(0.001, {p}))) ELSE ln(1 - least(0.999, greatest(0.001, {p}))) END)"
SCORES = f"""count(*) AS n, round(avg(pow(ship - y, 2)), 6) AS brier, round(avg(pow(clim - y, 2)), 6) AS brier_ref,
  round({_LOSS.format(p="ship")}, 6) AS log_loss, round({_LOSS.format(p="clim")}, 6) AS log_loss_ref,
  round((1 - avg(pow(ship - y, 2)) / nullif(avg(pow(clim - y, 2)), 0)) * 100, 6) AS skill_pct"""


def _end_date(month: str, day: str) -> str:
    """The coming such day as of NOW, as text; null if the year found has none."""
    this, after = (f"try_cast({NOW.year + k} || '-' || {month} || '-' || {day} AS DATE)" for k in (0, 1))
    compared = f"coalesce({this}, CASE WHEN {month} = 2 AND {day} = 29 THEN DATE '{NOW.year}-03-01' END)"
    return f"CAST(CASE WHEN {compared} < DATE '{NOW}' THEN {after} ELSE {this} END AS VARCHAR)"


def _directory(name: str, lo: int, hi: int) -> str:
    return f"""{name} AS (SELECT p_brand AS bank, p_type AS name, CASE WHEN min(p_size) % 3 = 0 THEN '—' ELSE min(p_size) || ':1' END AS ratio
  FROM part WHERE p_size BETWEEN {lo} AND {hi} GROUP BY ALL)"""


_MARKS = "regexp_replace(strip_accents(lower(text)), '[/&.,()-]', ' ', 'g')"
_STRIP = r"html"
for _p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>", r"(?i)&nbsp;"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
_EVENTS = "seen AS (SELECT user_id || '|' || event_type AS id, CAST(ts AS DATE) AS d, max(value) AS pct FROM events GROUP BY ALL)"

ORACLE_SQL: dict[str, str] = {
    "windows_from_orders": f"WITH {WIN} SELECT id, bank, code, CAST(a AS VARCHAR) AS start, CAST(z AS VARCHAR) AS \"end\", pct, s, e, ord FROM win",
    "month_expand": f"WITH {ONE},{MONTHS} SELECT id, m FROM grid",
    "month_hits": f"WITH {ONE},{MONTHS} SELECT id, m, h1 = 1 AS hit FROM hit",
    "decay_mass": f"WITH {ONE},{MONTHS} SELECT id, m % 12 AS cal, round(sum(w), 6) AS n, round(sum(CASE WHEN h1 = 1 THEN w ELSE 0 END), 6) AS k FROM hit GROUP BY ALL",
    "monthly_probability": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, cal, mp AS p FROM prob",
    "stretch_rate": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, round(sk, 6) AS k, round(sn, 6) AS n FROM own",
    "calendar_stretch_mass": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, cal, round(k2, 6) AS k, round(n2, 6) AS n FROM prob",
    "horizon_wait": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, max(p) FILTER (h = 1) AS within_1, max(p) FILTER (h = 3) AS within_3, max(p) FILTER (h = 6) AS within_6 FROM wait GROUP BY id",
    "bank_leave_one_out": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, round(prior_route, 6) AS prior_route, round(prior_bank, 6) AS prior_bank, round(prior2, 6) AS prior2 FROM prior",
    "pooled_p2": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, cal, p2 AS p FROM prob",
    "next_best_month": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, label, prob FROM upcoming",
    "recently_ended": f"WITH {ONE},{MONTHS},{FINISH} SELECT id, pct, CAST(z AS VARCHAR) AS ended_at FROM ended",
    "typical_range": f"WITH {ONE} SELECT id, CASE WHEN min(pct) = max(pct) THEN '+' || CAST(min(pct) AS INTEGER) || '%' ELSE '+' || CAST(min(pct) AS INTEGER) || '–' || CAST(max(pct) AS INTEGER) || '%' END AS typical FROM dated GROUP BY id",
    "history_labels": f"""WITH {WIN} SELECT id, row_number() OVER (PARTITION BY id ORDER BY a DESC, ord) AS pos, upper(strftime(a, '%b %Y')) AS w, pct,
  CASE WHEN z = a THEN '1 day' ELSE (z - a + 1) || ' days' END AS len FROM win""",
    "overlaps": f"""WITH {WIN}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a, ord) AS rn FROM win)
SELECT x.id, CAST(x.a AS VARCHAR) AS a_start, CAST(x.z AS VARCHAR) AS a_end, CAST(y.a AS VARCHAR) AS b_start, CAST(y.z AS VARCHAR) AS b_end
FROM n x JOIN n y ON x.id = y.id AND x.rn < y.rn AND x.a <= y.z AND y.a <= x.z""",
    "uncovered_windows": f"""WITH {WIN}, {HIGH} SELECT id, ord, CAST(a AS VARCHAR) AS start, CAST(z AS VARCHAR) AS "end" FROM win
WHERE NOT EXISTS (SELECT 1 FROM high h WHERE h.id = win.id AND win.z >= h.a AND win.a <= h.z)""",
    "dedupe_max_pct": f"""WITH {WIN}, r AS (SELECT win.*, o_orderstatus AS url FROM win JOIN orders ON o_orderkey = ord),
u AS (SELECT id, string_agg(url, ',' ORDER BY seen_at) AS urls FROM (SELECT id, url, min(ord) AS seen_at FROM r GROUP BY ALL) GROUP BY id)
SELECT id, pct, CAST(z AS VARCHAR) AS end_date, min(ord) OVER (PARTITION BY id) AS seen, urls FROM r JOIN u USING (id)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY pct DESC, ord) = 1""",
    "alias_resolve": "SELECT c_custkey, c_mktsegment || ' (' || lower(n_name) || ')' AS name, n_name AS code FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "candidate_names": "SELECT s_suppkey, lower(s_name) || ' ' || lower(n_name) || '|' || lower(s_name) || '|' || lower(n_name) AS candidates FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "unmapped_names": "SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown bank \"b' || s_suppkey ELSE 'unknown partner \"' || s_name END || '\"' AS reason FROM supplier",
    "transfer_times": f"""WITH {WIN}, {HIGH}, t AS (SELECT bank, code, count(*) || ' DAYS' AS time FROM high GROUP BY ALL)
SELECT DISTINCT bank, code, coalesce(time, '—') AS time FROM win LEFT JOIN t USING (bank, code)""",
    "forecast_topk": f"""WITH {ONE},{MONTHS},{FINISH}, o AS (SELECT id, min(ord) AS ord FROM win GROUP BY id),
f AS (SELECT u.id, prob, row_number() OVER (ORDER BY CASE WHEN e.id IS NULL THEN 1 ELSE 0 END, prob DESC, ord) AS rank FROM upcoming u JOIN o USING (id) LEFT JOIN ended e ON e.id = u.id)
SELECT id, CAST(1 AS BIGINT) AS part, rank, prob FROM f WHERE rank <= 60
UNION ALL SELECT id, 2, NULL, NULL FROM ended WHERE id NOT IN (SELECT id FROM upcoming)""",
    "stale_merge": f"""WITH {WIN}, {HIGH} SELECT DISTINCT id, 'candidate' AS origin FROM win UNION ALL
SELECT DISTINCT id, 'previous' FROM high WHERE id NOT IN (SELECT id FROM win)""",
    "cutoff_training": f"WITH {MANY} SELECT t AS cut, id, count(*) AS n FROM dated GROUP BY ALL",
    "climatology": f"""WITH {MANY},{MONTHS}, r AS (SELECT DISTINCT now, t, id FROM dated)
SELECT r.t AS cut, r.id, round(coalesce(avg(h2) FILTER (m + 1 < hit.t), 0.5), 6) AS clim FROM r LEFT JOIN hit USING (now, id) GROUP BY ALL""",
    "eval_rows": f"WITH {EVAL} SELECT id, cut, year, nTrain, ship, round(clim, 6) AS clim, CAST(y AS BIGINT) AS y FROM evals",
    "brier_logloss": f"WITH {EVAL} SELECT {SCORES} FROM evals",
    "yearly_scores": f"WITH {EVAL} SELECT year, {SCORES} FROM evals GROUP BY year",
    "thickness_scores": f"WITH {EVAL} SELECT nTrain < 4 AS thin, {SCORES} FROM evals GROUP BY ALL",
    "worst_misses": f"WITH {EVAL} SELECT id, cut, round(abs(ship - y), 6) AS miss FROM evals WHERE abs(ship - y) > 0.6 ORDER BY abs(ship - y) DESC, id, cut LIMIT 8",
    "calibration_bins": f"""WITH {EVAL}, b AS (SELECT unnest(range(10)) AS b)
SELECT b * 10 || '-' || (b + 1) * 10 || '%' AS bin, count(*) AS n, round(avg(ship), 6) AS meanP, round(avg(y), 6) AS observed
FROM evals JOIN b ON ship >= CAST(b AS DOUBLE) / 10 AND (ship < CAST(b + 1 AS DOUBLE) / 10 OR (b = 9 AND ship <= 1)) GROUP BY b""",
    "effective_events": f"""WITH {EVAL}, m AS (SELECT v.id, v.cut, w.s FROM evals v JOIN win w ON w.id = v.id AND w.s <= v.cut + 2 AND w.e >= v.cut + 1 WHERE y = 1
  QUALIFY row_number() OVER (PARTITION BY v.id, v.cut ORDER BY w.ord) = 1)
SELECT (SELECT count(*) FROM evals WHERE y = 1) AS positiveRows, count(DISTINCT (id, s)) AS distinctWindows,
  round(CASE WHEN count(*) > 0 THEN count(*) / count(DISTINCT (id, s)) ELSE 0 END, 6) AS rowsPerWindow FROM m""",
    "bootstrap_delta": f"""WITH {EVAL},
g AS (SELECT row_number() OVER (ORDER BY cut) - 1 AS g, ek, er, n FROM (SELECT cut, sum(pow(ship - y, 2)) AS ek, sum(pow(clim - y, 2)) AS er, count(*) AS n FROM evals GROUP BY cut)),
size AS (SELECT count(*) AS c, sum(er) / sum(n) - sum(ek) / sum(n) AS delta FROM g),
i AS (SELECT rep, c, CAST(rep * c + j + 1 AS HUGEINT) AS i FROM size, (SELECT unnest(range(2000)) AS rep), (SELECT unnest(range(1000)) AS j) WHERE j < c),
s AS (SELECT rep, c, CAST((42 + i * 1831565813) % 4294967296 AS HUGEINT) AS s FROM i),
t1 AS (SELECT rep, c, (xor(s, s >> 15) * (s | 1)) % 4294967296 AS t FROM s),
t2 AS (SELECT rep, c, xor((t + xor(t, t >> 7) * (t | 61)) % 4294967296, t) AS t FROM t1),
d AS (SELECT rep, CAST(floor(CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296.0 * c) AS BIGINT) AS g FROM t2),
draws AS (SELECT rep, sum(er) / sum(n) - sum(ek) / sum(n) AS v FROM d JOIN g USING (g) GROUP BY rep),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM draws)
SELECT round(any_value(delta), 6) AS delta, round(max(v) FILTER (k = 50), 6) AS lo, round(max(v) FILTER (k = 1950), 6) AS hi,
  round(count(*) FILTER (v <= 0) / count(*), 6) AS pNeg, any_value(c) AS clusters FROM o, size""",
    "route_sizes": f"""WITH {WIN}, n AS (SELECT count(*) AS n FROM win GROUP BY id), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM n)
SELECT min(n) AS lo, max(n) FILTER (k = c // 2) AS mid, max(n) AS hi FROM r""",
    "parse_dates": """SELECT o_orderkey, CAST(try_cast((2000 + year(o_orderdate) % 100) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS DATE) AS VARCHAR) AS short,
  CAST(try_cast(year(o_orderdate) || '-' || day(o_orderdate) || '-' || month(o_orderdate) AS DATE) AS VARCHAR) AS swapped FROM orders""",
    "parse_end_dates": f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS long, {_end_date("month(o_orderdate)", "day(o_orderdate)")} AS day_month,
  {_end_date("month(o_orderdate)", "day(o_orderdate)")} AS until FROM orders""",
    "norm_text": rf"SELECT doc_id, md5(trim(regexp_replace({_MARKS}, '\s+', ' ', 'g'))) AS norm_md5 FROM documents",
    "page_titles": r"""SELECT page_id, CASE WHEN x <> '' AND lower(x) <> 'esfera' THEN x END AS title FROM (
SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)<', 1), '&amp;', '&'), '(?i)\s*[|–—-]\s*Esfera.*$', '')) AS x FROM pages)""",
    "stripped_pages": rf"SELECT page_id, md5(regexp_replace({_STRIP}, '\s+', ' ', 'g')) AS words_md5 FROM pages",
    "archived_pages": "SELECT url, md5(html) AS html_md5, length(html) AS chars, CAST(NULL AS VARCHAR) AS error FROM pages WHERE starts_with(url, 'https://')",
    "props_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "ledger_runs": f"""WITH {_EVENTS}, o AS (SELECT *, CASE WHEN d - lag(d) OVER w <= 1 THEN 0 ELSE 1 END AS opens FROM seen WINDOW w AS (PARTITION BY id ORDER BY d)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY d) AS run FROM o)
SELECT id, CAST(min(d) AS VARCHAR) AS firstSeen, CAST(max(d) AS VARCHAR) AS lastSeen, max(pct) AS pct FROM r GROUP BY id, run""",
    "ledger_replay": """WITH RECURSIVE seen AS (SELECT user_id || '|' || event_type AS id, CAST(ts AS DATE) AS d, max(value) AS pct FROM events GROUP BY ALL),
daily AS (SELECT *, CASE WHEN pct > 100 THEN d + 1 END AS z, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM seen),
walk AS (
  SELECT id, rn, 1 AS entry, d AS f, d AS l, pct, z FROM daily WHERE rn = 1
  UNION ALL SELECT n.id, n.rn, CASE WHEN goes THEN entry ELSE entry + 1 END, CASE WHEN goes THEN f ELSE d END, d, CASE WHEN goes THEN greatest(o_pct, n.pct) ELSE n.pct END, CASE WHEN goes THEN coalesce(n.z, o_z) ELSE n.z END
  FROM (SELECT w.entry, w.f, w.pct AS o_pct, w.z AS o_z, n.*, n.d - w.l <= 1 AND NOT coalesce(w.z < n.d, false) AS goes FROM walk w JOIN daily n ON n.id = w.id AND n.rn = w.rn + 1) n)
SELECT id, CAST(f AS VARCHAR) AS "firstSeen", CAST(l AS VARCHAR) AS "lastSeen", CAST(z AS VARCHAR) AS "endDate", pct FROM walk QUALIFY row_number() OVER (PARTITION BY id, entry ORDER BY rn DESC) = 1""",
    "ledger_step": f"""WITH {WIN}, {HIGH}, act AS (SELECT id, max(pct) AS pct, max(z) AS z FROM high GROUP BY id),
hit AS (SELECT id, min(ord) AS ord FROM win WHERE DATE '{NOW}' - z <= 7 AND id IN (SELECT id FROM act) GROUP BY id)
SELECT win.id, CAST(win.a AS VARCHAR) AS firstSeen, CAST(CASE WHEN hit.id IS NULL THEN win.z ELSE greatest(win.z, DATE '{NOW}') END AS VARCHAR) AS lastSeen,
  CASE WHEN hit.id IS NULL THEN NULL ELSE CAST(act.z AS VARCHAR) END AS endDate, CASE WHEN hit.id IS NULL THEN win.pct ELSE greatest(win.pct, act.pct) END AS pct
FROM win LEFT JOIN hit ON hit.id = win.id AND hit.ord = win.ord LEFT JOIN act ON act.id = win.id
UNION ALL SELECT id, '{NOW}', '{NOW}', CAST(z AS VARCHAR), pct FROM act WHERE id NOT IN (SELECT id FROM hit)""",
    "directory_merge": f"""WITH {_directory("cur", 1, 30)}, {_directory("scr", 26, 50)}
SELECT s.bank, s.name, CASE WHEN s.ratio <> '—' THEN s.ratio ELSE coalesce(c.ratio, '—') END AS ratio FROM scr s LEFT JOIN cur c USING (bank, name) WHERE s.bank IN (SELECT bank FROM cur)
UNION ALL SELECT bank, name, ratio FROM cur WHERE bank NOT IN (SELECT bank FROM scr)""",
    "rate_upsert": f"""WITH {_directory("cur", 1, 30)}, {_directory("scr", 26, 50)}, {_directory("more", 41, 50)},
seen AS (SELECT bank, name, CASE WHEN more.bank IS NULL THEN nullif(scr.ratio, '—') ELSE '10:1' END AS ratio FROM scr LEFT JOIN more USING (bank, name))
SELECT coalesce(c.bank, s.bank) AS bank, coalesce(c.name, s.name) AS name, coalesce(s.ratio, c.ratio, '—') AS ratio,
  CASE WHEN c.bank IS NULL THEN 'added' WHEN s.ratio <> c.ratio THEN 'updated' END AS change
FROM cur c FULL JOIN seen s ON c.bank = s.bank AND c.name = s.name""",
    "source_counts": f"""SELECT o_orderpriority AS source, count(*) AS entries, count(*) FILTER (o_totalprice > {LARGE}) AS kept, count(*) FILTER (o_totalprice > {LARGE}) = 0 AS failed
FROM orders GROUP BY ALL""",
    "constraint_violations": f"""WITH {ONE},{MONTHS},{FINISH},
x AS (SELECT id, max(p) FILTER (h = 1) AS a, max(p) FILTER (h = 3) AS b, max(p) FILTER (h = 6) AS c FROM wait GROUP BY id)
SELECT id AS subject, 'time missing' AS rule FROM routes UNION ALL SELECT DISTINCT id, 'mp range' FROM prob WHERE mp * 2 > 1
UNION ALL SELECT id, 'wait falls' FROM x WHERE a > b + 1e-9 OR b > c + 1e-9""",
}

_STEP = ORACLE_SQL["ledger_step"]
_MERGED, _UPSERTED = ORACLE_SQL["directory_merge"], ORACLE_SQL["rate_upsert"]
_NAMES = ", ".join(f"({k}, '{DISPLAY_NAMES[code]}')" for k, code in enumerate(sorted(DISPLAY_NAMES)))
ORACLE_SQL |= {
    "deadline_days": """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_hours(o_orderkey % 24) + INTERVAL 59 MINUTE - INTERVAL 3 HOUR, '%d/%m') AS timed,
  strftime(CAST(o_orderdate AS DATE), '%d/%m') AS plain, '' AS none FROM orders""",
    "display_names": f"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'ZZ' ELSE name END AS name FROM part JOIN (VALUES {_NAMES}) v(k, name) ON k = p_partkey % {len(DISPLAY_NAMES)}""",
    "directory_versions": f"""WITH {_directory("had", 1, 30)}, rows AS (SELECT bank, name, ratio FROM ({_MERGED}) WHERE bank < 'Brand#3'
  UNION ALL SELECT bank, name, ratio FROM ({_UPSERTED}) WHERE bank >= 'Brand#4' UNION ALL SELECT bank, name, ratio FROM had WHERE bank >= 'Brand#3' AND bank < 'Brand#4'),
other AS (SELECT coalesce(r.bank, h.bank) AS bank FROM rows r FULL JOIN had h ON r.bank = h.bank AND r.name = h.name WHERE r.ratio IS DISTINCT FROM h.ratio)
SELECT bank, name, ratio, bank IN (SELECT bank FROM other) AS changed FROM rows""",
    "ledger_changes": f"""WITH step AS ({_STEP}), {HIGH} SELECT id, count(*) AS entries, max(lastSeen) AS last_seen, id IN (SELECT id FROM high) AS changed FROM step GROUP BY id""",
    "source_guard": f"""SELECT p AS source, count(o) AS entries, count(o) = 0 AS failed FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS p)
LEFT JOIN (SELECT o_orderpriority AS o FROM orders WHERE o_totalprice > {LARGE} AND o_orderpriority <> '5-LOW') ON o = p GROUP BY p""",
    "publish_verdict": f"""WITH {WIN}, priorities AS (SELECT count(DISTINCT o_orderpriority) AS gave FROM orders WHERE o_totalprice > {LARGE} AND o_orderpriority <> '5-LOW'),
runs AS (SELECT b AS bank, (SELECT count(DISTINCT id) FROM win WHERE bank <= b) AS had, (SELECT count(DISTINCT id) FROM win WHERE bank = b) AS routes FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE']) AS b))
SELECT bank, CAST(5 AS BIGINT) AS sources, 5 - gave AS failed, had, routes, (5 - gave) * 2 > 5 AS too_many_failed, had >= 4 AND routes * 2 < had AS fell, NOT ((5 - gave) * 2 > 5) AND NOT (had >= 4 AND routes * 2 < had) AS ok FROM runs, priorities""",
}
