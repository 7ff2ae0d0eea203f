"""DuckDB SQL for :mod:`tidewindow.plans.page_queries`: what the parsers must find, from the tables themselves."""

from __future__ import annotations

from tidewindow.plans.oracles import FINISH, HIGH, MONTHS, ONE, WIN
from tidewindow.plans.tables import FEED_DAY, NOW

_LIVE = f"live AS (SELECT * FROM high WHERE a >= DATE '2001-01-01' AND a < DATE '{NOW}')"
_RAW = 'bank AS "bankName", code AS "partnerName", pct'
_UNCOVERED = "NOT EXISTS (SELECT 1 FROM high h WHERE h.id = w.id AND w.z >= h.a AND w.a <= h.z)"

ORACLE_SQL: dict[str, str] = {
    "bonus_table_rows": f"""WITH {WIN} SELECT {_RAW}, strftime(z, '%m/%d/%y') AS "endDateRaw" FROM win""",
    "archive_table_rows": f"""WITH {WIN} SELECT {_RAW}, strftime(a, '%m/%d/%y') AS "startDateRaw", strftime(z, '%m/%d/%y') AS "endDateRaw" FROM win WHERE ord % 7 <> 0""",
    "bonus_grid_rows": f"""WITH {WIN} SELECT {_RAW}, strftime(z, '%B %-d, %Y') AS "endDateRaw" FROM win""",
    "offer_rows": f"""WITH {WIN}, o AS (SELECT * FROM win WHERE ord % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY id, pct ORDER BY ord) = 1)
SELECT array_to_string(list_transform(string_split(replace(lower(code), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS "partnerName", pct,
  strftime(CASE WHEN ord % 2 = 0 THEN z + 1 ELSE z END, '%d/%m') AS "endDateRaw" FROM o""",
    "banner_rows": f"""WITH {WIN}, b AS (SELECT DISTINCT id, code, pct, strftime(z, '%d/%m/%y') AS d FROM win) SELECT code AS "partnerName", pct, d AS "endDateRaw" FROM b""",
    "unpivot_ratio": """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AMEX' WHEN 'BUILDING' THEN 'CHASE' WHEN 'FURNITURE' THEN 'CITI' WHEN 'HOUSEHOLD' THEN 'C1' ELSE 'BILT' END AS bank,
  'air' AS bucket, n_name AS name, '1000:' || count(*) AS ratio FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "listed_partners": """SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'https://www.livelo.com.br/p/' ELSE 'https://x.org/' END || s_suppkey AS url FROM supplier WHERE s_acctbal >= 0""",
    "list_directory": """SELECT 'LIV' AS bank, 'air' AS bucket, s_name AS name, '—' AS ratio FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 4 <> 0
UNION ALL SELECT DISTINCT 'LIV', 'hotel', 'Hilton Honors', '—' FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 4 = 0""",
    "menu_directory": "SELECT 'ESF' AS bank, s_name AS name FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 6 <> 0",
    "showcase_ids": "SELECT 'e' || lpad(s_suppkey::VARCHAR, 9, '0') AS id, 'https://www.esfera.com.vc/p/x/e' || lpad(s_suppkey::VARCHAR, 9, '0') AS url FROM supplier",
    "data_words": """SELECT s_suppkey, '{"t":" ' || s_name || ' A&B ' || s_suppkey || '"}' AS words FROM supplier""",
    "stated_rates": """SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 2 THEN '9:2' WHEN p_partkey % 4 = 3 THEN p_size || ':1' ELSE p_size || '.5:1' END AS ratio FROM part
UNION ALL SELECT -p_partkey, CASE WHEN p_partkey % 8 = 1 THEN p_size || ':1' ELSE '1:1' END FROM part WHERE p_partkey % 4 = 1""",
    "page_rates": "SELECT p_partkey AS k, p_size || CASE WHEN p_partkey % 2 = 0 THEN ':1' ELSE ':2' END AS ratio FROM part",
    "resolved_windows": f"""WITH {WIN} SELECT ord, ['amex', 'chase', 'citi', 'c1', 'bilt', 'wf', 'esf', 'liv', 'rove'][ord % 9 + 1] || CASE WHEN ord % 2 = 0 THEN '-g3' ELSE '-la' END AS id,
  CAST(a AS VARCHAR) AS start, CAST(z AS VARCHAR) AS "end", s FROM win WHERE ord % 7 <> 0 AND ord % 9 <> 0 AND ord % 11 <> 0""",
    "windows_of_any_pct": f"""WITH {WIN} SELECT ord, ['amex', 'chase', 'citi', 'c1', 'bilt', 'wf', 'esf', 'liv', 'rove'][ord % 9 + 1] || CASE WHEN ord % 2 = 0 THEN '-g3' ELSE '-la' END AS id,
  CASE WHEN ord % 11 = 0 THEN 0 ELSE pct END AS pct FROM win WHERE ord % 7 <> 0 AND ord % 9 <> 0""",
    "live_routes": f"""WITH {ONE}, {HIGH}, {_LIVE},
best AS (SELECT *, min(ord) OVER (PARTITION BY id) AS seen FROM live QUALIFY row_number() OVER (PARTITION BY id ORDER BY pct DESC, ord) = 1),
said AS (SELECT id, count(*) AS n, min(pct) AS lo, max(pct) AS hi FROM dated GROUP BY id)
SELECT id, code AS airline, CASE WHEN n IS NULL THEN '—' WHEN lo = hi THEN '+' || CAST(lo AS INTEGER) || '%' ELSE '+' || CAST(lo AS INTEGER) || '–' || CAST(hi AS INTEGER) || '%' END AS typical,
  pct, CAST(z AS VARCHAR) AS end_date, coalesce(n, 0) AS windows, seen AS at FROM best LEFT JOIN said USING (id)""",
    "forecasts_beside_live": f"""WITH {ONE},{MONTHS},{FINISH}, {HIGH}, {_LIVE}, o AS (SELECT id, min(ord) AS ord FROM win GROUP BY id),
f AS (SELECT u.id, prob, row_number() OVER (ORDER BY CASE WHEN e.id IS NULL THEN 1 ELSE 0 END, prob DESC, ord) AS rank
  FROM upcoming u JOIN o USING (id) LEFT JOIN ended e ON e.id = u.id WHERE u.id NOT IN (SELECT id FROM live))
SELECT id, CAST(1 AS BIGINT) AS part, rank, prob FROM f WHERE rank <= 60
UNION ALL SELECT id, 2, NULL, NULL FROM ended WHERE id NOT IN (SELECT id FROM upcoming) AND id NOT IN (SELECT id FROM live)""",
    "ledger_stamps": f"""WITH {ONE},{MONTHS},{FINISH}, {HIGH}, act AS (SELECT id, max(z) AS z FROM high GROUP BY id),
feed AS (SELECT r.id, p.p2, w.p AS w1 FROM routes r JOIN prob p ON p.id = r.id AND p.cal = {NOW.month - 1} LEFT JOIN wait w ON w.id = r.id AND w.h = 1 WHERE r.id < 'g')
SELECT act.id, CAST(z AS VARCHAR) AS end_date, p2, w1, CASE WHEN feed.id IS NULL THEN true END AS absent, '{FEED_DAY}' AS as_of FROM act LEFT JOIN feed USING (id)""",
    "ledger_as_history": f"""WITH {WIN}, {HIGH}, one AS (SELECT ord, id, a, a + 2 AS l, CASE ord % 3 WHEN 0 THEN a - 1 WHEN 1 THEN z END AS e FROM win),
twice AS (SELECT * FROM one UNION ALL SELECT -ord, id, a, l, e FROM one WHERE ord % 2 = 0),
w AS (SELECT ord, id, a, CASE WHEN e >= a THEN e ELSE l END AS z FROM twice QUALIFY row_number() OVER (PARTITION BY id, a, e ORDER BY ord) = 1)
SELECT ord, id, CAST(a AS VARCHAR) AS start, CAST(z AS VARCHAR) AS "end", year(a) * 12 + month(a) - 1 AS s FROM w WHERE {_UNCOVERED}""",
    "fold_directory": """WITH p AS (SELECT p_brand AS bank, p_type AS name, CASE WHEN p_size % 3 = 0 THEN '—' ELSE p_size || ':1' END AS ratio, p_partkey AS k FROM part)
SELECT bank, name, coalesce(arg_min(ratio, k) FILTER (ratio <> '—'), '—') AS ratio, row_number() OVER (PARTITION BY bank ORDER BY name) AS ord FROM p GROUP BY bank, name""",
    "partner_rules": """WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS subject, s_acctbal AS v FROM supplier)
SELECT CAST(n_nationkey AS VARCHAR) AS subject, 'bank fg missing' AS rule FROM nation WHERE n_nationkey % 2 <> 0
UNION ALL SELECT subject, 'airline_domains value' FROM s WHERE k % 5 <> 0 AND k % 11 = 0
UNION ALL SELECT subject, 'icon not https' FROM s WHERE k % 13 = 0
UNION ALL SELECT subject, 'icon of unknown code' FROM s WHERE k % 5 = 0
UNION ALL SELECT subject, 'meta without value' FROM s WHERE k % 5 = 0
UNION ALL SELECT subject, 'currency' FROM s WHERE k % 3 <> 0 AND k % 7 = 0
UNION ALL SELECT subject, 'asOf' FROM s WHERE k % 4 = 0
UNION ALL SELECT subject, 'source empty' FROM s WHERE k % 6 = 0
UNION ALL SELECT subject, 'sourceValue' FROM s WHERE k % 2 = 0 AND NOT v > 0
UNION ALL SELECT subject, 'BRL without rate' FROM s WHERE k % 3 = 0 AND (k % 2 <> 0 OR k % 9 = 0)
UNION ALL SELECT p_partkey % 30 || '.1', 'time empty' FROM part WHERE p_partkey % 17 = 0
UNION ALL SELECT DISTINCT CAST(p_partkey % 30 AS VARCHAR), 'time of unknown bank' FROM part WHERE p_partkey % 30 NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT p_brand || '.air', 'tuple' FROM part WHERE p_partkey % 19 = 0""",
}
