"""Queries that write the supplied tables as pages and documents, and read them back with the parsers.

What the parsers must find is known from the tables, so :mod:`tidewindow.plans.page_oracles`
states it in SQL without a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions.names import BANK_ALIASES
from tidewindow.operators import directory, ledger, routes, validate
from tidewindow.operators.forecast import derive_history, history_lines
from tidewindow.operators.windows import resolve_windows
from tidewindow.plans.publish import ENTRY
from tidewindow.plans.tables import FEED_DAY, NOW, order_windows, table
from tidewindow.sources import listings, rates

Query = Callable[[SparkSession, str], DataFrame]


def _joined(*parts: str | Column) -> Column:
    """Columns (Column) and texts (str) as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _pages(rows: DataFrame, item: Column, before: str, after: str, *, by: str = "id", between: str = "") -> DataFrame:
    """A page for each value of ``by``, with an item a row in the order of ``ord``."""
    items = rows.withColumn("item", item).groupBy(by).agg(F.min("ord").alias("page"), F.sort_array(F.collect_list(F.struct("ord", "item"))).alias("items"))
    html = _joined(before, F.array_join(F.transform("items", lambda x: x["item"]), between), after)
    return items.select("page", F.lit("http://listing").alias("url"), html.alias("html"))


def _data(json: str) -> tuple[str, str]:
    """What stands before and after the items of a page that carries them in its data script; ``json`` has them at %."""
    before, after = json.split("%")
    return f'<script id="__NEXT_DATA__" type="application/json">{before}', f"{after}</script>"


def _pct() -> Column:
    return F.col("pct").cast("int").cast("string")


def _row(mark: str | Column = "") -> Column:
    day = lambda c: F.date_format(c, "MM/dd/yy")
    return _joined(
        "<tr><td>", F.col("bank"), '</td><td><a href="#">', mark, _pct(), "% transfer bonus from ", F.col("bank"), " to ", F.col("code"),
        '</a></td><td><p style="display:none">9</p>', day("start"), "</td><td><p>9</p>", day("end"), "</td></tr>",
    )


_TABLE, _END = '<table class="tablepress">', "</table>"


def bonus_table_rows(spark, sf_dir):
    pages = _pages(order_windows(spark, sf_dir), _row(), f"<h3>Current and Upcoming Transfer Bonuses</h3>{_TABLE}", _END)
    return listings.table_bonuses(pages, "table").select("bankName", "partnerName", "pct", "endDateRaw")


def archive_table_rows(spark, sf_dir):
    targeted = F.when(F.col("ord") % 7 == 0, "[Targeted] ").otherwise("")
    pages = _pages(order_windows(spark, sf_dir), _row(targeted), f"<h3>Current and upcoming</h3>{_TABLE}<tr><td>x</td></tr>{_END}<h3>Expired bonuses</h3>{_TABLE}", _END)
    return listings.table_archive(pages, "table").select("bankName", "partnerName", "pct", "startDateRaw", "endDateRaw")


def bonus_grid_rows(spark, sf_dir):
    item = _joined(
        '<div class="tt-row"><div class="tt-body"><div class="tt-from">', F.col("bank"), ' <span class="tt-arrow">to</span></div><div class="tt-to">', F.col("code"),
        '<span class="tt-bonus">', _pct(), "% until ", F.date_format("end", "MMMM d, yyyy"), "</span></div></div></div>",
    )
    pages = _pages(order_windows(spark, sf_dir), item, '<h2><span id="Current_Transfer_Bonuses">x</span></h2><div class="transfer-times">', "</div>")
    return listings.grid_bonuses(pages, "grid").select("bankName", "partnerName", "pct", "endDateRaw")


def offer_rows(spark, sf_dir):
    """Every fifth offer is over, every second has a deadline, the others an end in words."""
    slug = _joined("/x/livelo-para-parceiros/", F.translate(F.lower("code"), " _", "--"), "/")
    words = _joined("<b>", _pct(), "%</b> de bônus até ", F.date_format("end", "dd/MM"))
    variation = F.struct(
        F.when(F.col("ord") % 5 == 0, "Encerrada").otherwise("Vigente").alias("status"), F.lit("Ganhe").alias("title"), words.alias("description"), F.struct(slug.alias("redirectLink")).alias("button"),
    )
    deadline = F.when(F.col("ord") % 2 == 0, F.date_format(F.date_add("end", 1), "yyyy-MM-dd"))
    node = F.to_json(F.struct(F.struct(F.array(variation).alias("variations")).alias("status"), F.struct(deadline.alias("endDate")).alias("countdown")))
    pages = _pages(order_windows(spark, sf_dir), node, *_data('{"a":[%]}'), between=",")
    return listings.offer_bonuses(pages, "offers").select("partnerName", "pct", "endDateRaw")


def banner_rows(spark, sf_dir):
    alt = _joined("Ao transferir, ", _pct(), "% de bônus, só até ", F.date_format("end", "dd/MM/yy"), " a marca da ", F.col("code"), " e o botão")
    pages = _pages(order_windows(spark, sf_dir), _joined('<a href="/p/x/e1"><img alt="', alt, '"></a><img alt="bônus">'), "<body>", "</body>")
    return listings.banner_bonuses(pages, "banners").select("partnerName", "pct", "endDateRaw")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def unpivot_ratio(spark, sf_dir):
    """A directory table with a row a nation and a column a segment, where the customers stand as ratios."""
    sums = _customers(spark, sf_dir).groupBy("n_nationkey", "n_name").agg(*(F.sum(F.when(F.col("c_mktsegment") == s, 1)).alias(s) for s in SEGMENTS))
    cells = [F.coalesce(_joined("<td>1,000 to ", F.col(s).cast("string"), "</td>"), F.lit("<td></td>")) for s in SEGMENTS]
    rows = sums.select(F.lit(0).alias("id"), F.col("n_nationkey").alias("ord"), "n_name", *(c.alias(s) for c, s in zip(cells, SEGMENTS)))
    head = "".join(f"<th>{s}</th>" for s in ("Rewards Program", "Transfer Ratio", *SEGMENTS[1:]))
    pages = _pages(rows, _joined("<tr><td>", F.col("n_name"), "</td>", *map(F.col, SEGMENTS), "</tr>"), f"{_TABLE}<thead><tr>{head}</tr></thead><tbody>", f"</tbody>{_END}")
    return directory.table_directory(pages).select("bank", "bucket", "name", "ratio")


def _supplier_pages(spark, sf_dir, item: Column, json: str) -> DataFrame:
    """A page a nation with an item a supplier."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("ord"), "s_name", "s_acctbal")
    return _pages(rows, item, *_data(json), between=",")


def listed_partners(spark, sf_dir):
    """Suppliers with a negative balance are no longer active; every third has a link from the root."""
    link = F.when(F.col("ord") % 3 == 0, _joined("/p/", F.col("ord").cast("string"))).otherwise(_joined("https://x.org/", F.col("ord").cast("string")))
    item = F.to_json(F.struct(F.col("s_name").alias("nomeParceiro"), link.alias("redirectUrl"), F.when(F.col("s_acctbal") < 0, "Inativo").otherwise("Ativo").alias("status")))
    return rates.listed_partners(_supplier_pages(spark, sf_dir, item, '{"x":[{"listPartners":[%]}]}')).select("name", "url")


def list_directory(spark, sf_dir):
    item = F.to_json(F.struct(F.when(F.col("ord") % 4 == 0, _joined("Hilton ", F.col("s_name"))).otherwise(F.col("s_name")).alias("nomeParceiro"), F.when(F.col("s_acctbal") < 0, "Inativo").alias("status")))
    rows = directory.list_directory(_supplier_pages(spark, sf_dir, item, '{"listPartners":[%]}'))
    return rows.select("bank", "bucket", "name", "ratio")


def menu_directory(spark, sf_dir):
    """Links that are no product pages are left out, as are names of no travel partners."""
    title = F.when(F.col("ord") % 6 == 0, _joined("Dotz ", F.col("s_name"))).otherwise(F.col("s_name"))
    link = F.struct(title.alias("title"), F.when(F.col("s_acctbal") < 0, "/q/1").otherwise(_joined("/p/", F.col("ord").cast("string"))).alias("href"))
    item = F.to_json(F.struct(link.alias("menuLink")))
    pages = _supplier_pages(spark, sf_dir, item, '[{"mainItemLabel":{"title":"Parceiros Nacionais"},"groupMenuItemsLinks":[%]},{"mainItemLabel":{"title":"x"},"groupMenuItemsLinks":[]}]')
    return directory.menu_directory(pages).select("bank", "name")


def showcase_ids(spark, sf_dir):
    """Each supplier's number twice, once with too many digits."""
    number = F.lpad(F.col("ord").cast("string"), 9, "0")
    item = F.to_json(F.struct(_joined("e", number, ", e", number, ",e1", number).alias("showcaseProductsId")))
    return rates.showcase_ids(_supplier_pages(spark, sf_dir, item, "[%]")).select("id", "url")


def data_words(spark, sf_dir):
    """The words in data scripts whose texts carry escaped tags and line ends."""
    s = table(spark, sf_dir, "supplier")
    html = _joined('<p>x</p><script id="__NEXT_DATA__" type="a">{"t":"\\u003cb class=1\\u003e', F.col("s_name"), "\\u003c/b\\u003e\\n\\tA\\u0026amp;B\\u0026nbsp;", F.col("s_suppkey").cast("string"), '"}</script>')
    return s.select("s_suppkey", F.trim(rates.data_text(html)).alias("words"))


def stated_rates(spark, sf_dir):
    """Parts state a rate, a second one for the club, a change that has come or is announced, or a rate of nothing first."""
    p = table(spark, sf_dir, "part").withColumns({"k": F.col("p_partkey").cast("long"), "n": F.col("p_size").cast("string")})
    k, n = F.col("k"), F.col("n")
    one = _joined("x ", n, ",5 pontos Livelo = 1 ponto ", F.col("p_brand"))
    club = _joined(n, ",5 pontos Esfera por 1 milha x para todos os clientes; ", "-" * 60, " 1 ponto Esfera = 2 milhas para o Clube")
    new = _joined("A partir de 1.", F.when(k % 8 == 2, "Julho").otherwise("Setembro"), ".2001: 9 pontos Esfera por 2 milhas. Paridades: ", club)
    none = _joined("0 pontos Esfera = 1 milha e ", n, " pontos Esfera vale 1 Avios")
    texts = p.select("k", F.when(k % 4 == 0, "LIV").otherwise("ESF").alias("bank"), F.when(k % 4 == 0, one).when(k % 4 == 1, club).when(k % 4 == 2, new).otherwise(none).alias("text"))
    until = _joined("A partir de 31/", F.when(k % 8 == 1, "julho").otherwise("agosto"), "/2001 ", n, " pontos Esfera por 1 milha. Até 1.Maio.2002 fica: 1 ponto Esfera por 1 milha")
    texts = texts.unionByName(p.filter(k % 4 == 1).select((-k).alias("k"), F.lit("ESF").alias("bank"), until.alias("text")))
    return rates.standard_ratios(rates.stated_rates(texts), F.lit(NOW)).select("k", "ratio")


def page_rates(spark, sf_dir):
    """Pages whose words state a rate, and pages that state one in their data alone."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.lit("LIV").alias("bank"), F.col("p_size").cast("string").alias("n"))
    shown = _joined("<p>", F.col("n"), "&nbsp;pontos <b>Livelo</b> = 1 ponto</p><script>9 pontos Livelo = 1 ponto</script>")
    hidden = _joined('<script id="__NEXT_DATA__" type="a">{"a":"', F.col("n"), ' pontos Livelo\\n= 2 pontos"}</script>')
    return rates.page_ratios(p.select("k", "bank", F.when(F.col("k") % 2 == 0, shown).otherwise(hidden).alias("html")), F.lit(NOW))


def _raw_windows(spark, sf_dir):
    """Orders as raw windows; every seventh names no known bank, every ninth has a date that there is none, every eleventh no bonus."""
    w = order_windows(spark, sf_dir)
    banks = list(BANK_ALIASES)
    name = F.element_at(F.array(*(F.lit(BANK_ALIASES[b][-1]) for b in banks)), (F.col("ord") % len(banks) + 1).cast("int"))
    raw = w.select(
        F.when(F.col("ord") % 7 == 0, "no bank").otherwise(F.upper(name)).alias("bankName"), F.when(F.col("ord") % 2 == 0, "Smiles (GOL)").otherwise("LATAM - Latam Pass").alias("partnerName"),
        F.when(F.col("ord") % 11 == 0, 0.0).otherwise(F.col("pct")).alias("pct"), F.when(F.col("ord") % 9 == 0, "02/30/01").otherwise(F.date_format("start", "M/d/yyyy")).alias("startDateRaw"), F.date_format("end", "MM/dd/yyyy").alias("endDateRaw"), "ord",
    )
    return raw


def resolved_windows(spark, sf_dir):
    """Raw windows that have a known bank, dates and a bonus."""
    return resolve_windows(_raw_windows(spark, sf_dir)).select("ord", "id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), F.col("s").cast("long").alias("s"))


def windows_of_any_pct(spark, sf_dir):
    """The same without a look at the bonus, as the evaluation reads its archive."""
    return resolve_windows(_raw_windows(spark, sf_dir), check_pct=False).select("ord", "id", "pct")


def _bonuses(spark, sf_dir):
    """High orders of 2001 that began before today as live bonuses."""
    w = order_windows(spark, sf_dir, "2-HIGH").filter((F.col("start") >= "2001-01-01") & (F.col("start") < NOW))
    return w.select("ord", "id", "bank", "code", "pct", F.date_format("end", "MM/dd/yyyy").alias("endDateRaw"), F.lit("u").alias("sourceUrl"), F.col("bank").alias("bankName"), F.col("code").alias("partnerName"))


def _lines(spark, sf_dir):
    w = order_windows(spark, sf_dir)
    return derive_history(w, [NOW]).join(history_lines(w), "id").join(w.groupBy("id").agg(F.min("ord").alias("ord")), "id")


def live_routes(spark, sf_dir):
    """Live routes with what history says of them, in order of first appearance."""
    live = routes.live_routes(routes.best_bonuses(_bonuses(spark, sf_dir), NOW), _lines(spark, sf_dir))
    return live.select("id", "airline", "typical", F.col("active.pct").alias("pct"), F.col("active.endDate").cast("string").alias("end_date"), F.size("hist").cast("long").alias("windows"), F.col("pos.at").alias("at"))


def forecasts_beside_live(spark, sf_dir):
    """The forecasts to publish beside live routes: a report of 60 at most, and routes that only ended."""
    lines = _lines(spark, sf_dir)
    live = routes.live_routes(routes.best_bonuses(_bonuses(spark, sf_dir), NOW), lines)
    f = routes.forecast_routes(lines, live)
    return f.select("id", F.col("pos.part").cast("long").alias("part"), F.when(F.col("pos.part") == 1, F.col("pos.at")).alias("rank"), F.col("next.prob").cast("long").alias("prob"))


def ledger_stamps(spark, sf_dir):
    """A day's step after a feed of the routes that begin in a letter up to F: what new entries say of their chances."""
    feed = derive_history(order_windows(spark, sf_dir), [NOW]).filter("id < 'g'").select("id", "p2", "wait")
    active = order_windows(spark, sf_dir, "2-HIGH").groupBy("id", "bank", "code").agg(F.max("pct").alias("pct"), F.max("end").alias("endDate"), F.min("ord").alias("pos"))
    new = ledger.update_ledger(spark.createDataFrame([], ENTRY), active, NOW, previous=feed, as_of=FEED_DAY)
    return new.select("id", F.col("endDate").cast("string").alias("end_date"), "pred.p2", "pred.w1", "pred.absent", F.col("pred.asOf").cast("string").alias("as_of"))


def _entries(spark, sf_dir):
    w = order_windows(spark, sf_dir)
    end = F.when(F.col("ord") % 3 == 0, F.date_sub("start", 1)).when(F.col("ord") % 3 == 1, F.col("end"))
    one = w.select("ord", "id", "bank", "code", "pct", F.col("start").alias("firstSeen"), F.date_add("start", 2).alias("lastSeen"), end.alias("endDate"), F.lit(None).cast("struct<p2:double,w1:double,absent:boolean,asOf:date>").alias("pred"))
    return one.unionByName(one.filter(F.col("ord") % 2 == 0).withColumn("ord", -F.col("ord")))


def ledger_as_history(spark, sf_dir):
    """Entries, some twice, as windows of history that the archive of high orders doesn't cover."""
    w = ledger.ledger_windows(ledger.without_repeats(_entries(spark, sf_dir)), order_windows(spark, sf_dir, "2-HIGH"))
    return w.select("ord", "id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), F.col("s").cast("long").alias("s"))


def fold_directory(spark, sf_dir):
    """Types under several brands and sizes, folded by name, in the order in which people sort."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bank"), F.lit("air").alias("bucket"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("name"), F.when(F.col("p_size") % 3 == 0, "—").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(":1"))).alias("ratio"), F.col("p_partkey").cast("long").alias("ord"))
    return directory.fold_names(p).select("bank", "name", "ratio", "ord")


def partner_rules(spark, sf_dir):
    """Rules broken by partner tables made of nations (banks), suppliers and parts."""
    nation, supplier, part = (table(spark, sf_dir, t) for t in ("nation", "supplier", "part"))
    text = lambda c: F.col(c).cast("string")
    n, s, k = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    lesser = supplier.filter(s % 5 != 0)
    meta = supplier.select(
        text("s_suppkey").alias("code"), F.when(s % 3 == 0, "BRL").when(s % 7 == 0, "EUR").otherwise("USD").alias("currency"), F.when(s % 4 == 0, "26").otherwise("2026-01-01").alias("asOf"),
        F.when(s % 6 == 0, "").otherwise("s").alias("source"), F.lit(None).cast("string").alias("note"), F.when(s % 2 == 0, F.col("s_acctbal")).alias("sourceValue"), F.lit(None).cast("string").alias("sourceCurrency"), F.when(s % 9 != 0, 5.0).alias("fxRate"),
    )
    tables = {
        "banks": nation.select(text("n_nationkey").alias("bank"), F.col("n_name").alias("name"), F.col("n_name").alias("short"), F.lit("#0").alias("bg"), F.when(n % 2 == 0, "#1").alias("fg")),
        "airline_domains": lesser.select(text("s_suppkey").alias("key"), F.when(s % 11 != 0, "x.org").alias("value")),
        "bank_domains": nation.select(text("n_nationkey").alias("key"), F.lit("y.org").alias("value")),
        "values": lesser.select(text("s_suppkey").alias("code"), F.col("s_acctbal").alias("value")),
        "icons": supplier.select(text("s_suppkey").alias("code"), F.when(s % 13 == 0, "http://x").otherwise("https://x").alias("url")),
        "times": part.select((k % 30).cast("string").alias("bank"), F.lit("1").alias("code"), F.when(k % 17 == 0, "").otherwise("1 day").alias("time")),
        "meta": meta,
        "directory": part.select(F.col("p_brand").alias("bank"), F.lit("air").alias("bucket"), F.col("p_type").alias("name"), F.when(k % 19 != 0, "1:1").alias("ratio")),
    }
    return validate.partner_violations(tables)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bonus_table_rows, archive_table_rows, bonus_grid_rows, offer_rows, banner_rows, unpivot_ratio, listed_partners, list_directory, menu_directory, showcase_ids, data_words,
        stated_rates, page_rates, resolved_windows, windows_of_any_pct, live_routes, forecasts_beside_live, ledger_stamps, ledger_as_history, fold_directory, partner_rules,
    )
}
