import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewindow.operators import directory as D
from tidewindow.operators import ledger as L
from tidewindow.operators import routes as R
from tidewindow.operators import validate as V
from tidewindow.plans import publish as P
from tidewindow.sources import listings, rates
from tidewindow.sources.pages import fetch_page, fetched_pages, saved_pages

NOW = date(2026, 7, 24)
TABLE = """<h3>Current and Upcoming Transfer Bonuses</h3><table class="tablepress"><thead><tr><th>From</th><th>Transfer Bonus Details</th><th>S</th><th>E</th></tr></thead>
<tr><td>Amex</td><td><a href="#">30% transfer bonus from Amex to Avianca LifeMiles</a></td><td><p>4</p>07/01/26</td><td><p style="display:none">5</p>07/30/26</td></tr>
<tr><td>Chase</td><td>25% Transfer Bonus from Chase to Hotel Nine</td><td>07/01/26</td><td>07/31/26</td></tr>
<tr><td>Citi</td><td>5,000 bonus points</td><td>07/01/26</td><td>07/31/26</td></tr><tr><td colspan=4>note</td></tr></table>
<h3>Expired bonuses</h3><table class="tablepress"><tr><td>Amex</td><td>20% transfer bonus from Amex to Avianca LifeMiles</td><td>03/01/24</td><td>03/20/24</td></tr>
<tr><td>Amex</td><td>25% transfer bonus from Amex to Avianca LifeMiles</td><td>03/01/25</td><td>03/20/25</td></tr>
<tr><td>Citi</td><td>[Targeted] 25% transfer bonus from Citi to Qantas</td><td>03/01/25</td><td>03/20/25</td></tr>
<tr><td>Citi</td><td>40% transfer bonus from Citi to Qantas</td><td>06/01/25</td><td>06/20/25</td></tr><tr><td>Citi</td><td>40% transfer bonus from Citi to Qantas</td><td>06/01/26</td><td>06/30/26</td></tr></table>"""
GRID = """<h2><span id="Current_Transfer_Bonuses">x</span></h2><div class="transfer-times"><div class="tt-row"><div class="tt-head">h</div></div>
<div class="tt-row"><div class="tt-body"><div class="tt-from">Citi <span class="tt-arrow">to</span></div><div class="tt-to">Qantas<span class="tt-bonus">15% until
 August 22, 2026</span></div></div></div><div class="tt-row"><div class="tt-body"><div class="tt-from">Citi</div><div class="tt-to">KLM</div></div></div></div>"""
OFFERS = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"a": [{"status": {"variations": [
    {"title": "Ganhe", "description": "<b>50%</b> de bônus até 26/07", "button": {"redirectLink": "/x/livelo-para-parceiros/azul-fidelidade/"}, "status": "Vigente"},
    {"title": "40% de bônus ao transferir para o Smiles", "status": "encerrada"}, {"title": "Ao transferir: 80,5% de bônus para a LATAM Pass"}]}, "countdown": {"endDate": "2026-07-31T02:59:00Z"}},
    {"status": {"variations": [{"title": "50% de bônus", "button": {"redirectLink": "/livelo-para-parceiros/azul-fidelidade/"}}]}}]}) + "</script>"
BANNERS = """<a href="/p/azul/e1"><img alt="Ao transferir, 115% de bônus, só até 26/07 a marca da Azul e o botão"></a><img alt="115% de bônus">
<a href="/p/smiles-gol/e2"><div><img alt="Transferência com 90% de bônus. Só até 30/07/26"></div></a><img alt="transferir 90% de bônus">"""


def pages(spark, html):
    return spark.createDataFrame([(0, "http://x", html)], "page bigint, url string, html string")


def parsed(spark, source, html):
    return [(r["bankName"], r["partnerName"], r["pct"], r["endDateRaw"]) for r in source.parse(pages(spark, html)).orderBy("ord").collect()]


def test_sources(spark):
    assert parsed(spark, listings.BONUS_TABLE, TABLE) == [("Amex", "Avianca LifeMiles", 30.0, "07/30/26"), ("Chase", "Hotel Nine", 25.0, "07/31/26")]
    assert [r["startDateRaw"] for r in listings.table_archive(pages(spark, TABLE), "t").orderBy("ord").collect()] == ["03/01/24", "03/01/25", "06/01/25", "06/01/26"]
    assert parsed(spark, listings.BONUS_GRID, GRID) == [("Citi", "Qantas", 15.0, "August 22, 2026")]
    assert parsed(spark, listings.OFFERS, OFFERS) == [("Livelo", "Azul Fidelidade", 50.0, "30/07"), ("Livelo", "LATAM Pass", 80.5, "30/07")]
    assert parsed(spark, listings.BANNERS, BANNERS) == [("Esfera", "Azul", 115.0, "26/07"), ("Esfera", "smiles gol", 90.0, "30/07/26")]
    for s in listings.SOURCES:
        assert parsed(spark, s, None) == parsed(spark, s, "<p>nothing") == parsed(spark, s, '<script id="__NEXT_DATA__">{bad</script>') == []


CHANGE = (
    "Novidades. A partir de 1/Outubro/2026, quem assina o Clube troca 2,2 pontos Esfera por 1 milha Azul. Os demais trocam 2,8 pontos Esfera por 1 milha Azul" + "." * 60
    + " Até 30/Setembro/2026 nada muda. Hoje valem: 2,5 pontos Esfera por 1 milha Azul para todos os clientes, ou 2 pontos Esfera por 1 milha Azul no Clube"
)
RATES = [
    ("1 ponto Livelo = 1 ponto Smiles", "LIV", NOW, "1:1"), ("3,5 pontos Livelo = 1 ponto ALL e 9 pontos Livelo = 1 ponto ALL", "LIV", NOW, "3.5:1"), ("2 pontos Esfera = 1 Avios", "ESF", NOW, "2:1"),
    ('" ponto Esfera =", " pontos Esfera ="', "ESF", NOW, None), ("0 pontos Livelo = 1 ponto X", "LIV", NOW, None), ("1 ponto Livelo = 0 ponto X", "LIV", NOW, None), (None, "ESF", NOW, None),
    (CHANGE, "ESF", date(2026, 7, 25), "2.5:1"), (CHANGE, "ESF", date(2026, 9, 30), "2.5:1"), (CHANGE, "ESF", date(2026, 10, 1), "2.8:1"), (CHANGE, "ESF", date(2027, 6, 1), "2.8:1"),
    ("A partir de 1.Foo.2020: 3 pontos Esfera = 1 Avios; 4 pontos Esfera = 1 Avios", "ESF", NOW, "4:1"), ("4,25 pontos Esfera = 1,333 Avios clube", "ESF", NOW, "4.25:1.33"),
    ("A partir de 1.maio.2020 x A partir de 1.junho.2020: 3 pontos Esfera = 1 Avios", "ESF", NOW, "3:1"), ("1.2.3 pontos Esfera = 1 Avios", "ESF", NOW, None),
]


def test_rates(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(RATES)], "k int, text string, bank string, d date, want string")
    stated = rates.stated_rates(df)
    got = {r["k"]: r["ratio"] for r in rates.standard_ratios(stated.join(df.select("k", "d"), "k"), F.col("d")).collect()}
    assert [got.get(k) for k in range(len(RATES))] == [r[-1] for r in RATES]
    assert {(r["ord"] > 0, str(r["since"])) for r in stated.filter("k = 13").collect()} == {(True, "2020-06-01")}
    assert rates.stated_rates(df.filter("false")).count() == 0


def test_partner_pages(spark):
    data = lambda x: pages(spark, f'<title>TAP Miles&amp;Go | Esfera - x</title><script id="__NEXT_DATA__">{json.dumps(x)}</script>')
    listed = data({"a": {"listPartners": [{"nomeParceiro": "Azul", "redirectUrl": "/azul", "status": "Ativo"}, {"nomeParceiro": "Old", "redirectUrl": "/o", "status": "Inativo"}, {"nomeParceiro": "IHG Hotels", "redirectUrl": "https://y/z"}]}})
    assert [(r["name"], r["url"]) for r in rates.listed_partners(listed).orderBy("ord").collect()] == [("Azul", "https://www.livelo.com.br/azul"), ("IHG Hotels", "https://y/z")]
    assert {(r["bucket"], r["name"]) for r in D.list_directory(listed).collect()} == {("air", "Azul Fidelidade"), ("hotel", "IHG One Rewards")}
    show = data([{"showcaseProductsId": "e000000001, e000000002,x"}, {"b": {"showcaseProductsId": "e000000002"}}])
    assert [r["id"] for r in rates.showcase_ids(show).collect()] == ["e000000001", "e000000002"]
    assert rates.page_partner(F.col("html")) is not None and show.select(rates.page_partner(F.col("html"))).first()[0] == "TAP Miles&Go"
    menu = data({"mainItemLabel": {"title": "Parceiros Nacionais"}, "groupMenuItemsLinks": [{"menuLink": {"title": "Smiles", "href": "/p/s/1"}}, {"menuLink": {"title": "Ver mais", "href": "/q"}}, {"menuLink": {"title": "Dotz", "href": "/p/d"}}]})
    assert [r["name"] for r in D.menu_directory(menu).collect()] == ["Smiles (GOL)"]


def directory(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "bank string, bucket string, name string, ratio string, ord bigint")


def listed(df):
    return [(r["bank"], r["name"], r["ratio"]) for r in df.orderBy("bank", "bucket", "ord").collect()]


def test_directory(spark):
    html = """<table class="tablepress"><thead><tr><th>Rewards Program</th><th>Amex Transfer Ratio</th><th>Chase</th></tr></thead><tbody>
<tr><td>Avianca</td><td>1,000 to 800</td><td></td></tr><tr><td>Hilton</td><td></td><td>1 to 2</td></tr><tr><td>Dotz</td><td>1 to 1</td></tr><tr><td>LifeMiles</td><td>1 to 1</td></tr></tbody></table>
<table class="tablepress"><thead><tr><th>Rewards Program</th><th>Indirect Transfer Ratio</th></tr></thead><tbody><tr><td>Qantas</td><td>1 to 1</td></tr></tbody></table>"""
    assert {(r["bank"], r["bucket"], r["name"], r["ratio"]) for r in D.table_directory(pages(spark, html)).collect()} == {("AMEX", "air", "Avianca LifeMiles", "1000:800"), ("CHASE", "hotel", "Hilton Honors", "1:2")}
    curated = directory(spark, [("LIV", "air", "Smiles", "2:1"), ("LIV", "air", "TAP", "3:1"), ("AMEX", "air", "Delta SkyMiles", "1:1")])
    scraped = directory(spark, [("LIV", "air", "Smiles (GOL)", "—"), ("LIV", "air", "Azul Fidelidade", "—"), ("NEW", "air", "x", "1:1")])
    assert listed(D.merge_directory(curated, scraped)) == [("AMEX", "Delta SkyMiles", "1:1"), ("LIV", "Azul Fidelidade", "—"), ("LIV", "Smiles (GOL)", "2:1")]
    folded = D.fold_names(directory(spark, [("LIV", "air", "Smiles", "—"), ("LIV", "air", "GOL", "3:1"), ("LIV", "air", "Smiles (GOL)", "2:1")]))
    assert listed(folded) == [("LIV", "Smiles (GOL)", "3:1")]
    seen = spark.createDataFrame([("LIV", "Smiles (GOL)", "9:1", 0), ("LIV", "Smiles (GOL)", "10:1", 1), ("LIV", "Hilton Honors", None, 2)], "bank string, name string, ratio string, ord int")
    assert {(r["name"], r["bucket"], r["ratio"], r["change"]) for r in D.upsert_rates(folded, seen).collect()} == {("Smiles (GOL)", "air", "10:1", "updated"), ("Hilton Honors", "hotel", "—", "added")}
    last = seen.withColumn("ratio", F.when(F.col("ord") == 0, F.col("ratio")))  # the last page states none: what is known stays
    assert {(r["name"], r["ratio"], r["change"]) for r in D.upsert_rates(folded, last).collect()} == {("Smiles (GOL)", "3:1", None), ("Hilton Honors", "—", "added")}


ENTRY_ROWS = [(0, "liv-ad", "LIV", "AD", 115.0, date(2026, 8, 1), date(2026, 8, 1), date(2026, 8, 10), None)]
ACTIVE = "id string, bank string, code string, pct double, endDate date, pos bigint"


@pytest.mark.parametrize(
    ("day", "pct", "end", "rows"),
    [
        (date(2026, 8, 4), 120.0, date(2026, 8, 20), [(120.0, date(2026, 8, 1), date(2026, 8, 4), date(2026, 8, 20))]),
        (date(2026, 8, 4), 100.0, None, [(115.0, date(2026, 8, 1), date(2026, 8, 4), date(2026, 8, 10))]),
        (date(2026, 8, 9), 120.0, None, [(115.0, date(2026, 8, 1), date(2026, 8, 1), date(2026, 8, 10)), (120.0, date(2026, 8, 9), date(2026, 8, 9), None)]),
    ],
)
def test_ledger_step(spark, day, pct, end, rows):
    old, new = spark.createDataFrame(ENTRY_ROWS, L.ENTRY), spark.createDataFrame([("liv-ad", "LIV", "AD", pct, end, 0)], ACTIVE)
    got = L.update_ledger(old, new, day).orderBy("ord").collect()
    assert [(r["pct"], r["firstSeen"], r["lastSeen"], r["endDate"]) for r in got] == rows
    assert all(r["pred"] is None for r in got)


def test_stamps(spark):
    previous = spark.createDataFrame([("liv-ad", [0.1] * 7 + [0.8] + [0.1] * 4, [0.2, 0.3, 0.4]), ("liv-g3", None, None)], "id string, p2 array<double>, wait array<double>")
    active = spark.createDataFrame([(x, "LIV", x[4:].upper(), 50.0, None, k) for k, x in enumerate(("liv-ad", "liv-g3", "liv-la"))], ACTIVE)
    got = L.update_ledger(spark.createDataFrame([], L.ENTRY), active, date(2026, 8, 4), previous=previous, as_of=date(2026, 8, 3)).orderBy("ord").collect()
    doc = P.ledger_json(got)["windows"]
    assert [w["pred"] for w in doc] == [{"p2": 0.8, "w1": 0.2, "asOf": "2026-08-03"}, {"p2": None, "w1": None, "asOf": "2026-08-03"}, {"absent": True, "asOf": "2026-08-03"}]
    repeated = spark.createDataFrame([(k, *ENTRY_ROWS[0][1:]) for k in range(3)], L.ENTRY)
    assert [r["ord"] for r in L.without_repeats(repeated).collect()] == [0]


SEEN = [("a", 1, 10.0, None), ("a", 8, 20.0, None), ("a", 16, 5.0, 18), ("a", 18, 5.0, None), ("a", 19, 7.0, None), ("b", 3, 1.0, 2), ("b", 4, 1.0, None)]
FOLDED = {("a", 1, 8, 20.0, None), ("a", 16, 18, 5.0, 18), ("a", 19, 19, 7.0, None), ("b", 3, 3, 1.0, 2), ("b", 4, 4, 1.0, None)}


def sightings(spark):
    d = lambda n: n and date(2026, 1, n)
    return spark.createDataFrame([(i, d(a), p, d(e)) for i, a, p, e in SEEN], "id string, day date, pct double, endDate date")


def test_replay(spark):
    got = {(r["id"], r["firstSeen"].day, r["lastSeen"].day, r["pct"], r["endDate"] and r["endDate"].day) for r in L.replay(sightings(spark)).collect()}
    assert got == FOLDED
    runs = {(r["id"], r["firstSeen"].day, r["lastSeen"].day) for r in L.runs_of_days(sightings(spark)).collect()}
    assert runs == {("a", 1, 8), ("a", 16, 19), ("b", 3, 4)}


def sequential(days, gap):
    """Entries of one route from its days (day, pct, endDate), each step as the ledger's."""
    entries = []
    for day, pct, end in sorted(days):
        e = next((e for e in entries if (day - e[1]).days <= gap and not (e[3] and e[3] < day)), None)
        if e is None:
            entries.append([day, day, pct, end])
        else:
            e[1], e[2], e[3] = day, max(e[2], pct), end or e[3]
    return entries


@pytest.mark.parametrize("gap", [1, 3])
def test_replay_is_that_of_single_days_without_python_workers(spark, gap):
    import random

    draw = random.Random(5)
    d = lambda n: date(2026, 1, 1) + timedelta(days=n)
    routes = {f"r{k}": [(d(n), float(draw.randrange(9)), d(n + draw.randrange(-2, 5)) if draw.random() < 0.4 else None) for n in range(40) if draw.random() < 0.6] for k in range(60)}
    rows = L.replay(spark.createDataFrame([(i, *x) for i, days in routes.items() for x in days], "id string, day date, pct double, endDate date"), gap=gap)
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(str((i, *e)) for i, days in routes.items() for e in sequential(days, gap))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_best_bonus_and_unmapped(spark):
    raw = [("Amex", "Avianca", 20.0, "07/30/26", "u1"), ("Amex", "LifeMiles", 25.0, "", "u2"), ("Amex", "Avianca", 25.0, "07/31/26", "u3"), ("PAYBACK", "Foo", 1.0, "", "u4"), ("Amex", "Foo", 1.0, "", "u5")]
    df = R.resolve_bonuses(spark.createDataFrame([(k, *r) for k, r in enumerate(raw)], "ord bigint, bankName string, partnerName string, pct double, endDateRaw string, sourceUrl string"))
    best = R.best_bonuses(df, NOW).collect()
    assert [(r["id"], r["pct"], r["endDate"], r["urls"]) for r in best] == [("amex-av", 25.0, None, ["u1", "u2", "u3"])]
    assert [r["reason"] for r in R.unmapped(df).orderBy("ord").collect()] == ['unknown bank "PAYBACK"', 'unknown partner "Foo"']


def given(spark, **other):
    return {"table": pages(spark, TABLE), "grid": pages(spark, GRID), "offers": pages(spark, OFFERS), "banners": pages(spark, BANNERS)} | other


AT = datetime(2026, 7, 24, 12, tzinfo=timezone.utc)


def test_publish(spark, tmp_path):
    ledger = str(tmp_path / "ledger.json")
    out = P.publish(spark, given(spark), str(tmp_path), AT, ledger_path=ledger)
    assert out.ok and out.counts == {"table": 2, "grid": 1, "offers": 2, "banners": 2} and out.unmapped == ["Hotel Nine"]
    feed = json.loads((tmp_path / "feed.json").read_text())
    assert [r["id"] for r in feed["routes"]] == ["amex-av", "citi-qf", "liv-ad", "liv-la", "esf-ad", "esf-g3"]
    live = {r["id"]: r for r in feed["routes"]}
    assert live["amex-av"]["active"] == {"pct": 30, "endDate": "2026-07-30"} and "wait" not in live["liv-ad"] and live["liv-ad"]["mp"] == [0] * 12
    entries = json.loads((tmp_path / "ledger.json").read_text())["windows"]
    assert len(entries) == 6 and all("pred" not in e for e in entries)
    # a failed source: its routes stay; too many: nothing changes
    again = P.publish(spark, given(spark, banners=None), str(tmp_path), AT, ledger_path=ledger)
    assert again.ok and again.filled == 2 and {r["id"] for r in again.routes} == set(live)
    before = (tmp_path / "feed.json").read_bytes()
    bad = P.publish(spark, given(spark, banners=None, grid=None, offers=pages(spark, "x")), str(tmp_path), AT, ledger_path=ledger)
    assert not bad.ok and len(bad.failed) == 3 and (tmp_path / "feed.json").read_bytes() == before


def test_publish_with_a_ledger_table(spark, tmp_path):
    """The same entries as in a document; a page that fails its parser fails its source alone."""

    class Broken:
        id = "grid"

        def parse(self, pages):
            return listings.BONUS_GRID.parse(pages).withColumn("pct", F.raise_error(F.lit("broken page")).cast("double"))

    path = str(tmp_path / "ledger")
    sources = tuple(Broken() if s.id == "grid" else s for s in listings.SOURCES)
    out = P.publish(spark, given(spark), str(tmp_path), AT, ledger_path=path, sources=sources)
    assert out.ok and out.failed == ["grid"] and "broken page" in out.reason and out.counts == {"table": 2, "grid": 0, "offers": 2, "banners": 2}
    usable, entries = P.read_ledger(spark, path)
    assert usable and {r["id"] for r in entries.collect()} == {r["id"] for r in out.routes if "active" in r} and out.missing.count() == 1


def test_pages_saved_and_fetched(spark, tmp_path):
    (tmp_path / "table.html").write_text(TABLE, encoding="utf-8")
    (tmp_path / "grid.html").write_text("é", encoding="utf-8")
    got = saved_pages(spark, str(tmp_path), ["table", "grid", "offers"])
    assert got["offers"] is None and got["grid"].first()["html"] == "é" and got["grid"].columns == ["page", "url", "html"]
    assert listings.BONUS_TABLE.parse(got["table"]).count() == 2
    waits, answers = [], iter([OSError("down"), "shell", "page"])

    def read(url, timeout):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert fetch_page("u", usable=lambda h: h == "page", read=read, sleep=waits.append) == "page" and waits == [1.5, 3.0]
    with pytest.raises(ValueError, match="not usable"):
        fetch_page("u", usable=lambda h: False, read=lambda u, t: "x", sleep=waits.append)
    answers = iter(["a", OSError(), OSError()])
    both = fetched_pages(spark, {"one": "u1", "two": "u2"}, tries=2, read=read, sleep=waits.append)
    assert both["one"].first()["html"] == "a" and both["two"] is None


def test_cliff_and_broken_ledger(spark, tmp_path):
    routes = [{"id": f"x-{k}", "bank": "X", "code": "Y", "airline": "y", "time": "—", "typical": "—", "mp": [0.0] * 12, "hist": []} for k in range(40)]
    (tmp_path / "feed.json").write_text(json.dumps({"version": 1, "generatedAt": "2026-07-23T00:00:00.000Z", "routes": routes}))
    (tmp_path / "ledger.json").write_text("{broken")
    before = (tmp_path / "feed.json").read_bytes()
    out = P.publish(spark, given(spark), str(tmp_path), AT, ledger_path=str(tmp_path / "ledger.json"))
    assert not out.ok and "fell" in out.reason and (tmp_path / "feed.json").read_bytes() == before and (tmp_path / "ledger.json").read_text() == "{broken"


def test_rules(spark):
    row = {"id": "a", "bank": "B", "airline": "x", "code": "C", "time": None, "typical": "t", "mp": [0.1] * 11, "p2": None, "wait": [0.3, 0.2, 0.4], "active": {"pct": 1.0, "endDate": NOW}, "ended": {"pct": 1.0, "endedAt": NOW}, "next": {"label": "l", "prob": 101}, "hist": []}
    got = {r["rule"] for r in V.feed_violations(spark.createDataFrame([row], P.ROUTE)).collect()}
    assert got == {"time missing", "mp length", "wait falls", "active and ended", "next prob"}
    keys = spark.createDataFrame([("r", '{"id": 1, "zz": 2}'), ("s", None)], "subject string, json string")
    assert {(r["subject"], r["rule"]) for r in V.key_violations(keys, ("id",), ("id", "bank")).collect()} == {("r", "unknown key zz"), ("s", "missing key id")}
    doc = {"banks": {"A": {"name": "a", "short": "a", "bg": "b", "fg": None}}, "airlineDomains": {"X": "x.com"}, "bankDomains": {"A": "a.com"}, "airlineValues": {"X": 1.0}, "airlineIconUrls": {"X": "http://x", "Q": "https://q"}, "transferTimes": {"A": {"X": ""}, "Z": {"X": "1"}}, "airlineValueMeta": {"X": {"currency": "BRL", "asOf": "2026-01-01", "source": "s"}, "Y": {"currency": "USD", "asOf": "26", "source": ""}}, "directory": {"A": {"air": [["n", None]], "hotel": []}}}
    got = {(r["subject"], r["rule"]) for r in V.partner_violations(P.partner_tables(spark, doc)).collect()}
    assert got == {("A", "bank fg missing"), ("X", "icon not https"), ("Q", "icon of unknown code"), ("A.X", "time empty"), ("Z", "time of unknown bank"), ("X", "BRL without rate"), ("Y", "asOf"), ("Y", "source empty"), ("Y", "meta without value"), ("A.air", "tuple")}


def test_refresh_and_document_check(spark, tmp_path):
    from tidewindow.plans.refresh import changed, document_violations, refresh_directory, write_refreshed

    rows = directory(spark, [("ESF", "air", "Smiles", "2:1"), ("ESF", "air", "TAP Miles&Go", "—")])
    rate = lambda n: f"<p>{n} pontos Esfera = 1 milha</p>"
    html = [("ESF", None, f"<title>Smiles | Esfera</title>{rate(3)}"), ("ESF", None, f"<title>Esfera</title>{rate(9)}"), ("ESF", "Hilton", "<p>none</p>"), ("ESF", "Dotz", rate(1))]
    kind = "page bigint, bank string, name string, html string"
    read = spark.createDataFrame([(k, *r) for k, r in enumerate(html)], kind)
    got = refresh_directory(rows, read, NOW)
    assert {(r["name"], r["ratio"], r["change"]) for r in got.collect()} == {("Smiles (GOL)", "3:1", "updated"), ("TAP Miles&Go", "—", None), ("Hilton Honors", "—", "added")}
    assert changed(got) and not changed(refresh_directory(rows, read.filter("false"), NOW))
    path = str(tmp_path / "partners.json")
    P.write_json({"banks": {}, "directory": {"ESF": {"air": [["Smiles", "2:1"], ["TAP Miles&Go", "—"]], "hotel": []}}}, path)
    before = P.read_json(path)
    assert len(write_refreshed(spark, path, read, NOW, dry=True)) == 2 and P.read_json(path) == before
    assert [r["name"] for r in write_refreshed(spark, path, read, NOW)] == ["Hilton Honors", "Smiles (GOL)"]
    assert P.read_json(path) == {"banks": {}, "directory": {"ESF": {"air": [["Smiles (GOL)", "3:1"], ["TAP Miles&Go", "—"]], "hotel": [["Hilton Honors", "—"]]}}}
    assert write_refreshed(spark, path, read, NOW) == []
    route = {"id": "a", "bank": "B", "airline": "x", "code": "C", "time": "t", "typical": "t", "mp": [0.1] * 12, "hist": []}
    check = lambda doc: {(r["subject"], r["rule"]) for r in document_violations(spark, json.dumps(doc)).collect()}
    assert check({"version": 1, "generatedAt": "x", "routes": [route]}) == set()
    assert check({"version": 1, "routes": [route | {"zz": 1}], "x": 1}) == {("feed", "missing key generatedAt"), ("feed", "unknown key x"), ("routes[0]", "unknown key zz")}
    assert document_violations(spark, "[]").count() == 1
