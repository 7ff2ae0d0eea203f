from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewindow.functions.dates import deadline_day, length_label, parse_end_date, parse_mdy, window_label
from tidewindow.functions.names import BANK_ALIASES, PARTNER_ALIASES, alias_map, alias_table, display_name, name_candidates, resolve_by_join, resolved
from tidewindow.functions.numbers import plain, round3, uniform_draw


def values(spark, rows, expression):
    """``expression`` of column x over each of ``rows``."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r["y"] for r in df.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_parse_mdy(spark):
    got = values(spark, ["06/14/26", "6/1/2026", "02/30/26", "sometime", None, " 7/4/26 ", "13/01/26"], parse_mdy)
    assert got == [date(2026, 6, 14), date(2026, 6, 1), None, None, None, date(2026, 7, 4), None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("July 25, 2026", "2026-07-25"), ("7/25/26", "2026-07-25"), ("25/07", "2026-07-25"), ("until Jul 25", "2026-07-25"), ("Aug. 5, 2026", "2026-08-05"),
        ("01/03", "2027-03-01"), ("Jun 1", "2026-06-01"), ("May 31", "2027-05-31"), ("31/02", None), ("Foo 5, 2026", None), ("Foo 05", None), ("", None), (None, None), ("31/13", None),
    ],
)
def test_parse_end_date(spark, raw, want):
    got = values(spark, [raw], lambda x: parse_end_date(x, F.lit(date(2026, 6, 1))).cast("string"))
    assert got == [want]


def test_day_first_dates(spark):
    assert values(spark, ["5/7/26"], lambda x: parse_end_date(x, F.lit(date(2026, 6, 1)), day_first=F.lit(True)).cast("string")) == ["2026-07-05"]


def test_deadline_day(spark):
    assert values(spark, ["2026-07-26", "2026-07-26T02:59:59Z", "soon", ""], deadline_day) == ["26/07", "25/07", "", ""]


def test_labels(spark):
    row = spark.range(1).select(window_label(F.lit(date(2026, 6, 14))).alias("w"), length_label(F.lit(date(2026, 6, 14)), F.lit(date(2026, 7, 18))).alias("a"), length_label(F.lit(date(2026, 6, 1)), F.lit(date(2026, 6, 1))).alias("b")).first()
    assert tuple(row) == ("JUN 2026", "35 days", "1 day")


NAMES = ["Air France / KLM Flying Blue", "Smiles (GOL)", "LATAM - Latam Pass", "Aeroméxico", "Turkish Airlines Miles & Smiles", "TAP Miles&Go", "AV", "Japan Airlines (JAL Mileage Bank)"]
CODES = ["AF", "G3", "LA", "AM", "TK", "TP", "AV", "JL"]
REFUSED = ["Avios", "Marriott Bonvoy", "IHG", "", None, "Foo (Bar)"]


def test_partners_resolve(spark):
    codes = alias_map(spark, PARTNER_ALIASES)
    assert values(spark, NAMES, lambda x: resolved(x, codes)) == CODES
    assert values(spark, REFUSED, lambda x: resolved(x, codes)) == [None] * len(REFUSED)


def test_banks_resolve(spark):
    codes = alias_map(spark, BANK_ALIASES)
    assert values(spark, ["Amex Membership Rewards", "Citibank (ThankYou Rewards)", "PAYBACK", "Capital One"], lambda x: resolved(x, codes)) == ["AMEX", "CITI", None, "C1"]


def test_lookup_by_join_agrees(spark):
    df = spark.createDataFrame(list(enumerate(NAMES + REFUSED)), "k int, name string")
    got = resolve_by_join(df, "name", alias_table(spark, PARTNER_ALIASES), "code", "k").orderBy("k").collect()
    assert [r["code"] for r in got] == CODES + [None] * len(REFUSED)


def test_candidates(spark):
    assert values(spark, ["A (B)", "a - B c", " x ", None], name_candidates) == [["a", "b"], ["a b c", "a", "b c"], ["x"], []]


def test_display_names(spark):
    assert values(spark, ["AV", "ZZ", "9W"], display_name) == ["Avianca LifeMiles", "ZZ", "Jet Airways InterMiles"]


def test_numbers(spark):
    row = spark.range(1).select(round3(F.lit(0.0005)).alias("a"), round3(F.lit(0.1234)).alias("b"), plain(F.lit(25.0)).alias("c"), plain(F.lit(12.5)).alias("d")).first()
    assert tuple(row) == (0.001, 0.123, "25", "12.5")


def mulberry32(seed):
    while True:
        seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((seed ^ seed >> 15) * (seed | 1)) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF) ^ t
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def test_draws_are_those_of_the_sequential_generator(spark):
    got = [r["u"] for r in spark.range(1, 2001).select("id", uniform_draw(42, F.col("id")).alias("u")).orderBy("id").collect()]
    draws = mulberry32(42)
    assert got[:3] == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]
    assert got == [next(draws) for _ in got]


def test_norm_strips_the_marks_of_every_character(spark):
    """Against the decomposition of each code point, composed and decomposed alike."""
    import re
    import sys
    import unicodedata

    from tidewindow.functions.names import norm

    chars = [chr(c) for c in range(0xA1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    some = [c for c in chars if unicodedata.normalize("NFD", c) != c and unicodedata.category(c) != "Mn" and c == c.lower()]
    some = [c for c in some if sum(unicodedata.category(x) != "Mn" for x in unicodedata.normalize("NFD", c)) == 1]
    assert len(some) > 1000
    rows = spark.createDataFrame([(k, f"a{c}b", unicodedata.normalize("NFD", f"a{c}b")) for k, c in enumerate(some)], "k int, composed string, parts string")
    got = rows.select("k", norm(F.col("composed")).alias("composed"), norm(F.col("parts")).alias("parts")).collect()
    strip = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    assert not [some[r["k"]] for r in got if r["composed"] != r["parts"]]
    wrong = [some[r["k"]] for r in got if r["composed"] != re.sub(r"\s+", " ", re.sub(r"[/&.,()-]", " ", f"a{strip(some[r['k']])}b"))]
    assert not wrong, wrong[:20]
    names = spark.createDataFrame([("Vi\u1ec7t \u01cd \u0218",)], "n string")
    assert names.select(norm(F.col("n"))).first()[0] == "viet a s"
