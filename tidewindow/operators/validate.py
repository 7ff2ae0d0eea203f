"""Rules for what is published, as violation rows ``subject, rule``; no rows: valid.

Typed tables can't hold a wrong type or an unknown key, so those two rules read the raw
JSON (:func:`key_violations`); all others are one boolean column a rule, or an anti-join
for each reference from one table to another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED_KEYS = ("version", "generatedAt", "routes")
ROUTE_NEEDED = ("id", "bank", "airline", "code", "time", "typical", "mp", "hist")
ROUTE_KEYS = (*ROUTE_NEEDED, "p2", "wait", "active", "ended", "next", "summary")
SLACK = 1e-9


def _listed(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a rule whose column is null is not broken."""
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    return rows.select(subject.alias("subject"), F.explode(broken).alias("rule"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_violations(objects: DataFrame, needed: tuple[str, ...], allowed: tuple[str, ...], *, subject: str = "subject", json: str = "json") -> DataFrame:
    """Missing and unknown keys of JSON objects (columns ``subject``, ``json``)."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, needed)), keys), lambda k: F.concat(F.lit("missing key "), k))
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, allowed))), lambda k: F.concat(F.lit("unknown key "), k))
    return objects.select(F.col(subject).alias("subject"), F.explode(F.concat(missing, unknown)).alias("rule"))


def _probabilities(name: str, size: int) -> dict[str, Column]:
    c = F.col(name)
    return {f"{name} length": F.size(c) != size, f"{name} range": F.exists(c, lambda v: v.isNull() | (v < 0) | (v > 1))}


def feed_violations(routes: DataFrame) -> DataFrame:
    """Violations of typed routes."""
    rules = {f"{k} missing": F.col(k).isNull() for k in ROUTE_NEEDED}
    rules |= _probabilities("mp", 12) | _probabilities("p2", 12) | _probabilities("wait", 3)
    w = F.col("wait")
    rules |= {
        "wait falls": (F.size(w) == 3) & ((F.get(w, F.lit(0)) > F.get(w, F.lit(1)) + SLACK) | (F.get(w, F.lit(1)) > F.get(w, F.lit(2)) + SLACK)),
        "hist incomplete": F.exists("hist", lambda h: h["w"].isNull() | h["pct"].isNull() | h["len"].isNull()),
        "active incomplete": F.col("active").isNotNull() & (F.col("active.pct").isNull() | F.col("active.endDate").isNull()),
        "ended incomplete": F.col("ended").isNotNull() & (F.col("ended.pct").isNull() | F.col("ended.endedAt").isNull()),
        "active and ended": F.col("active").isNotNull() & F.col("ended").isNotNull(),
        "next label": F.col("next").isNotNull() & F.col("next.label").isNull(),
        "next prob": F.col("next").isNotNull() & ~F.coalesce(F.col("next.prob").between(0, 100), F.lit(False)),
    }
    return _listed(routes, F.coalesce("id", F.lit("")), rules)


def unknown_routes(routes: DataFrame, banks: DataFrame, codes: DataFrame) -> DataFrame:
    """Warnings: routes whose bank or code the partner tables lack."""
    bank = routes.join(banks, "bank", "left_anti").select(F.col("id").alias("subject"), F.lit("unknown bank").alias("rule"))
    return bank.unionByName(routes.join(codes, "code", "left_anti").select(F.col("id").alias("subject"), F.lit("unknown code").alias("rule")))


def partner_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of the partner tables.

    ``banks`` (bank, name, short, bg, fg), ``airline_domains`` and ``bank_domains`` (key, value),
    ``values`` (code, value), ``icons`` (code, url), ``times`` (bank, code, time), ``meta`` (code,
    currency, asOf, source, note, sourceValue, sourceCurrency, fxRate) and ``directory`` (bank, bucket, name, ratio).
    """
    t = tables
    parts = [_listed(t["banks"], F.col("bank"), {f"bank {k} missing": F.col(k).isNull() for k in ("name", "short", "bg", "fg")})]
    for name in ("airline_domains", "bank_domains"):
        parts.append(_listed(t[name], F.col("key"), {f"{name} value": F.col("value").isNull()}))
    parts.append(_listed(t["values"], F.col("code"), {"value missing": F.col("value").isNull() | F.isnan("value")}))
    parts.append(_listed(t["icons"], F.col("code"), {"icon not https": ~F.coalesce(F.col("url").startswith("https://"), F.lit(False))}))
    parts.append(_listed(t["times"], F.concat_ws(".", "bank", "code"), {"time empty": F.coalesce("time", F.lit("")) == ""}))
    positive = lambda c: F.col(c).isNotNull() & ~(F.col(c) > 0)
    currency = lambda c: ~F.col(c).isin("USD", "BRL")
    parts.append(_listed(t["meta"], F.col("code"), {
        "currency": F.coalesce(currency("currency"), F.lit(True)), "asOf": ~F.coalesce(F.col("asOf").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "source empty": F.coalesce("source", F.lit("")) == "", "note empty": F.col("note") == "", "sourceValue": positive("sourceValue"), "fxRate": positive("fxRate"),
        "sourceCurrency": currency("sourceCurrency"), "BRL without rate": (F.col("currency") == "BRL") & (F.col("sourceValue").isNull() | F.col("fxRate").isNull()),
    }))
    parts.append(_listed(t["directory"], F.concat_ws(".", "bank", "bucket"), {"tuple": F.col("name").isNull() | F.col("ratio").isNull()}))
    domains = t["airline_domains"].select(F.col("key").alias("code"))
    for name, other, on, rule in (
        ("icons", domains, "code", "icon of unknown code"), ("times", t["banks"].select("bank"), "bank", "time of unknown bank"),
        ("times", domains, "code", "time of unknown code"), ("meta", t["values"].select("code"), "code", "meta without value"),
    ):
        parts.append(t[name].join(other, on, "left_anti").select(F.col(on).alias("subject"), F.lit(rule).alias("rule")).distinct())
    return _union(parts)
