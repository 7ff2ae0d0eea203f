"""From listing pages to a published feed and partner document, with fail-safes.

One run: parse each source; stop if more than half failed; add the ledger's windows that
the archive does not cover to history; build routes; fold today's live routes into the
ledger; fill in previous routes if a source failed; stop on a cliff in the number of
routes; validate; write. All sources are read in one job and its rows written; guards look at
counts of those. What is published is one document of at most a few routes a bank and
partner, so it alone is collected, to be written at once; a ledger in a folder is a
versioned table (:mod:`tidewindow.plans.ledger_table`) and never comes to the driver, one in
a ``.json`` file is a document as the feed is.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions.shared import written
from tidewindow.operators.directory import merge_directory
from tidewindow.operators.forecast import derive_history, history_lines
from tidewindow.operators.guards import MOST_FAILED, source_report, verdict
from tidewindow.operators.ledger import ENTRY, ledger_windows, update_ledger, without_repeats
from tidewindow.operators.routes import FIELDS, all_routes, stale_fill
from tidewindow.operators.validate import feed_violations
from tidewindow.operators.windows import resolve_windows
from tidewindow.plans import ledger_table
from tidewindow.sources.listings import SOURCES, Source, table_archive

#: Names of unmapped partners and banks in a run's outcome, a report; all of them are in its table.
REPORTED = 100
RAW_BONUS = "ord bigint, source string, bankName string, partnerName string, pct double, endDateRaw string, sourceUrl string"
RAW_WINDOW = "ord bigint, source string, bankName string, partnerName string, pct double, startDateRaw string, endDateRaw string"
ROUTE = (
    "id string, bank string, airline string, code string, time string, typical string, mp array<double>, p2 array<double>, wait array<double>, "
    "active struct<pct:double,endDate:date>, ended struct<pct:double,endedAt:date>, next struct<label:string,prob:int>, hist array<struct<w:string,pct:double,len:string>>"
)


@dataclass
class Outcome:
    ok: bool
    reason: str = ""
    routes: list[dict] = field(default_factory=list)
    unmapped: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)
    filled: int = 0
    missing: DataFrame | None = None
    """All rows whose bank or partner is not known."""


def plain(value):
    """A row as JSON values: absent where null, numbers without a needless fraction, dates as text."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value.isoformat() if isinstance(value, date) else value


def write_json(doc: dict, path: str) -> None:
    """Written beside the target first, then moved over it, so that no reader meets half a document."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(f"{path}.new", path)


def read_json(path: str) -> dict | None:
    """The document, or None if there is none that can be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def read_ledger(spark: SparkSession, path: str | None) -> tuple[bool, DataFrame]:
    """(usable, entries). No file: usable and empty; a file that can't be read or has no windows: not to be used or replaced."""
    empty = spark.createDataFrame([], ENTRY)
    if path is None:
        return False, empty
    if not path.endswith(".json"):
        return ledger_table.read_entries(spark, path)
    if not os.path.exists(path):
        return True, empty
    doc = read_json(path)
    if not isinstance(doc, dict) or not isinstance(doc.get("windows"), list):
        return False, empty
    day = lambda x: date.fromisoformat(x) if x else None
    pred = lambda p: p and {"p2": p.get("p2"), "w1": p.get("w1"), "absent": p.get("absent"), "asOf": day(p.get("asOf"))}
    rows = [(k, w["id"], w["bank"], w["code"], float(w["pct"]), day(w["firstSeen"]), day(w["lastSeen"]), day(w.get("endDate")), pred(w.get("pred"))) for k, w in enumerate(doc["windows"])]
    return True, spark.createDataFrame(rows, ENTRY)


def ledger_json(rows: list) -> dict:
    """Entries in their order; within ``pred`` a missing number is an explicit null unless the route was absent."""
    windows = []
    for r in rows:
        entry = {k: v for k, v in plain(r).items() if k not in ("ord", "pred")}
        if r["pred"] is not None:
            p = r["pred"]
            entry["pred"] = ({"absent": True} if p["absent"] else {"p2": p["p2"], "w1": p["w1"]}) | {"asOf": p["asOf"].isoformat()}
        windows.append(entry)
    return {"version": 1, "windows": windows}


def _routes(spark: SparkSession, doc: dict | None) -> DataFrame | None:
    if doc is None:
        return None
    lines = [json.dumps(r) for r in doc.get("routes", [])]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k bigint, r string")
    return rows.select("k", F.from_json("r", ROUTE).alias("r")).select("r.*", F.struct(F.lit(0).alias("part"), F.col("k").alias("at")).alias("pos"))


def raw_bonuses(spark: SparkSession, pages: dict[str, DataFrame | None], sources: tuple[Source, ...]) -> tuple[DataFrame, str]:
    """Rows of all sources, written once, and what went wrong. If the job fails, each source is read by itself, and one that fails gives no rows."""
    parsed = {s.id: s.parse(pages[s.id]).withColumns({"ord": F.col("ord") + (k << 50), "source": F.lit(s.id)}) for k, s in enumerate(sources) if pages.get(s.id) is not None}
    none = spark.createDataFrame([], RAW_BONUS)
    try:
        return written(reduce(DataFrame.unionByName, parsed.values(), none), "raw-bonuses"), ""
    except Exception:  # a page that can't be parsed fails its source, never the run
        found, why = [none], []
        for name, rows in parsed.items():
            try:
                found.append(written(rows, "raw-bonuses"))
            except Exception as e:
                why.append(f"{name}: {e}")
        return reduce(DataFrame.unionByName, found), "; ".join(why)


def publish(spark: SparkSession, pages: dict[str, DataFrame | None], out_dir: str, now: datetime, **options) -> Outcome:
    """Runs :func:`run_publish`, and lets go of what it holds in memory."""
    held: list[DataFrame] = []
    try:
        return run_publish(spark, pages, out_dir, now, held, **options)
    finally:
        for df in held:
            df.unpersist()


def run_publish(
    spark: SparkSession, pages: dict[str, DataFrame | None], out_dir: str, now: datetime, held: list[DataFrame], *, sources: tuple[Source, ...] = SOURCES,
    ledger_path: str | None = None, times: DataFrame | None = None, curated: DataFrame | None = None, scraped: list[DataFrame] | None = None, partners: dict | None = None, compat: bool = False,
) -> Outcome:
    """``pages``: for each source id its pages (page, url, html), or None if they could not be had.

    ``compat`` keeps repeated ledger entries and waits as they come; by default entries that
    differ only in their ``pred`` count once, and waits never fall.
    """
    today = now.astimezone(timezone.utc).date()
    out = Outcome(True)
    raw, out.reason = raw_bonuses(spark, pages, sources)
    report = source_report(raw, [s.id for s in sources])
    counts = {r["source"]: r for r in report.collect()}  # a row a source
    out.counts, out.failed = {s.id: counts[s.id]["entries"] for s in sources}, [s.id for s in sources if counts[s.id]["failed"]]
    if len(out.failed) > MOST_FAILED * len(sources):
        return Outcome(False, f"{len(out.failed)} of {len(sources)} sources failed", counts=out.counts, failed=out.failed)

    table = pages.get("table")
    archive = written(resolve_windows(table_archive(table, "table") if table is not None else spark.createDataFrame([], RAW_WINDOW)), "archive")
    usable, entries = read_ledger(spark, ledger_path)
    watched = ledger_windows(entries if compat else without_repeats(entries), archive).withColumn("ord", F.col("ord") + (1 << 56))
    windows = written(archive.select(*watched.columns).unionByName(watched), "windows")  # pages are parsed once, however often the forecast reads windows
    firsts = windows.groupBy("id").agg(F.min("ord").alias("ord"))
    history = derive_history(windows, [today], monotone=not compat).join(history_lines(windows), "id").join(firsts, "id")
    # banners write the day first, in dates with a year too
    routes, missing = all_routes(raw, history, today, times, day_first=None if compat else F.col("source") == "banners")
    routes = routes.cache()
    held.append(routes)

    feed_path = os.path.join(out_dir, "feed.json")
    before = read_json(feed_path)
    previous = _routes(spark, before)
    if ledger_path and usable:
        active = routes.filter("active is not null").select("id", "bank", "code", "active.pct", "active.endDate", F.col("pos.at").alias("pos"))
        as_of = date.fromisoformat(before["generatedAt"][:10]) if before and before.get("generatedAt") else None
        stepped = update_ledger(entries, active, today, previous=previous, as_of=as_of)
        if ledger_path.endswith(".json"):
            folded = ledger_json(stepped.orderBy("ord").collect())
            if folded["windows"] != (read_json(ledger_path) or {}).get("windows"):
                write_json(folded, ledger_path)
        else:
            ledger_table.write_entries(stepped, ledger_path)
    if out.failed and previous is not None:
        filled = stale_fill(routes, previous)
        out.filled = filled.count() - routes.count()
        routes = filled
    checked = verdict(report, routes.limit(0) if previous is None else previous, routes).first()
    if checked["fell"]:
        return Outcome(False, f"routes fell from {checked['had']} to {checked['routes']}", counts=out.counts, failed=out.failed)
    broken = feed_violations(routes).orderBy("subject", "rule").first()
    if broken is not None:
        return Outcome(False, f"invalid: {broken['subject']}: {broken['rule']}", counts=out.counts, failed=out.failed)
    out.routes = [plain(r) for r in routes.orderBy("pos.part", "pos.at").select(*FIELDS).collect()]
    stamp = now.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
    write_json({"version": 1, "generatedAt": stamp, "routes": out.routes}, feed_path)
    out.missing = missing
    out.unmapped = [r["partnerName"] or r["bankName"] for r in missing.orderBy("ord").limit(REPORTED).collect()]
    if partners is not None and curated is not None:
        merged = curated
        for s in scraped or []:
            merged = merge_directory(merged, s)
        write_json(partners | {"directory": directory_json(merged)}, os.path.join(out_dir, "partners.json"))
    return out


def directory_json(directory: DataFrame) -> dict:
    """``{bank: {air: [[name, ratio], ...], hotel: [...]}}`` in order."""
    doc: dict[str, dict[str, list]] = {}
    for r in directory.orderBy("bank", "bucket", "ord").collect():
        doc.setdefault(r["bank"], {"air": [], "hotel": []})[r["bucket"]].append([r["name"], r["ratio"]])
    return doc


def directory_table(spark: SparkSession, partners: dict) -> DataFrame:
    """The directory of a partner document as rows."""
    rows = [(bank, b, name, ratio, k) for bank, entry in partners["directory"].items() for b in ("air", "hotel") for k, (name, ratio) in enumerate(entry.get(b, []))]
    return spark.createDataFrame(rows, "bank string, bucket string, name string, ratio string, ord bigint")


def times_table(spark: SparkSession, partners: dict) -> DataFrame:
    """The transfer times of a partner document as rows."""
    rows = [(bank, code, t) for bank, by in partners.get("transferTimes", {}).items() for code, t in by.items()]
    return spark.createDataFrame(rows, "bank string, code string, time string")


def partner_tables(spark: SparkSession, doc: dict) -> dict[str, DataFrame]:
    """A partner document as the tables that its rules are stated on."""
    make = spark.createDataFrame
    pairs = lambda key: [(k, v) for k, v in doc.get(key, {}).items()]
    kept = ("currency", "asOf", "source", "note", "sourceValue", "sourceCurrency", "fxRate")
    number = lambda x: float(x) if isinstance(x, (int, float)) else x
    return {
        "banks": make([(k, *(v.get(f) for f in ("name", "short", "bg", "fg"))) for k, v in doc["banks"].items()], "bank string, name string, short string, bg string, fg string"),
        "airline_domains": make(pairs("airlineDomains"), "key string, value string"),
        "bank_domains": make(pairs("bankDomains"), "key string, value string"),
        "values": make([(k, float(v)) for k, v in pairs("airlineValues")], "code string, value double"),
        "icons": make(pairs("airlineIconUrls"), "code string, url string"),
        "times": times_table(spark, doc),
        "meta": make([(k, *(number(v.get(f)) for f in kept)) for k, v in pairs("airlineValueMeta")], "code string, currency string, asOf string, source string, note string, sourceValue double, sourceCurrency string, fxRate double"),
        "directory": directory_table(spark, doc),
    }
