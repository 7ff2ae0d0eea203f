"""Pages to read: fetched on the driver, a few a run, saved before, or captured in a web archive. Jobs get them as rows (page, url, html)."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.sources.warc import read_warc

PAGE = "page bigint, url string, html string"


def fetch_page(
    url: str, *, tries: int = 3, pause: float = 1.5, timeout: float = 25, usable: Callable[[str], bool] = lambda html: True,
    read: Callable[[str, float], str] | None = None, sleep: Callable[[float], None] = time.sleep,
) -> str:
    """The text of a page. Fails with the last error after ``tries``; waits ``pause`` seconds longer before each further one.

    A page that isn't ``usable`` counts as a failed try. ``read`` (url, timeout) gets the text; by default over HTTP.
    """
    read = read or _over_http
    last: Exception | None = None
    for k in range(tries):
        if k:
            sleep(pause * k)
        try:
            html = read(url, timeout)
            if usable(html):
                return html
            last = ValueError(f"{url}: the page is not usable")
        except (OSError, ValueError) as e:
            last = e
    raise last or ValueError("no tries")


def _over_http(url: str, timeout: float) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # an error status raises
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetched_pages(spark: SparkSession, urls: Mapping[str, str], **how) -> dict[str, DataFrame | None]:
    """For each source id its page, or None if it could not be had."""
    out: dict[str, DataFrame | None] = {}
    for source, url in urls.items():
        try:
            out[source] = spark.createDataFrame([(0, url, fetch_page(url, **how))], PAGE)
        except (OSError, ValueError):
            out[source] = None
    return out


def saved_pages(spark: SparkSession, folder: str, ids: Iterable[str]) -> dict[str, DataFrame | None]:
    """For each source id the page ``<id>.html`` of a folder that Spark can read, or None if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    name = F.regexp_extract("path", r"([^/]*)\.html$", 1)
    rows = files.select(name.alias("id"), F.lit(0).cast("bigint").alias("page"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))
    wanted = list(ids)
    there = {r["id"] for r in rows.select("id").filter(F.col("id").isin(wanted)).collect()}  # as many as there are sources
    return {i: rows.filter(F.col("id") == i).drop("id") if i in there else None for i in wanted}


def captured_pages(spark: SparkSession, folder: str, urls: Mapping[str, str]) -> dict[str, DataFrame | None]:
    """For each source id the last capture of its page in the web archive of a folder, or None if there is none with a text."""
    rows = read_warc(spark, folder).filter(F.col("url").isin(*set(urls.values())) & F.col("html").isNotNull())
    last = rows.groupBy("url").agg(F.max_by("html", F.struct(F.coalesce("date", F.lit("")), "page")).alias("html"))
    last = last.select(F.lit(0).cast("bigint").alias("page"), "url", "html")
    there = {r["url"] for r in rows.select("url").distinct().collect()}  # as many as there are sources
    return {i: last.filter(F.col("url") == url) if url in there else None for i, url in urls.items()}
