"""The directory as a table of versions."""

import os

import pytest

from tidewindow.operators.directory import merge_directory, upsert_rates
from tidewindow.plans import directory_table as D
from tidewindow.plans import versions as V


def rows(spark, banks, ratio="1:1", names=("Aer", "Bel")):
    return spark.createDataFrame([(b, "air", n, ratio, k + 1) for b in banks for k, n in enumerate(names)], D.DIRECTORY)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def listed(df):
    return sorted(tuple(r) for r in df.select("bank", "bucket", "name", "ratio", "ord").collect())


def test_steps_rewrite_their_banks_alone(spark, tmp_path):
    path = str(tmp_path / "directory")
    banks = [f"B{k}" for k in range(40)]
    table = D.directory_versions(spark, path)
    first = rows(spark, banks)
    assert len(table.write(first)) > 20 and listed(table.read()[1]) == listed(first)
    before = files(path)
    scraped = rows(spark, ["B3", "unknown"], "—", ("Aer", "New"))
    changed = D.merge_scraped(scraped, path)
    merged = merge_directory(first, scraped)
    assert len(changed) == 1 and listed(table.read()[1]) == listed(merged)
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and len(after) == len(before) + 1
    assert D.merge_scraped(scraped, path) == [] and D.merge_scraped(scraped.limit(0), path) == [] and files(path) == after
    seen = spark.createDataFrame([("B5", "Aer", "2:1", 0), ("B5", "Zed", None, 1), ("fresh", "Aer", "3:1", 2), ("B6", "Aer", "1:1", 3)], "bank string, name string, ratio string, ord bigint")
    want = listed(upsert_rates(merged, seen))
    assert len(D.upsert_seen(seen, path)) == 2 and listed(table.read()[1]) == want, "B6 stays as it is"
    assert V.prune(path) and listed(table.read()[1]) == want


def test_only_buckets_of_the_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "directory")
    table = D.directory_versions(spark, path)
    table.write(rows(spark, [f"B{k}" for k in range(40)]))
    given = []
    table.merge(rows(spark, ["B1"]).select("bank"), lambda held: given.append(held) or held)
    assert 1 <= given[0].select("bank").distinct().count() < 6
    outside = rows(spark, [f"B{k}" for k in range(40)], "9:9")
    with pytest.raises(Exception, match="outside the merge"):
        table.merge(rows(spark, ["B1"]).select("bank"), lambda held: outside)
    assert V.manifest(path)["version"] == 1


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "directory")
    table = D.directory_versions(spark, path)
    assert table.write(rows(spark, [])) == [] and table.read()[1].count() == 0
    odd = rows(spark, [None, "", "a/b=c", "Á"]).unionByName(rows(spark, ["", ""]))
    assert table.write(odd) and sorted(map(str, table.read()[1].collect())) == sorted(map(str, odd.collect()))
    assert table.write(odd) == [], "null keys and repeated rows compare like any"
    once = odd.dropDuplicates()
    assert len(table.write(once)) == 1 and table.read()[1].count() == once.count() == 8
