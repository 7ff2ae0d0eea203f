"""Tables of versions, of any size, whose unchanged parts keep their files.

Rows lie in buckets by a key. A manifest names the folder that holds each bucket; a new
version writes the buckets that changed into a folder of its own and then switches the
manifest in one step, so a reader sees the old version or the new one, and a run that dies
before the switch leaves nothing but a folder that no one names. What changed is found by
comparing rows in Spark; only bucket numbers come to the driver. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions.shared import written

MANIFEST = "manifest.json"
BUCKETS = 64


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict | None:
    """The manifest, an empty one where there is none yet, or None if it can't be read."""
    where, folder = _file_system(path)
    name = f"{folder}/{MANIFEST}"
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return {"version": 0, "buckets": BUCKETS, "folders": {}}
    try:
        with where.open_input_stream(name) as f:
            doc = json.loads(f.read())
        return doc if isinstance(doc["version"], int) and isinstance(doc["folders"], dict) and isinstance(doc["buckets"], int) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def changed_keys(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``key`` of every row that only one of two tables has, that they have with other values, or that they have a different number of times.

    Rows of a key are counted up for one table and down for the other, so null keys and repeated rows compare like any.
    """
    mark = lambda rows, n: rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("__row"), F.lit(n).alias("__n"))
    return mark(new, 1).unionByName(mark(old, -1)).groupBy(key, "__row").agg(F.sum("__n").alias("__n")).filter("__n <> 0").select(key).distinct()


@dataclass(frozen=True)
class VersionedTable:
    """A table at ``path`` of the schema ``kind``, in buckets by ``key``."""

    spark: SparkSession
    path: str
    kind: str
    key: str

    def _manifest(self) -> dict:
        doc = manifest(self.path)
        if doc is None:
            raise ValueError(f"{self.path}: the manifest can't be read")
        return doc

    def _bucket(self, doc: dict) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(doc["buckets"])).cast("int")

    def _numbers(self, doc: dict, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(doc).alias("b")).distinct().collect())  # as many as there are buckets

    def _rows(self, doc: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        folders = sorted(doc["folders"].values() if buckets is None else (doc["folders"][str(b)] for b in buckets if str(b) in doc["folders"]))
        if not folders:
            return self.spark.createDataFrame([], self.kind)
        return self.spark.read.schema(self.kind).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> tuple[bool, DataFrame]:
        """(usable, rows). Without a manifest: usable and empty; with one that can't be read: not to be used or replaced."""
        doc = manifest(self.path)
        return doc is not None, self._rows(doc or {"folders": {}})

    def write(self, rows: DataFrame) -> list[int]:
        """Makes ``rows`` the table; the buckets that were written anew, none if nothing changed."""
        doc = self._manifest()
        return self._replace(doc, rows, self._rows(doc))

    def merge(self, keys: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of ``keys`` by what ``step`` makes of their rows; the buckets that changed.

        Buckets without any of the keys are neither read nor written. A bucket has rows of
        other keys too, and ``step`` is to return those; rows of buckets that it wasn't given fail.
        """
        doc = self._manifest()
        buckets = self._numbers(doc, keys)
        if not buckets:
            return []
        old = self._rows(doc, buckets)
        of = self._bucket(doc)
        mine = F.when(of.isin(buckets), F.col(self.key)).otherwise(F.raise_error(F.lit("a row of a bucket outside the merge")).cast(old.schema[self.key].dataType))
        return self._replace(doc, step(old).withColumn(self.key, mine), old)

    def _replace(self, doc: dict, rows: DataFrame, old: DataFrame) -> list[int]:
        new = written(rows.select(*old.columns), "version")
        changed = self._numbers(doc, changed_keys(new, old, self.key))
        if not changed:
            return []
        where, folder = _file_system(self.path)
        version = f"v{doc['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/{version}"
        out = new.withColumn("part_no", self._bucket(doc)).filter(F.col("part_no").isin(changed))
        out.repartition("part_no").write.partitionBy("part_no").parquet(target if "://" in target else f"file://{target}")
        there = {i.base_name for i in where.get_file_info(fs.FileSelector(f"{folder}/{version}"))}
        for b in changed:
            name = f"part_no={b}"
            doc["folders"].pop(str(b), None)
            if name in there:
                doc["folders"][str(b)] = f"{version}/{name}"
        doc["version"] += 1
        fresh = f"{folder}/{MANIFEST}.{version}"
        with where.open_output_stream(fresh) as f:
            f.write(json.dumps(doc, indent=1, sort_keys=True).encode())
        where.move(fresh, f"{folder}/{MANIFEST}")
        return changed


def prune(path: str) -> list[str]:
    """Removes the bucket folders that the manifest no longer names; call it when no reader of an older version is left."""
    where, folder = _file_system(path)
    named = set((manifest(path) or {"folders": {}})["folders"].values())
    inside = lambda name: [i.base_name for i in where.get_file_info(fs.FileSelector(f"{folder}/{name}")) if i.type == fs.FileType.Directory]
    gone = []
    for version in inside(""):
        buckets = [f"{version}/{b}" for b in inside(version)]
        gone += [b for b in buckets if b not in named]
        for name in [version] if not named.intersection(buckets) else [b for b in buckets if b not in named]:
            where.delete_dir(f"{folder}/{name}")
    return sorted(gone)
