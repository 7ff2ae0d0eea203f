"""Exact deduplication with a cuckoo-filter index.

Texts are normalised (each run of ASCII white space becomes one space) and hashed in the
JVM. Digests are sharded by their prefix; inside a shard a :class:`CuckooIndex` keeps the
live digests: a filter of short fingerprints says whether a digest may be present, a hit
is verified against the full digests in the content buckets, and overflow doubles the
filter and fills it again from the stored keys. The index runs twice: over each input
partition, so that a hot digest leaves it as one row, and over each shard.

Defined results: a null text counts as empty; of equal texts the smallest id stays; rows
that repeat an id are counted in the group; a null id sorts after all others, so it stays
only where no other row has the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import text_or_empty, written

#: Fixed value: what one space replaces.
BLANKS = r"[\x20\x09-\x0D]+"
#: Live digests at which the index of an input partition is handed on and started anew.
LOCAL = 200_000
#: Digests that a shard holds on average, at most.
SHARD = 300_000
SLOTS = 4
KICKS = 200


class CuckooIndex:
    """A cuckoo filter over digests (bytes, 16 at least) with content buckets behind it.

    ``put`` inserts or updates, ``get`` looks up, ``delete`` removes. The filter has four
    slots a bucket and 16-bit fingerprints; an entry that finds no place after KICKS
    moves makes the filter double and refill from the stored keys, so none is lost.
    """

    def __init__(self, expected: int = 64):
        self.size = 1 << max(2, (max(1, expected) // 3).bit_length())
        self.buckets: list[list[int]] = [[] for _ in range(self.size)]
        self.content: dict[int, dict[bytes, object]] = {}  # by fingerprint, what a hit is verified against
        self.live = 0
        self.resizes = 0
        self.random = random.Random(7)

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _places(self, digest: bytes, mark: int) -> tuple[int, int]:
        first = int.from_bytes(digest[2:10], "little") & (self.size - 1)
        return first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995 >> 3)) & (self.size - 1)

    def may_hold(self, digest: bytes) -> bool:
        """The filter alone: false means absent."""
        mark = self._mark(digest)
        a, b = self._places(digest, mark)
        return mark in self.buckets[a] or mark in self.buckets[b]

    def get(self, digest: bytes, default=None):
        if not self.may_hold(digest):
            return default
        return self.content.get(self._mark(digest), {}).get(digest, default)

    def put(self, digest: bytes, value) -> bool:
        """True if the digest is new."""
        mark = self._mark(digest)
        if self.may_hold(digest) and digest in (held := self.content.get(mark, {})):
            held[digest] = value
            return False
        self.content.setdefault(mark, {})[digest] = value
        self.live += 1
        if not self._insert(digest, mark):
            self._resize()
        return True

    def delete(self, digest: bytes) -> bool:
        """True if the digest was live."""
        mark = self._mark(digest)
        held = self.content.get(mark, {})
        if not self.may_hold(digest) or digest not in held:
            return False
        del held[digest]
        a, b = self._places(digest, mark)
        (self.buckets[a] if mark in self.buckets[a] else self.buckets[b]).remove(mark)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content.values():
            yield from held.items()

    def _insert(self, digest: bytes, mark: int) -> bool:
        a, b = self._places(digest, mark)
        for p in (a, b):
            if len(self.buckets[p]) < SLOTS:
                self.buckets[p].append(mark)
                return True
        p = self.random.choice((a, b))
        for _ in range(KICKS):
            i = self.random.randrange(SLOTS)
            mark, self.buckets[p][i] = self.buckets[p][i], mark
            p = self._other(p, mark)
            if len(self.buckets[p]) < SLOTS:
                self.buckets[p].append(mark)
                return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled again from the stored keys."""
        while True:
            self.size *= 2
            self.resizes += 1
            self.buckets = [[] for _ in range(self.size)]
            if all(self._insert(d, m) for m, held in self.content.items() for d in held):
                return


def collapse(batches: Iterable[pa.RecordBatch], most: float = float("inf")) -> Iterator[CuckooIndex]:
    """Indexes from digest to (smallest id, rows) of batches with columns digest, id, n: one, or a new one whenever ``most`` digests are live."""
    index = CuckooIndex()
    for b in batches:
        if index.live >= most:
            yield index
            index = CuckooIndex()
        for digest, i, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            old = index.get(digest)
            if old is None:
                index.put(digest, (i, n))
            else:
                ids = [x for x in (old[0], i) if x is not None]
                index.put(digest, (min(ids) if ids else None, old[1] + n))
    yield index


def _rows(indexes: Iterator[CuckooIndex]) -> Iterator[pa.RecordBatch]:
    for index in indexes:
        found = list(index.items())
        for at in range(0, len(found), 20_000):
            part = found[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
                ["digest", "keep_id", "group_size"],
            )


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def digest_index(digests: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size`` for each digest of (digest, id): index each partition, shard by prefix, index each shard."""
    schema = "digest binary, keep_id bigint, group_size bigint"
    local = digests.select("digest", F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n")).mapInArrow(lambda b: _rows(collapse(b, LOCAL)), schema)
    shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), digests.count() // SHARD)
    return local.repartition(shards, F.substring("digest", 11, 8)).mapInArrow(lambda b: _rows(collapse(b)), schema)


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` of every row.

    The join back to the rows is by digest; only digests of more than one row take part,
    and adaptive execution splits a hot one, as the index side has one row for it.
    """
    digests = written(docs.select(F.col(key).alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest")), "digests")
    groups = digest_index(digests).filter("group_size > 1")
    joined = digests.join(groups, "digest", "left")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
