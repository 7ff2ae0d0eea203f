"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions.shared import shared_dir, written

__all__ = ["BATCH_ROWS", "PairTable", "byte_alphabet", "ragged", "released", "shared_dir", "small_batches", "table", "text_or_empty", "tokenizer_json", "written"]

#: Rows in one Arrow batch. Documents may be long, so a batch stays at some MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; ``sf_dir`` may be any path that Spark's readers take."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json(name: str) -> str:
    """The file of a public tokenizer, read on the driver. A few MB for any corpus."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def text_or_empty(column: str | Column = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts at a few MB. The session keeps the smaller size, as results are lazy and are planned when they are used."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(batches: Iterator) -> Iterator:
    """``batches``, and at their end what a Python worker has freed goes back to the system, as workers live on and share an executor's memory."""
    yield from batches
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class PairTable:
    """A fixed map from pairs of small integers to an integer, looked up for whole arrays.

    Open addressing with linear probing at a load of a quarter or less.
    """

    _MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, first: np.ndarray, second: np.ndarray, value: np.ndarray):
        keys = (np.asarray(first, np.int64) << 20) | np.asarray(second, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        slots = self._slot(keys).tolist()
        for key, slot, v in zip(keys.tolist(), slots, np.asarray(value).tolist(), strict=True):
            while self.keys[slot] != -1 and self.keys[slot] != key:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._MULT) >> self.shift).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The values, -1 for pairs that have none."""
        keys = (first.astype(np.int64) << 20) | second
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slot_r = (slot[rest] + 1) & self.mask
            slot[rest] = slot_r
            found = self.keys[slot_r]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot_r[hit]]
            rest = rest[~hit & (found != -1)]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and the row number of each element of a ragged array."""
    starts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    return starts, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
