"""A generative model of voters that fire or stay silent on a row, fitted without labels.

Each row has a hidden class; voter j fires with probability ``on1[j]`` in class 1 and
``on0[j]`` in class 0. Expectation maximisation over the table of distinct sets of fired
voters estimates these rates and the share of class 1. Voters that agree beyond what the
classes explain don't count as independent witnesses: a voter's weight is one over the sum
of its correlations within the classes above TIED, its own included; voters that never fire
together, as those of two languages, aren't tied. A voter that fires only where another does
is tied by that correlation alone: it says more than the other. Labels play no part: the
first rates come from rows on which several voters agree (:func:`from_agreement`), which
says which class is which.

Sums are made in Spark, a row a task and voter; counts of pairs of voters that do fire
together and sums per voter come to the driver.

Defined results: an empty table leaves the first rates as they are; rows on which no voter
fires count like all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds at most, rounds before which weights are set anew, and the change of a rate at which it ends.
ROUNDS, WEIGHED, TOLERANCE = 40, (2, 8), 1e-4
#: Correlation within the classes from which voters share their weight.
TIED = 0.25
#: Rows whose pairs of voters are counted at once.
PAIR_ROWS = 500


def dense(fired: pa.Array | pa.ChunkedArray, voters: int) -> np.ndarray:
    """Lists of fired voters as rows of 0 and 1."""
    out = np.zeros((len(fired), voters))
    out[np.repeat(np.arange(len(fired)), pc.list_value_length(fired).to_numpy(zero_copy_only=False)), pc.list_flatten(fired).to_numpy(zero_copy_only=False)] = 1
    return out


@dataclass
class LabelModel:
    """The share of class 1, firing rates in either class, and weights of voters."""

    prior: float
    on1: np.ndarray
    on0: np.ndarray
    weight: np.ndarray

    @classmethod
    def from_counts(cls, n1: float, n0: float, fired1: np.ndarray, fired0: np.ndarray, weight: np.ndarray | None = None) -> LabelModel:
        """Rates from rows of either class and how often each voter fires in them."""
        prior = float(np.clip((n1 + 1) / (n1 + n0 + 2), 1e-6, 1 - 1e-6))
        return cls(prior, (fired1 + 0.5) / (n1 + 1), (fired0 + 0.5) / (n0 + 1), np.ones(len(fired1)) if weight is None else weight)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of 0 and 1."""
        on, off = np.log(self.on1 / self.on0), np.log((1 - self.on1) / (1 - self.on0))
        margin = np.log(self.prior / (1 - self.prior)) + (self.weight * off).sum() + votes @ (self.weight * (on - off))
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def expected(patterns: DataFrame, voters: int, posterior: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected firings of each voter in class 1 and in class 0, and sums of r, 1-r, r², r(1-r) and (1-r)², over the table (fired, n), where r is the ``posterior`` of rows of votes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, zero, whole = np.zeros(voters), np.zeros(voters), np.zeros(5)
        for b in batches:
            v, n = dense(b.column(0), voters), b.column(1).to_numpy().astype(float)
            r = posterior(v)
            one += v.T @ (n * r)
            zero += v.T @ (n * (1 - r))
            whole += [(n * x).sum() for x in (r, 1 - r, r * r, r * (1 - r), (1 - r) ** 2)]
        both = np.r_[one, whole], np.r_[zero, np.zeros(5)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(voters + 5)), *map(pa.array, both)], ["k", "one", "zero"])

    got = patterns.select("fired", "n").mapInArrow(sums, "k bigint, one double, zero double").groupBy("k").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).toArrow().sort_by("k")
    if not got.num_rows:
        return np.zeros(voters), np.zeros(voters), np.zeros(5)
    one, zero = got["one"].to_numpy(), got["zero"].to_numpy()
    return one[:voters], zero[:voters], one[voters:]


def from_agreement(patterns: DataFrame, voters: int, witnesses: int, least: int = 2) -> LabelModel:
    """Rates to start from, without labels: class 1 are rows on which at least ``least`` of the first ``witnesses`` voters fire."""
    one, zero, whole = expected(patterns, voters, lambda v: (v[:, :witnesses].sum(1) >= least).astype(float))
    return LabelModel.from_counts(whole[0], whole[1], one, zero)


def _pairs(fired: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of fired voters: every ordered pair within a list, a voter with itself too, and the list's place."""
    flat, size = pc.list_flatten(fired).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(fired).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size * size)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size * size) - size * size, size * size)
    first = (np.cumsum(size) - size)[row]
    return flat[first + inside // size[row]], flat[first + inside % size[row]], row


def together(patterns: DataFrame, voters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, n: rows on which voters i and j both fire, of pairs that do on any row."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            for at in range(0, b.num_rows, PAIR_ROWS):
                part = b.slice(at, PAIR_ROWS)
                i, j, row = _pairs(part.column(0))
                keys, where = np.unique(np.r_[keys, i * voters + j], return_inverse=True)
                counts = np.bincount(where, np.r_[counts, part.column(1).to_numpy()[row]], len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    got = patterns.select("fired", "n").mapInArrow(pairs, "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key = got["key"].to_numpy()
    return key // voters, key % voters, got["n"].to_numpy()


def shared_weights(model: LabelModel, one: np.ndarray, zero: np.ndarray, whole: np.ndarray, both: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights from the correlations of votes once each row's expected vote is taken off."""
    (i, j, n), a, b = both, model.on1, model.on0
    rest = lambda i, j, n: (
        n - one[i] * a[j] - zero[i] * b[j] - one[j] * a[i] - zero[j] * b[i] + whole[2] * a[i] * a[j] + whole[3] * (a[i] * b[j] + b[i] * a[j]) + whole[4] * b[i] * b[j]
    )
    fires, every = np.zeros(len(a)), np.arange(len(a))
    fires[i[i == j]] = n[i == j]
    size = np.sqrt(np.maximum(rest(every, every, fires), 0)) + 1e-9
    other = i != j
    i, j, n = i[other], j[other], n[other]
    tied = rest(i, j, n) / (size[i] * size[j])
    return 1 / (1 + np.bincount(i, np.where(tied > TIED, np.minimum(tied, 1), 0), len(a)))


def fit_label_model(patterns: DataFrame, start: LabelModel) -> LabelModel:
    """The model of the table (fired, n) that expectation maximisation reaches from ``start``."""
    both, model = together(patterns, len(start.on1)), start
    for k in range(ROUNDS):
        one, zero, whole = expected(patterns, len(start.on1), model.posterior)
        if not whole[:2].sum():
            return start
        after = LabelModel.from_counts(whole[0], whole[1], one, zero, model.weight)
        if k in WEIGHED:
            after.weight = shared_weights(after, one, zero, whole, both)
        moved = max(np.abs(after.on1 - model.on1).max(initial=0), np.abs(after.on0 - model.on0).max(initial=0), np.abs(after.weight - model.weight).max(initial=0))
        model = after
        if moved < TOLERANCE and k > max(WEIGHED):
            break
    return model
