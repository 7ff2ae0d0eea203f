"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned by quantiles of the training rows. Trees of at most three leaves on
one feature are boosted in a cycle over the features and added up in a lookup table per
feature; then depth-two trees on the pairs with the largest gain fill a table per pair.
A score is the logistic of the intercept and one table entry per feature and pair, added
for whole arrays of rows.

Learns from at most TRAIN_ROWS labelled rows outside the held-out fold; the model is some
KB whatever the corpus. Defined results: null and empty texts get the score of a text
without words; without labelled rows of both classes every score is the share of ones
(0.5 without any); repeated rows each give their row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import small_batches, text_or_empty
from tidewindow.llm.labelled import held_out, training_rows

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 150, 60, 0.15, 6
FEATURES = (
    "log_words", "mean_word", "distinct_share", "upper_share", "symbol_share", "bang_share", "digit_share",
    "stop_share", "comma_share", "other_bytes", "log_lines", "dup_line_share", "echo_share", "bar_share",
)


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, t in enumerate(texts):
        data = t.encode()
        words = data.split()
        n, m = max(1, len(words)), max(1, len(data))
        c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        lines = [x for x in data.split(b"\n") if x.strip()]
        letters = max(1, int(c[65:91].sum() + c[97:123].sum()))
        out[k] = (
            np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, c[65:91].sum() / letters,
            sum(int(c[x]) for x in b"#*$%&<>") / m, c[33] / m, c[48:58].sum() / m, c[46] / n, c[44] / n, c[128:].sum() / m,
            np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(map(eq, words, words[1:])) / n, c[124] / n,
        )
    return out


class Gam:
    """Fits and scores; see the module."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
        self.coarse = [np.unique(e[:: max(1, BINS // COARSE)]) for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if len(y) and 0 < y.mean() < 1:
            self._fit(x, y)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
        """Leaf values of a tree with intervals of bins as leaves, from gradient and curvature sums."""
        cuts = [0, len(g)]
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
        for _ in range(leaves - 1):
            best = (1e-9, -1)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
                gains = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), a + k + 1))
            if best[1] < 0:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
        return out

    @classmethod
    def _pair_tree(cls, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """The better depth-two tree on a grid of two features (first one, then in each half the other), and its gain."""
        best = (np.zeros_like(g), 0.0)
        for turn in (False, True):
            a, b = (g.T, h.T) if turn else (g, h)
            top = cls._tree(a.sum(1), b.sum(1), 2)
            cut = int(np.argmax(top != top[0])) or len(top)
            out = np.zeros_like(a)
            for rows in (slice(0, cut), slice(cut, None)):
                if len(a[rows]):
                    out[rows] = cls._tree(a[rows].sum(0), b[rows].sum(0), 2)
            gain = float(-(out * a).sum() - 0.5 * (out**2 * b).sum())
            if gain > best[1]:
                best = (out.T if turn else out, gain)
        return best

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        margin = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-margin))
                g, h = (np.bincount(fine[:, f], w, len(t)) for w in (p - y, p * (1 - p)))
                step = RATE * self._tree(g, h, 3)
                t += step
                margin += step[fine[:, f]]
        sizes = [len(e) + 1 for e in self.coarse]

        def grids(i: int, j: int) -> list[np.ndarray]:
            p = 1 / (1 + np.exp(-margin))
            cell = coarse[:, i] * sizes[j] + coarse[:, j]
            return [np.bincount(cell, w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for w in (p - y, p * (1 - p))]

        gains = sorted(((self._pair_tree(*grids(i, j))[1], i, j) for i, j in combinations(range(len(FEATURES)), 2)), reverse=True)
        self.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
        self.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                step = RATE * self._pair_tree(*grids(i, j))[0]
                t += step
                margin += step[coarse[:, i], coarse[:, j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of features."""
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        margin = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            margin += t[fine[:, f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            margin += t[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_gam(docs: DataFrame, labels: DataFrame, label: str, *, text: str = "text", key: str = "doc_id", most: int = TRAIN_ROWS) -> Gam:
    """A model of ``label`` from at most ``most`` labelled rows; their features (some MB) come to the driver."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = training_rows(docs, labels, label, text=text, key=key, most=most).select("y", "t").mapInArrow(measure, "y int, x array<double>").toArrow()
    y = rows["y"].to_numpy().astype(float)
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(np.c_[x, y].T)  # the order of rows doesn't show in the model
    return Gam(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam, *, text: str = "text", key: str = "doc_id", cut: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(features(b.column(1).to_pylist())))], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(score, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), held_out("k").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
