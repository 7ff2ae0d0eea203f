"""Toxicity by weak supervision.

Voters are the terms of a lexicon (words and beginnings of words) mined from labelled
training rows, a fixed lexicon of common insults, and patterns: two or three different
words of the lexicon, their share of a text's words, runs of exclamation marks, words in
capitals, and runs of symbols. A generative label model (:mod:`tidewindow.llm.label_model`)
estimates from the votes on all texts, without labels, how often each voter fires in either
class, and lets voters that repeat each other share their weight. It starts from
texts on which two terms agree. Its posterior labels of the sample train a linear classifier
over the same voters, which scores any text.

Given labels choose the lexicon and nothing else: neither the label model's rates, nor its
posterior, nor the classifier sees them. At most
TRAIN_ROWS labelled rows outside the held-out fold are used, near copies among them as one
(:mod:`tidewindow.llm.near_dup`), as else the words of any text with many copies would tell
its label; the lexicon has every term whose association with the label is significant.
Weights, a number a term, are broadcast.

Defined results: null and empty texts get the score of a text without voters; without
labelled rows of both classes nothing is mined and the insult lexicon alone decides;
repeated rows each give their row; of labels repeated for an id the highest counts; terms
with equal counts are all taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import released, small_batches, text_or_empty, written
from tidewindow.llm.label_model import dense, fit_label_model, from_agreement
from tidewindow.llm.labelled import held_out, training_rows
from tidewindow.llm.near_dup import near_duplicates

#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 10_000
#: Least likelihood-ratio statistic (a chance of about 6e-7) and log ratio of rates of a mined term.
SIGNIFICANT, LEAST_RATIO = 25.0, 1.5
#: Fixed value: common insults of general use.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "dumb", "fool", "jerk", "bastard")
#: Letters of the beginnings of words that can be terms.
BEGINNINGS = (4, 5, 7)
PATTERNS = ("insult", "two words", "three words", "one in 100", "one in 30", "exclamations", "capitals", "symbols")
#: Rows that the fit turns into a matrix of floats at once.
BLOCK = 1000
STRIP = ".,;:!?\"'()[]#*$%&|<>"
_SHOUTS, _SYMBOLS, _CAPITALS = re.compile("!!"), re.compile(r"[#*$%&]{3}"), re.compile(r"\b[A-Z]{4,}\b")


def words_of(text: str) -> set[str]:
    """Lower-case words, without marks and symbols around them."""
    return {w.strip(STRIP) for w in text.lower().split()} - {""}


def terms_of(words: set[str]) -> set[str]:
    """The words, and beginnings of longer ones: those there are (``abcd-``), those of
    two different words (``abcd-2``), and those of many for the text's size (``abcd-%``)."""
    out = set(words)
    many = max(2, len(words) // 60)
    for k in BEGINNINGS:
        for b, n in Counter([w[:k] for w in words if len(w) > k]).items():
            out.add(b + "-")
            if n > 1:
                out.add(b + "-2")
                if n >= many:
                    out.add(b + "-%")
    return out


class Voters:
    """A lexicon's terms, in order, and after them PATTERNS."""

    def __init__(self, terms: list[str]):
        self.place = {w: k for k, w in enumerate(terms)}
        self.terms, self.size = frozenset(terms), len(terms) + len(PATTERNS)
        marks = re.compile(r"(.*)-[2%]?", re.S).fullmatch
        begun = {m[1] for w in terms if (m := marks(w))}
        self.begun = [(k, {b for b in begun if len(b) == k}) for k in BEGINNINGS]

    def fired(self, text: str) -> list[int]:
        """Places of the voters that fire on a text: the terms among :func:`terms_of` its words, and patterns."""
        words = words_of(text)
        hit = words & self.terms
        bad, many = set(hit), max(2, len(words) // 60)
        for k, begun in self.begun:
            seen: dict[str, list[str]] = {}
            for w in words:
                if len(w) > k and w[:k] in begun:
                    seen.setdefault(w[:k], []).append(w)
            for b, those in seen.items():
                told = {b + "-"} | ({b + "-2"} if len(those) > 1 else set()) | ({b + "-%"} if len(those) >= many else set())
                hit |= told & self.terms
                if b + "-" in self.terms:
                    bad.update(those)
        n, m = len(words), len(bad)
        patterns = (
            not words.isdisjoint(INSULTS), m >= 2, m >= 3, 0 < n <= 100 * m, 0 < n <= 30 * m,
            _SHOUTS.search(text) is not None, len(_CAPITALS.findall(text)) > 3, _SYMBOLS.search(text) is not None,
        )
        return sorted(self.place[w] for w in hit) + [len(self.place) + k for k, p in enumerate(patterns) if p]


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights (the intercept last) of a logistic regression on probabilities, by Newton steps over blocks of rows."""
    n, m = x.shape
    w = np.zeros(m + 1)
    penalty = np.full(m + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        h, g = np.diag(penalty), penalty * w
        for at in range(0, n, BLOCK):
            part = np.c_[x[at : at + BLOCK].astype(float), np.ones(len(x[at : at + BLOCK]))]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h += part.T @ (part * (p * (1 - p))[:, None])
            g += part.T @ (p - target[at : at + BLOCK])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def association(a: Column, b: Column, n1: int, n0: int) -> Column:
    """The likelihood-ratio statistic of a term in ``a`` of n1 rows and ``b`` of n0 others."""
    part = lambda seen, of, rate: F.when(seen > 0, seen * F.log(seen / (of * rate))).otherwise(0.0)
    rate = (a + b) / F.lit(float(n1 + n0))
    return 2 * (part(a, n1, rate) + part(b, n0, rate) + part(n1 - a, n1, 1 - rate) + part(n0 - b, n0, 1 - rate))


def mine_terms(rows: DataFrame) -> list[str]:
    """The terms that tell toxic training rows (y, t) from others; none without rows of both classes."""
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(terms_of(words_of(t)))
            terms = list(seen[1] | seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][w] for w in terms], pa.int64()) for y in (1, 0))], ["term", "a", "b"])

    counts = rows.select("y", "t").mapInArrow(lambda b: released(count(b)), "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    found = counts.filter((F.col("a") > 0) & (ratio > LEAST_RATIO) & (association(F.col("a"), F.col("b"), n1, n0) >= SIGNIFICANT))
    return sorted(r["term"] for r in found.select("term").collect())


def votes(docs: DataFrame, voters: Voters, *kept: str) -> DataFrame:
    """``fired``, the voters that fire on each text t, and the columns ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fired = [shared.value.fired(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), *b.columns[1:]], ["fired", *kept])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select("t", *kept).mapInArrow(lambda b: released(vote(b)), f"fired array<int>{kinds}")


class ToxicityModel:
    """Weights of voters and an intercept."""

    def __init__(self, terms: list[str], weights: np.ndarray, intercept: float):
        self.voters, self.weights, self.intercept = Voters(terms), weights, intercept

    def score(self, texts: list[str]) -> np.ndarray:
        margin = np.array([self.intercept + self.weights[self.voters.fired(t)].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, text: str = "text", key: str = "doc_id", most: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns from the votes on all texts, and from at most ``most`` labelled rows which votes those are; the votes on the sample (some MB) come to the driver."""
    small_batches(docs.sparkSession)
    sample = written(training_rows(docs, labels, label, text=text, key=key, most=most).withColumn("row", F.monotonically_increasing_id()), "labelled")
    once = near_duplicates(sample, text="t", key="row").filter("kept").select("row")
    sample = written(sample.join(once, "row", "left_semi"), "labelled")
    terms = mine_terms(sample)
    if not terms:
        return ToxicityModel([], np.array([4.0] + [0.0] * (len(PATTERNS) - 1)), -2.0)
    voters = Voters(terms)
    patterns = votes(docs.select(text_or_empty(text).alias("t")), voters).groupBy("fired").agg(F.count("*").alias("n"))
    patterns = written(patterns, "votes")
    model = fit_label_model(patterns, from_agreement(patterns, voters.size, len(terms) + 1))
    x = dense(votes(sample, voters).toArrow()["fired"], voters.size)
    w = fit_linear(x, model.posterior(x))
    return ToxicityModel(terms, w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", cut: float = 0.5) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()))], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(lambda b: released(score(b)), f"k {kind}, score double")
    return out.select(F.col("k").alias(key), held_out("k").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, all columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return released(pd.Series(shared.value.score(texts.tolist())) for texts in parts)

    return docs.filter(score(text_or_empty(text)) < cut)
