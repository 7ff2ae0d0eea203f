"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of source, language and topic. A factor for each source,
language and topic is raked in turn until the weighted cells meet all three target
marginals; a cell's weight is the product of its factors. Cells stay a table; a sweep is
one job, written to the shared folder.

Probabilities are raked again under the cap of 1: cells at 1 stay there and the others make
up for them, so that expected tokens have the marginals of the weights. Without repeats a
mix can be no larger than its scarcest value allows, so the budget is lowered to what can
be reached, with a warning that names it. ``copies`` is for callers who may repeat rows: it
meets the targets at the full budget. A document is taken if a hash of its id falls below
its probability. For the cap, three hashes and two numbers a cell come to the driver: 40
bytes for each combination of source, language and topic, however many rows have it.

Defined results: a null source, language or topic counts as the empty one; a null or empty
text has no tokens and the probability of its cell; a value whose target is missing or
zero gets weight 0, a target without tokens is left out and the rest scaled up; repeated
rows share a decision; a row without an id is drawn by its text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import text_or_empty, written
from tidewindow.llm.token_counts import with_token_counts

DIMENSIONS = ("source", "lang", "topic")
#: Exponents on the shares that make the default targets: below 1 they lift what is rare.
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.8}
TOLERANCE, STALLED = 1e-4, 5
#: Relative gap of a marginal that counts as met, and to which the reachable budget is found.
MET = 1e-3
#: Sweeps under the cap after which the gap must have fallen by a tenth.
PATIENCE = 100


def topic_of(text: Column) -> Column:
    """A coarse topic by markers in the text; callers may give a topic column of their own."""
    return (
        F.when(text.rlike("(?i)licen[sc]e"), "licence")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+1 (")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.octet_length(text) < 1000, "short")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words between white space, what counts as tokens where no tokenizer is given."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def flattened(cells: DataFrame) -> DataFrame:
    """Default targets ``dim, value, share``: each marginal's shares, flattened."""
    parts = None
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
        sums = sums.select(F.lit(d).alias("dim"), "value", F.pow(F.col("n").cast("double"), F.lit(FLATTEN[d])).alias("share"))
        parts = sums if parts is None else parts.unionByName(sums)
    return parts


def rake(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``cells`` with ``weight`` so that tokens x weights meet the targets (dim, value, share; any scale a dim).

    Sweeps until no factor is off 1 by more than TOLERANCE, or, with a warning, until STALLED
    sweeps have not brought the largest one nearer by a tenth: then targets contradict each other.
    """
    now = cells
    for d in DIMENSIONS:
        goal = targets.filter(F.col("dim") == d).select(F.col("value").alias(d), F.col("share").alias(f"goal_{d}"))
        there = cells.filter("tokens > 0").select(d).distinct().join(goal, d)
        scale = there.agg(F.sum(f"goal_{d}").alias("all"))  # one row
        goal = there.join(F.broadcast(scale)).select(d, F.when(F.col("all") > 0, F.col(f"goal_{d}") / F.col("all")).alias(f"goal_{d}"))
        now = now.join(goal, d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
    now = written(now.withColumns({"weight": F.lit(1.0), "moved": F.lit(1.0)}), "raked")
    least, stalled = np.inf, 0
    while True:
        step = now.withColumn("moved", F.lit(0.0))
        for d in DIMENSIONS:
            sums = step.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("sum"))
            factor = F.when(F.col("sum") > 0, F.col(f"goal_{d}") / F.col("sum")).otherwise(0.0)
            moved = F.greatest("moved", F.when(F.col("weight") > 0, F.abs(factor - 1)).otherwise(0.0))
            step = step.join(sums, d).withColumns({"moved": moved, "weight": F.col("weight") * factor}).drop("sum")
        now = written(step, "raked")
        most = now.agg(F.max("moved")).first()[0] or 0.0
        if most < TOLERANCE:
            break
        stalled = 0 if most < 0.9 * least else stalled + 1
        least = min(least, most)
        if stalled >= STALLED:
            logging.getLogger(__name__).warning("targets that cannot be met together: factors are still off by %.2g", most)
            break
    return now.select(*DIMENSIONS, "tokens", "weight")


def capped(codes: list[np.ndarray], tokens: np.ndarray, weight: np.ndarray, size: float) -> tuple[np.ndarray, float]:
    """Probabilities for which expected tokens are ``size`` and have the marginals of tokens x weight, and the largest relative gap that is left.

    ``codes``: the cells' values as numbers, for each dimension. Each step moves a value's
    factor towards its goal with the cells at 1 held there; where too much is held, all scale.
    """
    total = (tokens * weight).sum()
    w = weight * (size / total)
    goals = [np.bincount(c, tokens * w) for c in codes]
    best, since = np.inf, 0
    with np.errstate(divide="ignore", invalid="ignore"):
        while True:
            for c, goal in zip(codes, goals, strict=True):
                full = w >= 1
                held, rest = np.bincount(c, tokens * full, len(goal)), np.bincount(c, np.where(full, 0, tokens * w), len(goal))
                factor = np.fmax(np.where(rest > 0, (goal - held) / rest, 0), np.where(held + rest > 0, goal / (held + rest), 1))
                w = np.minimum(w * factor[c], 1e30)
            p = np.minimum(w, 1)
            gap = max((np.abs(np.bincount(c, tokens * p) / goal - 1)[goal > 0].max() for c, goal in zip(codes, goals, strict=True)), default=0.0)
            if gap < 0.9 * best:
                best, since = gap, 0
            since += 1
            if gap <= MET / 10 or since > PATIENCE:
                return p, float(gap)


def probabilities(codes: list[np.ndarray], tokens: np.ndarray, weight: np.ndarray, budget: float) -> tuple[np.ndarray, float]:
    """Probabilities by :func:`capped` at the largest size that meets the marginals, and that size; ``budget`` of all tokens at most."""
    goal = tokens * weight
    if not goal.sum() > 0:
        return np.zeros(len(tokens)), 0.0
    shares = [np.bincount(c, goal) / goal.sum() for c in codes]
    most = min((np.bincount(c, tokens * (weight > 0))[s > 0] / s[s > 0]).min() for c, s in zip(codes, shares, strict=True))
    high = min(budget * tokens.sum(), float(most))
    p, gap = capped(codes, tokens, weight, high)
    if gap <= MET:
        return p, high
    low = min(high, float(goal.sum() / weight[tokens > 0].max()))  # at which no cell is over 1
    p = np.minimum(weight * (low / goal.sum()), 1)
    while high > low * (1 + MET):
        size = (low * high) ** 0.5
        tried, gap = capped(codes, tokens, weight, size)
        p, low, high = (tried, size, high) if gap <= MET else (p, low, size)
    return p, low


def with_probability(weights: DataFrame, budget: float) -> DataFrame:
    """``weights`` with ``probability``, and ``repeats``: a row's expected uses where rows may repeat."""
    spark = weights.sparkSession
    hashes = [F.xxhash64(d).alias(f"h_{d}") for d in DIMENSIONS]
    got = weights.select(*hashes, F.col("tokens").cast("double").alias("tokens"), "weight").toArrow()
    tokens, weight = (got[c].to_numpy() for c in ("tokens", "weight"))
    codes = [np.unique(got[f"h_{d}"].to_numpy(), return_inverse=True)[1] for d in DIMENSIONS]
    p, size = probabilities(codes, tokens, weight, budget)
    want, total = budget * tokens.sum(), (tokens * weight).sum()
    if size < want * (1 - MET):
        logging.getLogger(__name__).warning("without repeats the target weights allow %.4f of all tokens, not %.4f", size / tokens.sum(), budget)
    found = pa.table({**{f"h_{d}": got[f"h_{d}"] for d in DIMENSIONS}, "probability": p, "repeats": weight * (want / total) if total > 0 else weight * 0.0})
    found = written(spark.createDataFrame(found), "probabilities")
    same = [F.xxhash64(d) == found[f"h_{d}"] for d in DIMENSIONS]
    return weights.join(found, same).select(*DIMENSIONS, "weight", "probability", "repeats")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that an id and a seed fix."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def marginals(mixed: DataFrame) -> DataFrame:
    """``dim, value, target, expected`` of what mix_sources gives: shares of tokens by weight, and as they are expected to be taken."""
    sums = mixed.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("m"), F.col("n_tokens").alias("n"), "weight", "probability")
    sums = sums.groupBy("m").agg(F.sum(F.col("n") * F.col("weight")).alias("t"), F.sum(F.col("n") * F.col("probability")).alias("e"))
    all_ = sums.filter(F.col("m.dim") == DIMENSIONS[0]).agg(F.sum("t").alias("all_t"), F.sum("e").alias("all_e"))  # one row
    return sums.join(F.broadcast(all_)).select("m.dim", "m.value", F.try_divide("t", "all_t").alias("target"), F.try_divide("e", "all_e").alias("expected"))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame | None = None,
    *,
    budget: float = 0.8,
    text: str = "text",
    key: str = "doc_id",
    drawn_by: str | None = None,
    lang: str = "lang",
    source: str = "source",
    topic: Column | None = None,
    tokens: Column | None = None,
    tokenizer: str | None = None,
    seed: int = 17,
) -> DataFrame:
    """``key, source, lang, topic, n_tokens, weight, probability, taken, copies`` of every row.

    ``targets``: ``dim`` (source, lang or topic), ``value`` and ``share``; by default the
    corpus's own shares, flattened. ``budget``: expected share of the tokens that are taken,
    or less where the targets allow less without repeats; that of ``copies`` is met.
    ``drawn_by``: the column whose hash decides, ``key`` by default. ``topic`` and ``tokens``:
    a topic and a token count that rows have, as of another operator; by default markers in
    the text, and the tokens of ``tokenizer`` (a tokenizer file's content, counted as by
    :mod:`tidewindow.llm.token_counts`) or else words. A null or negative count counts as none.
    """
    t = text_or_empty(text)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by = F.col(drawn_by or key)
    u = F.when(by.isNull(), uniform(t, seed)).otherwise(uniform(by, seed))
    rows = docs.select(F.col(key).alias("id"), name(source).alias("source"), name(lang).alias("lang"), F.coalesce(topic_of(t) if topic is None else topic, F.lit("")).alias("topic"), u.alias("u"), t.alias("t"), *([] if tokens is None else [tokens.alias("tokens")]))
    if tokens is not None:
        rows = rows.withColumn("tokens", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long")).drop("t")
    elif tokenizer is not None:
        rows = with_token_counts(rows, tokenizer, name="tokens")
    else:
        rows = rows.withColumn("tokens", token_count(F.col("t"))).drop("t")
    rows = written(rows, "tokens")
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    weights = with_probability(rake(cells, flattened(cells) if targets is None else targets), budget)
    out = rows.join(weights, list(DIMENSIONS))
    return out.select(
        F.col("id").alias(key), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability",
        (F.col("u") < F.col("probability")).alias("taken"),
        (F.floor("repeats") + (F.col("u") < F.col("repeats") - F.floor("repeats")).cast("long")).alias("copies"),
    )
