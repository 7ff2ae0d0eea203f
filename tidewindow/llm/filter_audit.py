"""Filter interaction audit: what each filter removes in every order, by source.

Texts are scanned as Arrow buffers: byte classes and prefix sums count words, capitals,
code points and symbols; the word hashes of a text are sorted and neighbours with one hash
compared byte by byte, which gives its distinct words. A text's failing filters are a mask
of bits. Only digests, masks and parts are shuffled, to find the rows whose text has a
smaller id; rows are then summed into counts a mask and part, and all orders and steps are
products of those counts with fixed tables of masks.

Filters: A short (few words), B repetitive (few distinct words), C capitals, D symbols,
E duplicate of a row of a smaller id.

Defined results: a null text counts as empty; a null part is the empty one; a null id
counts as greater than any other, so its row fails E only where a row with an id has its
text; rows that repeat an id and text are no duplicates of each other and count each; a row
without labels is neither good nor toxic, one label row of several that says so is enough;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import released, small_batches, text_or_empty, written
from tidewindow.llm.scan import SPACE, Texts, blocks, byte_class, piece_hashes, same_pieces

FILTERS = "ABCDE"
#: The characters of filters C and D.
CAPITALS, SYMBOLS = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_class("#$%&*|")
DUPLICATE = 1 << FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_MASKS = 1 << len(FILTERS)
_RESULT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])
_RESULT_SQL = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def distinct_words(t: Texts, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct words of each text. Equal hashes are verified; a text in which two words share one is counted by its bytes."""
    hashes = piece_hashes(t.data, starts, ends)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1])) + 1
    out = np.bincount(o, minlength=len(t.offsets) - 1) - np.bincount(o[again], minlength=len(t.offsets) - 1)
    a, b = order[again - 1], order[again]
    length = ends[a] - starts[a]
    differ = length != ends[b] - starts[b]
    differ[~differ] = ~same_pieces(t.data, starts[a][~differ], starts[b][~differ], length[~differ])
    for k in np.unique(owner[a[differ]]):
        mine = owner == k
        out[k] = len({t.data[s:e].tobytes() for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)})
    return out


def failures(t: Texts, *, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> np.ndarray:
    """The mask of the filters A to D that each text fails."""
    data = t.data[: t.size]
    starts, ends, owner = t.pieces(SPACE[data])
    n_words = np.bincount(owner, minlength=len(t.offsets) - 1)
    points = t.per_text((data & 0xC0) != 0x80)
    fails = (
        n_words < min_words,
        100 * distinct_words(t, starts, ends, owner) < distinct_percent * n_words,
        100 * t.per_text(CAPITALS[data]) > capital_percent * points,
        t.per_text(SYMBOLS[data]) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failure_masks(docs: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source", **limits: int) -> DataFrame:
    """``id, part, digest, mask`` of every row: the filters A to D that its text fails, as bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [failures(t, **limits) for t in blocks(b.column(3))]
            if masks:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(masks), pa.int32())], ["id", "part", "digest", "mask"])

    t = text_or_empty(text)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("t"))
    return rows.mapInArrow(lambda batches: released(run(batches)), "id bigint, part string, digest binary, mask int")


def mask_counts(masks: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, those of quality 1 and those toxic, by the set of filters that they fail.

    Equal rows are summed first. A digest has one row of the smallest id, found by a join
    on digest and id, so that a text with many copies is no hot key.
    """
    rows = written(masks.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "masks")
    least = rows.groupBy("digest").agg(F.min("id").alias("least_id")).withColumnRenamed("digest", "of")
    firsts = rows.join(least, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("least_id")), "left")
    marked = labels.groupBy(F.col(key).cast("long").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = marked.filter("label_id is not null and (good = 1 or toxic = 1)")
    all_ = firsts.join(marked, F.col("id") == F.col("label_id"), "left")
    mask = F.col("mask") + F.when(F.col("of").isNull(), F.lit(DUPLICATE)).otherwise(0)
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return all_.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def order_tables() -> tuple[list[tuple[str, int, str]], dict[str, np.ndarray]]:
    """The (order, step, filter) of each result row, and for each the masks it removes, finds removed, and keeps."""
    rows, masks = [], np.arange(_MASKS)
    hit, gone, kept = [], [], []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            rows.append((order, step, f))
            hit.append((masks & bit != 0) & (masks & before == 0))
            gone.append((masks & bit != 0) & (masks & before != 0))
            before |= bit
            kept.append(masks & before == 0)
    return rows, {"removed": np.array(hit, np.int64), "redundant": np.array(gone, np.int64), "kept": np.array(kept, np.int64)}


def audit(counts: DataFrame) -> DataFrame:
    """Every part, order and step from ``mask_counts``, a part's 32 masks at a time."""
    sums = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in ("n", "good", "toxic") for m in range(_MASKS)]
    parts = counts.groupBy("part").agg(F.array(*sums).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tables = order_tables()
        orders, steps = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())
        filters = np.array([FILTERS.index(r[2]) for r in rows])
        for b in batches:
            for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, good, toxic = np.array(found, np.int64).reshape(3, _MASKS)
                removed = tables["removed"] @ n
                shares = np.bincount(filters, removed, len(FILTERS)).astype(np.int64)
                if removed.sum() >= 1 << 52:  # beyond what the sums of doubles hold
                    shares = np.array([sum(removed[filters == k].tolist()) for k in range(len(FILTERS))])
                columns = {
                    "kept": tables["kept"] @ n, "removed": removed, "redundant": tables["redundant"] @ n, "unique_fails": n[1 << filters],
                    "good_lost": tables["removed"] @ good, "toxic_lost": tables["removed"] @ toxic, "shapley": shares[filters],
                }
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), orders, steps, *(pa.array(columns[c]) for c in COUNTS)], schema=_RESULT)

    return parts.mapInArrow(run, _RESULT_SQL)


def filter_audit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source", **limits: int) -> DataFrame:
    """``part, filter_order, step`` and the counts of documents for each part, order of filters and step.

    ``limits``: ``min_words``, ``distinct_percent`` and ``capital_percent`` of filters A to C.
    """
    return audit(mask_counts(failure_masks(docs, text=text, key=key, part=part, **limits), labels, key=key))
