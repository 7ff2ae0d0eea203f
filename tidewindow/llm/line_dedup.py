"""Line deduplication with two Bloom filters.

1. Long line keys are hashed. The hashes go to slices of a pair of Bloom filters, one for
   hashes seen once and one for those seen twice, each slice with its own task. Twice-seen
   bits never miss a repeat; what they take for one by chance is found out in step 3.
2. The twice-seen filter, folded to at most FILTER_WORDS words, goes to all tasks.
3. Only lines that it suspects are shuffled, with their whole key: a count and an id a key,
   summed before the shuffle, confirm repeats and choose the document that keeps its lines.
4. Texts lose the confirmed lines of their list. Confirmed keys of up to LOOKUP_BYTES go to
   all tasks; beyond that each document's list is joined to it.

A key is a line without the white space at its ends, A-Z lower-cased. Keys of at least
``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those
of one document, the one of the largest or smallest id.

Beyond some 16 million repeated keys the folded filter suspects more lines than needed; they
are shuffled and found out, so results stay the same.

Defined results: a null text is one empty line; a document is a row, so rows that repeat an
id count each, and all of them keep the lines that their id keeps; a row without an id keeps
lines only where no row with an id holds them; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import released, small_batches, text_or_empty, written
from tidewindow.llm.scan import SPACE, Texts, blocks, piece_hashes

#: Fixed value: what is stripped from a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bits a key in the filters, and 64-bit words in one slice at most.
BITS, SLICE_WORDS = 16, 1 << 17
#: Most words of the folded filter (16 MB), and most bytes of keys that go to all tasks.
FILTER_WORDS, LOOKUP_BYTES = 1 << 21, 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class LongKeys:
    """The line keys of at least ``min_chars`` code points in a block: hashes, text numbers, and where they lie in ``lowered``."""

    def __init__(self, t: Texts, min_chars: int):
        self.lowered, self.starts, self.ends, self.owner = _long_keys(t, min_chars)
        self.hashes = piece_hashes(self.lowered, self.starts, self.ends)

    def bytes(self, k: int) -> bytes:
        return self.lowered[self.starts[k] : self.ends[k]].tobytes()


def _long_keys(t: Texts, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = t.data[: t.size]
    starts, ends, owner = t.pieces(data == 10)
    long = ends - starts >= min_chars
    starts, ends, owner = starts[long], ends[long], owner[long]
    solid = np.flatnonzero(~SPACE[data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = first <= last
    starts, ends, owner = solid[first[some]], solid[last[some]] + 1, owner[some]
    points = np.zeros(t.size + 1, np.int64 if t.size >= 1 << 31 else np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[ends] - points[starts] >= min_chars
    lowered = t.data.copy()
    lowered[: t.size] = _LOWER[data]
    return lowered, starts[long], ends[long], owner[long]


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def masks_of(hashes: np.ndarray) -> np.ndarray:
    """Four of 64 bits for each hash, set in the one word of a filter that the hash falls into."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        out |= np.uint64(1) << ((hashes >> np.uint64(40 + 6 * k)) & np.uint64(63))
    return out


class TwoFilters:
    """Bloom filters of the hashes seen once and of those seen twice; ``words`` is a power of two."""

    def __init__(self, words: int):
        self.words = words
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray, repeated: np.ndarray) -> None:
        """Distinct hashes; ``repeated`` marks those that stand for two rows or more."""
        at = (hashes & np.uint64(self.words - 1)).astype(np.int64)
        bits = masks_of(hashes)
        again = repeated | ((self.once[at] & bits) == bits)
        np.bitwise_or.at(self.twice, at[again], bits[again])
        np.bitwise_or.at(self.once, at, bits)


def may_repeat(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = masks_of(hashes)
    return (twice[(hashes & np.uint64(len(twice) - 1)).astype(np.int64)] & bits) == bits


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def twice_seen(docs: DataFrame, *, text: str = "text", min_chars: int = 40, filter_words: int = FILTER_WORDS) -> np.ndarray:
    """The filter of hashes that two rows or more hold, of ``filter_words`` words at most."""
    spark = docs.sparkSession
    small_batches(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in blocks(b.column(0)):
                keys = LongKeys(t, min_chars)
                order = np.lexsort((keys.owner, keys.hashes))
                h, owner = keys.hashes[order], keys.owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                found, rows = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(rows > 1)], ["h", "repeated"])

    keys = written(docs.select(text_or_empty(text).alias("t")).mapInArrow(lambda b: released(hashed(b)), "h bigint, repeated boolean"), "line-hashes")
    words = _power(keys.count() * BITS / 64)
    slices = max(_power(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), words // SLICE_WORDS)
    words = max(words // slices, 64)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, TwoFilters] = {}
        for b in batches:
            h, repeated, where = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy()
            for s in np.unique(where).tolist():
                mine = where == s
                found, at = np.unique(h[mine], return_inverse=True)
                times = np.bincount(at, 1 + repeated[mine], len(found))
                held.setdefault(s, TwoFilters(words)).add(found, times > 1)
        for s, f in held.items():
            some = np.flatnonzero(f.twice)
            # the word of a filter of all slices: the slice's bits of a hash stand above those of the word
            yield pa.RecordBatch.from_arrays([pa.array(some + s * words, pa.int64()), pa.array(f.twice[some].view(np.int64))], ["word", "bits"])

    where = F.shiftrightunsigned("h", words.bit_length() - 1).bitwiseAND(F.lit(slices - 1)).cast("int")
    dealt = keys.select(where.alias("slice"), "h", "repeated").repartition(min(slices, max(1, slices // 4)), "slice")
    twice = written(dealt.mapInArrow(lambda b: released(sliced(b)), "word bigint, bits bigint"), "twice-seen")
    size = min(filter_words, words * slices, _power(8 * twice.count()))
    folded = twice.groupBy(F.col("word").bitwiseAND(F.lit(size - 1)).alias("word")).agg(F.bit_or("bits").alias("bits")).toArrow()  # no more rows than filter_words
    out = np.zeros(size, np.uint64)
    out[folded["word"].to_numpy()] = folded["bits"].to_numpy().view(np.uint64)
    return out


def suspected_lines(docs: DataFrame, twice: np.ndarray, *, text: str = "text", key: str = "doc_id", min_chars: int = 40) -> DataFrame:
    """``id, of, line_key``: the suspected keys of each row, once a row; ``of`` is a digest of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in blocks(b.column(1)):
                keys, ids = LongKeys(t, min_chars), b.column(0).slice(t.rows.start, t.rows.stop - t.rows.start)
                hit = np.flatnonzero(may_repeat(shared.value, keys.hashes))
                found = sorted({(o, keys.bytes(k)) for k, o in zip(hit.tolist(), keys.owner[hit].tolist(), strict=True)})
                owners = pa.array([o for o, _ in found], pa.int64())
                of = {k: hashlib.md5(t.data[t.offsets[k] : t.offsets[k + 1]].tobytes()).digest() for k in {o for o, _ in found}}
                yield pa.RecordBatch.from_arrays([ids.take(owners), pa.array([of[o] for o, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["id", "of", "line_key"])

    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(lambda b: released(run(b)), "id bigint, of binary, line_key binary")


def confirmed_keys(suspects: DataFrame, *, min_docs: int = 5, keep: str = "last") -> DataFrame:
    """``line_key, keep_id`` of the keys that ``min_docs`` rows or more hold."""
    chosen = {"last": F.max("id"), "first": F.min("id")}[keep]
    return suspects.groupBy("line_key").agg(F.count("*").alias("rows"), chosen.alias("keep_id")).filter(F.col("rows") >= min_docs).select("line_key", "keep_id")


def dedup_lines(
    docs: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    min_chars: int = 40,
    min_docs: int = 5,
    keep: str = "last",
    filter_words: int = FILTER_WORDS,
    lookup_bytes: int = LOOKUP_BYTES,
) -> DataFrame:
    """``key, n_lines, n_dropped, kept_text`` of every row. ``keep``: whether the document of the largest (last) or smallest (first) id keeps a line."""
    twice = twice_seen(docs, text=text, min_chars=min_chars, filter_words=filter_words)
    suspects = written(suspected_lines(docs, twice, text=text, key=key, min_chars=min_chars), "suspected-lines")
    confirmed = written(confirmed_keys(suspects, min_docs=min_docs, keep=keep), "repeated-lines")
    size = confirmed.agg(F.sum(F.octet_length("line_key") + 120)).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t"))
    result = "id bigint, n_lines bigint, n_dropped bigint, kept_text string"

    def thinned(batches: Iterator[pa.RecordBatch], gone) -> Iterator[pa.RecordBatch]:
        """``gone`` gives, for a batch, whether row k loses a line key."""
        for b in batches:
            lost, out = gone(b), []
            for t in blocks(b.column(1)):
                lines = t.per_text(t.data[: t.size] == 10) + 1
                keys = LongKeys(t, min_chars)
                for k in np.unique(keys.owner[may_repeat(twice_.value, keys.hashes)]).tolist():
                    row, parts = t.rows.start + k, t.data[t.offsets[k] : t.offsets[k + 1]].tobytes().split(b"\n")
                    stay = [x for x in parts if len(x) < min_chars or not lost(row, key_of(x))]
                    if len(stay) < len(parts):
                        out.append((row, len(parts) - len(stay), b"\n".join(stay).decode()))
                yield _thinned_batch(b, t.rows, lines, out)
                out = []

    if size <= lookup_bytes:
        table = confirmed.toArrow()
        found = dict(zip(table["line_key"].to_pylist(), table["keep_id"].to_pylist(), strict=True))
        twice_, found_ = (docs.sparkSession.sparkContext.broadcast(x) for x in (twice, found))

        def by_lookup(b: pa.RecordBatch):
            ids, keeps = b.column(0).to_pylist(), found_.value
            return lambda row, line: line in keeps and keeps[line] != ids[row]

        out = rows.mapInArrow(lambda b: released(thinned(b, by_lookup)), result)
    else:
        twice_ = docs.sparkSession.sparkContext.broadcast(twice)
        drops = suspects.join(confirmed, "line_key").filter(~F.col("id").eqNullSafe(F.col("keep_id")))
        drops = drops.groupBy(F.col("id").alias("drop_id"), F.col("of").alias("drop_of")).agg(F.collect_set("line_key").alias("lost"))  # a row's own lines
        whole = rows.withColumn("of", F.unhex(F.md5("t")))
        whole = whole.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("of") == F.col("drop_of")), "left").select("id", "t", "lost")

        def by_list(b: pa.RecordBatch):
            lists = [None if x is None else set(x) for x in b.column(2).to_pylist()]
            return lambda row, line: lists[row] is not None and line in lists[row]

        out = whole.mapInArrow(lambda b: released(thinned(b, by_list)), result)
    return out.withColumnRenamed("id", key)


def _thinned_batch(b: pa.RecordBatch, rows: slice, lines: np.ndarray, thin: list[tuple[int, int, str]]) -> pa.RecordBatch:
    """The result of these rows of a batch, in which those of ``thin`` (row, dropped, text) have lost lines."""
    n = rows.stop - rows.start
    ids, texts, dropped = b.column(0).slice(rows.start, n), b.column(1).slice(rows.start, n), np.zeros(n, np.int64)
    if thin:
        at = np.array([row - rows.start for row, _, _ in thin])
        dropped[at] = [d for _, d, _ in thin]
        changed = np.zeros(n, bool)
        changed[at] = True
        texts = pc.replace_with_mask(texts, pa.array(changed), pa.array([x for _, _, x in thin], texts.type))
    return pa.RecordBatch.from_arrays([ids, pa.array(lines), pa.array(dropped), texts.cast(pa.string())], ["id", "n_lines", "n_dropped", "kept_text"])
