"""Near-duplicates by b-bit MinHash.

A document's set holds its distinct 5-word shingles. 128 minima of hashed shingles are
taken; bands of four of them give candidates, and the low two bits of each, packed in bit
planes, give an estimate of the similarity from bit counts, corrected for chance equality.
A pair at the threshold of 0.75 shares none of the 32 bands with a chance of 5e-6, and
falls below the cut on the estimate with one of 3e-7. What passes is confirmed on full sets.

No bucket is expanded into its pairs. Equal sets become one class first. In the first round
every class is compared with one class of each bucket, its leader, and components are
formed. Later rounds look only at buckets with several components left: some rows outside a
bucket's largest component lead, all its rows are compared with them in chunks of bounded
size, a link that joins two components is all a chunk reports, and leaders then leave the
bucket. A round reads and ships each row of an open bucket once, and the leaders of a bucket
once a chunk. Leaders double from round to round up to MOST, so a bucket with k rows outside
its largest component is done after about log2(k / LEADERS) rounds, and beyond MOST leaders
after k / MOST of them: the worst case is a bucket of many rows that share a band and are
not linked, which costs as many rounds, each linear in its rows.

Defined results: a null or empty text, or one without words, has no shingles and is linked
with nothing; rows that repeat an id are one node, which has the links of all its texts; a
row without an id is linked with nothing, has no component and stays; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import released, small_batches, text_or_empty, written
from tidewindow.llm.components import components

WORDS, MINIMA, ROWS = 5, 128, 4
BANDS = MINIMA // ROWS
#: Least estimate that is confirmed: five standard errors below the threshold.
CUT = 0.52
#: Leaders of a bucket in the second round and at most, and rows of a chunk, on average.
LEADERS, MOST, CHUNK = 128, 512, 512
#: Shingles of a bucket's leaders in one round, on average: they are held in memory.
HELD = 2_000_000
#: Characters of text that are hashed at once, but for longer texts.
BYTES = 250_000

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_ORDER = _rng.integers(1, 2**64, WORDS, np.uint64) | np.uint64(1)
_LENGTH = _rng.integers(1, 2**64, WORDS + 1, np.uint64)
_XOR = _rng.integers(0, 2**32, MINIMA, np.uint32)
_MUL = _rng.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1)
_BAND = _rng.integers(1, 2**64, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The set of each text: distinct 64-bit hashes of its shingles, ascending."""
    data = b" ".join(t.encode() for t in texts) + b" "
    sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(data.lower(), np.uint8)  # bytes: A-Z alone change
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))  # a start, an end, a start, ...
    starts = edge[0::2]
    doc_end = np.cumsum(sizes)
    n_words = np.diff(np.searchsorted(starts, np.r_[0, doc_end]))
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(starts):
        return out
    up, down = _powers(_P, len(raw)), _powers(_P_INVERSE, len(raw))
    sums = np.add.reduceat(_BYTE[raw] * up, edge)[0::2]
    word = mix(sums * down[starts])
    first = np.cumsum(n_words) - n_words
    if len(word) >= WORDS:
        full = sum(word[k : len(word) - WORDS + 1 + k] * _ORDER[k] for k in range(WORDS))
        full = mix(full + _LENGTH[WORDS])
    for i in np.flatnonzero(n_words).tolist():
        a, n = int(first[i]), int(n_words[i])
        if n >= WORDS:
            out[i] = np.unique(full[a : a + n - WORDS + 1])
        else:
            out[i] = mix((word[a : a + n] * _ORDER[:n]).sum(keepdims=True) + _LENGTH[n])
    return out


def blocks_of(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of some MB together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= BYTES):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none of them empty: four packed words of low bits, and the band keys."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(sets), MINIMA), np.uint32)
    v = np.empty_like(x)
    for k in range(MINIMA):
        np.bitwise_xor(x, _XOR[k], out=v)
        np.multiply(v, _MUL[k], out=v)
        minima[:, k] = np.minimum.reduceat(v, starts)
    planes = [np.packbits((minima >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1).view("<i8") for b in (0, 1)]
    rows = minima.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    keys = mix((rows * _BAND[:, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[:, ROWS])
    return np.concatenate(planes, axis=1), keys.view(np.int64)


def estimate(differing):
    """Similarity from the number of minima whose two low bits differ; equal by chance: 1 in 4."""
    return (1 - differing / float(MINIMA) - 0.25) / 0.75


_SIG = ["s0", "s1", "s2", "s3"]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hashes, all_texts = b.column(0), b.column(1), b.column(2).to_pylist()
        for part in blocks_of(all_texts):
            sets = shingle_sets(all_texts[part])
            size = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(size)
            prints = np.zeros((len(sets), 2), np.int64)
            packed = np.zeros((len(sets), 4), np.int64)
            keys = np.zeros((len(sets), BANDS), np.int64)
            if len(some):
                full = [sets[i] for i in some]
                starts = np.cumsum([0, *size[some][:-1]])
                flat = np.concatenate(full)
                for k, salt in enumerate((0x1234567, 0x7654321)):
                    prints[some, k] = np.add.reduceat(mix(flat ^ np.uint64(salt)), starts).view(np.int64)
                packed[some], keys[some] = signatures(full)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys[some].ravel()))
            columns = [ids[part.start : part.stop], hashes[part.start : part.stop], pa.array(size), *(pa.array(prints[:, k]) for k in range(2)), *(pa.array(packed[:, k]) for k in range(4)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n", "f0", "f1", *_SIG, "bands"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts (a, b, ta, tb) to those that are linked on full sets."""
    for batch in batches:
        a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
        texts = list(dict.fromkeys(ta + tb))
        sets: dict[str, np.ndarray] = {}
        for part in blocks_of(texts):
            sets.update(zip(texts[part], shingle_sets(texts[part]), strict=True))
        ok = [k for k in range(len(a)) if _similar(sets[ta[k]], sets[tb[k]])]
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([b[k] for k in ok], pa.int64())], ["a", "b"])


class _Chunk:
    """Leaders of a bucket, and the rows of one of its chunks that are held against them."""

    def __init__(self):
        self.c, self.n, self.sig, self.texts = [], [], [], []
        self.root: dict[int, int] = {}
        self.keys = None

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            c = up
        return c

    def lead(self, c: np.ndarray, n: np.ndarray, sig: np.ndarray, texts: list[str]) -> None:
        self.c.append(c)
        self.n.append(n)
        self.sig.append(sig)
        self.texts += texts

    def _index(self) -> None:
        """The leaders' shingles in order, and whose they are."""
        sets = [s for part in blocks_of(self.texts) for s in shingle_sets(self.texts[part])]
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        self.texts = []

    def links(self, c: np.ndarray, n: np.ndarray, sig: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
        """Pairs of components that a row and a leader link, each two once."""
        if not self.c:
            return []
        lc, ln, ls = np.concatenate(self.c), np.concatenate(self.n), np.concatenate(self.sig)
        # bit counts of unsigned words: that of a negative number would be that of its absolute value
        differ = sum(np.bitwise_count((sig[:, None, k] ^ ls[None, :, k]) | (sig[:, None, k + 2] ^ ls[None, :, k + 2])).astype(np.int16) for k in (0, 1))
        ok = (c[:, None] != lc) & (100 * np.minimum(n[:, None], ln) >= 75 * np.maximum(n[:, None], ln)) & (estimate(differ) >= CUT)
        rows = np.flatnonzero(ok.any(axis=1)).tolist()
        out = []
        for part in blocks_of([texts[i] for i in rows]):
            some = rows[part]
            for i, own in zip(some, shingle_sets([texts[i] for i in some]), strict=True):
                mine = self.find(int(c[i]))
                if all(self.find(int(x)) == mine for x in np.unique(lc[ok[i]])):
                    continue
                if self.keys is None:
                    self._index()
                lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
                take = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))
                both = np.bincount(self.owner[take], minlength=len(ln))
                for other in np.unique(lc[ok[i] & (100 * both >= 75 * (ln + len(own) - both))]).tolist():
                    x, y = self.find(int(c[i])), self.find(other)
                    if x != y:
                        self.root[max(x, y)] = min(x, y)
                        out.append((int(c[i]), other))
        return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bk, chunk, leads, c, n, s0..s3, t), each chunk's leaders first, to links (a, b) between components."""
    at, held = None, _Chunk()
    for batch in batches:
        bk, chunk, leads, c, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        sig = np.stack([batch.column(k).to_numpy() for k in range(5, 9)], axis=1).view(np.uint64)
        links: list[tuple[int, int]] = []
        turns = np.flatnonzero((bk[1:] != bk[:-1]) | (chunk[1:] != chunk[:-1]) | (leads[1:] != leads[:-1])) + 1
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(bk)], strict=True):
            if lo == hi:
                continue
            if (bk[lo], chunk[lo]) != at:
                at, held = (bk[lo], chunk[lo]), _Chunk()
            some = c[lo:hi], n[lo:hi], sig[lo:hi], batch.column(9)[lo:hi].to_pylist()
            if leads[lo]:
                held.lead(*some)
            else:
                links += held.links(*some)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _texts_of(texts: DataFrame, nodes: DataFrame, once: bool) -> DataFrame:
    """The rows of ``nodes`` (node, id, th and more) with the text ``t`` of each; an id and a hash tell which where rows repeat an id. ``once``: no id repeats.

    The only shuffle of whole texts, and one at any size, so that what it moves follows the input.
    """
    found = texts.join(nodes.hint("merge"), ["id", "th"]).drop("id", "th")
    return written(found if once else found.dropDuplicates(["node"]), "texts")


def _some_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of those nodes, as a table of their own."""
    return written(rows.join(written(nodes, "nodes"), "node", "left_semi"), "texts")


def _first_round(multi: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of classes with the leader of a bucket they are in."""
    sig = reps.select("node", "n", *_SIG)
    pairs = multi.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sig.select(F.col("node").alias(side), *(F.col(k).alias(f"{k}{side}") for k in ("n", *_SIG))), side)
    differ = sum((F.bit_count(F.col(f"s{k}a").bitwiseXOR(F.col(f"s{k}b")).bitwiseOR(F.col(f"s{k + 2}a").bitwiseXOR(F.col(f"s{k + 2}b")))) for k in (0, 1)), F.lit(0))
    pairs = pairs.filter(100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")).filter(estimate(differ) >= CUT)
    pairs = written(pairs.select("a", "b"), "pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = _some_of(texts.select("node", "t"), need)
    for side in "ab":
        pairs = pairs.join(some.select(F.col("node").alias(side), F.col("t").alias(f"t{side}")), side)
    return pairs.select("a", "b", "ta", "tb").mapInArrow(lambda b: released(_confirm(b)), "a bigint, b bigint")


def _open(rows: DataFrame, leaders: int, turn: int) -> DataFrame:
    """The rows (bk, node, c, n) of buckets with several components, with ``chunks`` and whether a row ``leads``.

    Of a bucket's k rows outside its largest component ``leaders`` are expected to lead, fewer
    where they have many shingles. They are drawn by a hash of their own each turn.
    """
    parts = rows.groupBy("bk", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    open_ = parts.groupBy("bk").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "w", "c")).alias("top")).filter("parts > 1")
    share = F.least(leaders / (F.col("m") - F.col("top.m")), HELD / (F.col("w") - F.col("top.w")))
    open_ = open_.select("bk", F.col("top.c").alias("top"), share.alias("share"), F.ceil(F.col("m") / CHUNK).alias("chunks"))
    drawn = F.shiftrightunsigned(F.xxhash64("bk", "node", F.lit(turn)), 11) / F.lit(float(1 << 53))
    return rows.join(open_, "bk").select("bk", "node", "c", "n", "chunks", ((F.col("c") != F.col("top")) & (drawn < F.col("share"))).alias("leads"))


def _later_rounds(multi: DataFrame, reps: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (node, root) with the components joined that still meet in a bucket and are linked."""
    rows = multi.filter("node <> lead").select("bk", "node").join(found, "node", "left").select("bk", "node", F.coalesce("root", "node").alias("c"))
    rows = rows.join(reps.select("node", "n"), "node")
    some, leaders, turn = None, LEADERS, 0
    while True:
        rows = written(_open(rows, leaders, turn), "open")
        if rows.isEmpty():
            return found
        if some is None:
            some = _some_of(texts, rows.select("node").distinct())
        chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks"))
        told = rows.select("bk", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).alias("chunk"), F.lit(True).alias("leads"), "node", "c", "n")
        told = told.unionByName(rows.select("bk", chunk.alias("chunk"), F.lit(False).alias("leads"), "node", "c", "n"))
        told = told.join(some, "node").select("bk", "chunk", "leads", "c", "n", *_SIG, "t")
        links = told.repartition("bk", "chunk").sortWithinPartitions("bk", "chunk", F.desc("leads")).mapInArrow(lambda b: released(_joined(b)), "a bigint, b bigint")
        joined = components(links)
        rows = rows.filter("not leads").select("bk", "node", "c", "n")
        if not joined.isEmpty():
            joined = joined.select(F.col("node").alias("c"), F.col("root").alias("into"))
            rows = rows.join(joined, "c", "left").select("bk", "node", F.coalesce("into", "c").alias("c"), "n")
            found = found.withColumnRenamed("root", "c").join(joined, "c", "left").select("node", F.coalesce("into", "c").alias("root")).unionByName(joined.select(F.col("c").alias("node"), F.col("into").alias("root")))
            found = written(found, "found")
        leaders, turn = min(2 * leaders, MOST), turn + 1


def _of_one_id(signed: DataFrame, reps: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links between the classes of each repeated id."""
    classes = signed.select("id", "f0", "f1", "n").join(repeated, "id").join(reps.select("f0", "f1", "n", "node"), ["f0", "f1", "n"])
    least = classes.groupBy("id").agg(F.min("node").alias("least"))
    return classes.join(least, "id").select(F.col("node").alias("a"), F.col("least").alias("b"))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t")).select("id", F.xxhash64("t").alias("th"), "t")
    schema = "id bigint, th bigint, n bigint, f0 bigint, f1 bigint, " + "".join(f"{s} bigint, " for s in _SIG) + "bands array<bigint>"
    signed = written(texts.mapInArrow(lambda b: released(_sign(b)), schema).withColumn("node", F.monotonically_increasing_id()), "signatures")
    linkable = signed.filter("n > 0 and id is not null")
    classes = linkable.groupBy("f0", "f1", "n").agg(F.min("id").alias("least"), F.min(F.struct("node", "id", "th", *_SIG, "bands")).alias("r"))
    reps = written(classes.select("f0", "f1", "n", "least", "r.*"), "classes")
    rows = reps.select("node", F.explode("bands").alias("bk"))
    buckets = rows.groupBy("bk").agg(F.count("*").alias("m"), F.min("node").alias("lead")).filter("m > 1")
    multi = written(rows.join(buckets.select("bk", "lead"), "bk"), "buckets")
    repeated = written(linkable.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select("id"), "repeated")
    once = repeated.isEmpty()
    held = _texts_of(texts, reps.select("node", "id", "th", *_SIG).join(multi.select("node").distinct(), "node", "left_semi"), once)
    edges = _first_round(multi, reps, held)
    found = components(edges if once else edges.unionByName(_of_one_id(linkable, reps, repeated)))
    found = _later_rounds(multi, reps, held, found)
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    lowest = members.join(reps.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("lowest"))
    of_class = reps.select("f0", "f1", "n", "least", "node").join(members.join(lowest, "root").select("node", "lowest"), "node", "left")
    of_class = of_class.select("f0", "f1", "n", F.coalesce("lowest", "least").alias("component"))
    out = signed.select("id", "n", "f0", "f1").join(of_class, ["f0", "f1", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
