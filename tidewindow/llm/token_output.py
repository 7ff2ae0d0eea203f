"""Token ids in binary files that readers can open at any document.

A file holds one zstandard frame a document (its ids as little-endian unsigned 32-bit
integers), then a skippable frame with the document ids and, last, a skippable frame with
the seek table: for each frame its compressed size, its size and the low half of the
XXH64 of its content. The layout of the seek table is that of the public seekable
zstandard format, so the files are also plain zstandard streams. A reader takes the table
from the end of the file and decompresses the frames it is asked for.

Documents are range-partitioned by id, and those of one id by a hash of their text, into as many partitions as their bytes ask for, and
a partition begins a new file when one has FILE_BYTES of ids or FILE_FRAMES documents, so
ids ascend from file to file and what a writer or reader holds, a file's ids and seek
table, is bounded whatever the corpus and however ids are spread. A task that runs again
writes files of other names, and the file list names those that count; it also has their
sums, so nothing is opened for them.

Defined results: a null or empty text has the end id alone; documents of one id stay
apart, ordered by a hash of the text; a null id comes first; an empty table gives no files; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.llm.common import byte_alphabet, shared_dir, small_batches, text_or_empty, written

#: Fixed values of the seekable zstandard format.
SEEK_MAGIC, SKIPPABLE, IDS_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: The characters that the tokenizer's splitter counts as white space.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Letters after which a space, stop or comma surely ends what the tokenizer merges.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A text falls into these chunks, and the tokenizer never merges over their bounds.
CHUNKS = rf" ?[{LETTERS}]++(?=[ .,\n])| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: Chunks whose ids a Python worker remembers at most; then only those stay that came again, where they are three quarters as many at most, else those of its last batch.
MEMO = 700_000
NO_ID = -(1 << 63)
#: Bytes of ids and documents at which a file ends, bytes of text of a partition, and wanted documents of a reading task, on average.
FILE_BYTES, FILE_FRAMES, PARTITION_BYTES, PICKED = 256 << 20, 1 << 20, 256 << 20, 20_000
#: Files that one partition may write.
MOST_FILES = 1 << 20
_FILES = pa.schema([("file_no", pa.int64()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])
_FILES_SQL = "file_no bigint, file string, first_id bigint, last_id bigint, documents bigint, tokens bigint"


class CameAgain(dict):
    """Ids of chunks that were in the memo and came again, and have left it. A chunk that is new gets a hole for its ids."""

    def __init__(self, memo: dict[str, bytes]):
        super().__init__()
        self.memo = memo
        self.holes: dict[str, bytearray] = {}

    def __missing__(self, chunk: str) -> bytes | bytearray:
        ids = self.memo.pop(chunk, None)
        if ids is None:
            return self.holes.setdefault(chunk, bytearray())
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts: the tokenizers library encodes each new chunk once.

    Texts that hold a special token's string go to the library whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_padding()
        self.library.no_truncation()
        self.merger = Tokenizer(self.library.model)  # of words in the alphabet of the vocabulary, a line each
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        letters = byte_alphabet()
        letters[0x0A] = "\n"
        self.alphabet = "".join(letters)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks = re.compile(CHUNKS).findall
        self.memo: dict[str, bytes] = {}
        self.again = CameAgain(self.memo)
        self.length = np.zeros(self.library.get_vocab_size(), np.int64)  # of a token, in bytes
        for token, i in self.library.get_vocab().items():
            self.length[i] = len(token)
        self.word = re.compile(f" ?[{LETTERS}]+").fullmatch
        self.spaced = re.compile(f" [^{BLANK}]").match
        self.blank = re.compile(f"[{BLANK}]").match

    def _learn(self, chunks: list[str]) -> None:
        """Puts chunks into the memo. A word is one pre-token, so the model alone merges it. Of the others, those
        that begin with a space, joined, are a text that falls into them again, as do those
        without blanks, a line each; token lengths tell the bounds.
        """
        words, spaced, lines, blank = [], [], [], []
        for w in chunks:
            (words if self.word(w) else spaced if self.spaced(w) else blank if self.blank(w) else lines).append(w)
        for some in _parts(words):
            text = codecs.charmap_decode("\n".join(some).encode(), "strict", self.alphabet)[0]
            self._cut(some, self.merger, text, 0)
        for some in _parts(spaced):
            self._cut(some, self.library, "".join(some), 0)
        for some in _parts(lines):
            self._cut(some, self.library, "".join(f"{w}\n" for w in some) + "x", 1)
        for w in blank:
            self.memo[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, chunks: list[str], coder, text: str, after: int) -> None:
        """Cuts the ids of a text into those of its chunks, each of which ``after`` tokens of one byte follow."""
        ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, chunks if text.isascii() else map(str.encode, chunks)), np.int64, len(chunks)) + after)
        at_token = np.cumsum(self.length[ids])
        bounds = np.searchsorted(at_token, ends)
        if not np.array_equal(at_token[bounds], ends):
            raise ValueError("tokens cross the bounds of chunks")
        data, first, last = ids.tobytes(), (np.r_[0, bounds[:-1] + 1] * 4).tolist(), ((bounds + 1 - after) * 4).tolist()
        self.memo.update((w, data[a:b]) for w, a, b in zip(chunks, first, last, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in self.specials) for t in texts]
        parts = [[] if w else self.chunks(t) for t, w in zip(texts, whole, strict=True)]
        rows = [list(map(self.again.__getitem__, p)) for p in parts]
        new, self.again.holes = self.again.holes, {}
        if len(self.again) + len(self.memo) + len(new) > MEMO:
            self.memo = dict(self.again)
            if len(self.memo) + len(new) > 3 * MEMO // 4:
                self.memo = {w: self.memo[w] for w in set().union(*parts) if w in self.memo}
            self.again = CameAgain(self.memo)
        self._learn(list(new))
        for w, hole in new.items():
            hole += self.memo[w]
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w else b"".join(row) for t, w, row in zip(texts, whole, rows, strict=True)]


def _parts(chunks: list[str]) -> Iterator[list[str]]:
    """Chunks that are encoded together."""
    for at in range(0, len(chunks), 20_000):
        yield chunks[at : at + 20_000]


_encoders: dict[int, ChunkEncoder] = {}


def encoder(tokenizer: str) -> ChunkEncoder:
    """One encoder for each Python worker and file."""
    key = hash(tokenizer)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(tokenizer)
    return _encoders[key]


class FrameWriter:
    """Writes documents as frames and, on close, their ids and the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream = stream
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.ids: list[int] = []
        self.table: list[bytes] = []
        self.bytes = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.press.compress(data)
        self.stream.write(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.table.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.bytes += len(data)

    def close(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes()
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class FrameReader:
    """Reads single documents of a file; ``source`` has ``size()`` and ``read_at(n, offset)``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.length, self.check = table[:, 0], table[:, 1], table[:, 2]
        self.offset = np.concatenate([[0], np.cumsum(self.packed)])
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.ids = np.frombuffer(source.read_at(8 * n, int(self.offset[-1]) + 8), "<i8")
        self.unpress = zstandard.ZstdDecompressor()

    def read(self, k: int) -> bytes:
        data = self.unpress.decompress(self.source.read_at(int(self.packed[k]), int(self.offset[k])), max_output_size=int(self.length[k]))
        if len(data) != self.length[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.check[k]:
            raise ValueError(f"frame {k} is damaged")
        return data


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    *,
    text: str = "text",
    key: str = "doc_id",
    end_id: int = 2,
    partitions: int | None = None,
    file_bytes: int = FILE_BYTES,
    file_frames: int = FILE_FRAMES,
) -> DataFrame:
    """Encodes and writes all documents; returns the list ``file_no, file, first_id, last_id, documents, tokens``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, no = TaskContext.get(), None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            row = {"file_no": context.partitionId() * MOST_FILES + no, "file": name, "first_id": out.ids[0], "last_id": out.ids[-1], "documents": len(out.ids), "tokens": out.bytes // 4}
            return pa.RecordBatch.from_pylist([row], schema=_FILES)

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), encoder(shared.value).encode(b.column(1).to_pylist()), strict=True):
                if out is None:
                    name = f"{folder}/{context.partitionId():06d}-{no:06d}-{context.taskAttemptId()}.zst"
                    where, path = fs.FileSystem.from_uri(name)
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    out = FrameWriter(where.open_output_stream(path, compression=None))
                out.add(i, ids + end)
                if out.bytes >= file_bytes or len(out.ids) >= file_frames:
                    yield closed()
                    out, no = None, no + 1
        if out is not None:
            yield closed()

    t = text_or_empty(text)
    rows = docs.select(F.col(key).cast("long").alias("k"), t.alias("t"), F.xxhash64(t).alias("h"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    # rows of one id, as of none, are dealt by the hash of their texts
    ordered = rows.repartitionByRange(partitions, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    return written(ordered.mapInArrow(write, _FILES_SQL), "token-files")


def read_token_files(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` read back from the files of a list.

    ``wanted`` has a column doc_id; then only the frames of those documents are read.
    ``start`` counts the ids of all documents before, by the list's sums and the file's
    seek table. The list has a row a file, so its ranges and sums are small; that of wanted
    ids is dealt into parts, each of which opens its file anew.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for before, name, picked in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                where, path = fs.FileSystem.from_uri(name)
                with where.open_input_file(path) as f:
                    r = FrameReader(f)
                    some = np.arange(len(r.ids)) if picked is None else np.flatnonzero(np.isin(r.ids, picked))
                    for at in range(0, len(some), 500):
                        ks = some[at : at + 500]
                        data = [r.read(int(k)) for k in ks]
                        ids = [None if i == NO_ID else i for i in r.ids[ks].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(before + r.start[ks] // 4), pa.array(r.length[ks] // 4), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(data, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    # one row a file
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(files.withColumn("before", before), "placed-files")
    if wanted is None:
        todo = placed.select("before", "file", F.lit(None).cast("array<bigint>").alias("picked"))
    else:
        held = wanted.select(F.col("doc_id").cast("long").alias("want")).distinct().join(placed, F.col("want").between(F.col("first_id"), F.col("last_id")))
        part = F.pmod(F.xxhash64("want"), F.ceil(F.col("documents") / PICKED))
        todo = held.groupBy("before", "file", part.alias("part")).agg(F.collect_list("want").alias("picked")).select("before", "file", "picked")
    n = max(1, placed.count())
    return todo.repartition(n, "file").mapInArrow(listed, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
