"""Web archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

A folder holds WARC files (``*.warc``, ``*.warc.gz``). Files are read in tasks, small ones
together; a record is in memory at a time, and a batch of some megabytes. Filters on
``url`` (equal, in, a beginning) are pushed to the reader, which passes over the bodies of
other records. Rows are

* ``page`` — the file's place among the folder's names and the record's in it,
* ``url``, ``date`` — of the capture; null if the record has none,
* ``html`` — the text, by the charset the server named, else UTF-8,
* ``error`` — null, or what is wrong with a file that breaks off: one row without a text
  after the rows before the damage. With the option ``broken`` = ``fail`` it fails instead.

Records of requests and of the archive itself are left out. A writer's task writes one file
of ``url, html`` and, where there is one, ``date``; files count once the job commits. A null
text is told apart from an empty one by a header of its own; line breaks in a URL are
percent-encoded.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "page bigint, url string, date string, html string, error string"
#: Bytes of files that a task reads together, and of texts in a batch.
TASK_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
NULL_MARK = "x-null-text"
_FIELDS = pa.schema([("page", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("html", pa.string()), ("error", pa.string())])


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out = {}
    for line in iter(stream.readline, b""):
        if not line.strip():
            return out
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    raise EOFError("a header breaks off")


def records(stream: io.BufferedIOBase, wanted: Callable[[dict[str, str]], bool]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and body of the wanted records; fails where the file is damaged."""
    at = 0
    for line in iter(stream.readline, b""):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(stream)
        left = size = int(head.get("content-length", "none"))
        take, parts = wanted(head), []
        while left:
            part = stream.read(min(left, 1 << 20))
            if not part:
                raise EOFError(f"a body breaks off {left} of {size} bytes early")
            left -= len(part)
            if take:
                parts.append(part)
        if take:
            yield at, head, b"".join(parts)
        at += 1


def _unchunked(body: bytes) -> bytes:
    out, stream = [], io.BytesIO(body)
    while size := int(stream.readline().split(b";")[0].strip() or b"0", 16):
        out.append(stream.read(size))
        stream.readline()
    return b"".join(out)


def text_of(head: dict[str, str], body: bytes) -> str | None:
    """The text of a record: its body, or what the server sent."""
    if NULL_MARK in head:
        return None
    kind = head.get("content-type", "")
    if head.get("warc-type") == "response":
        stream = io.BytesIO(body)
        stream.readline()
        sent = _headers(stream)
        body, kind = stream.read(), sent.get("content-type", "")
        if "chunked" in sent.get("transfer-encoding", "").lower():
            body = _unchunked(body)
        if sent.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
    charset = re.search(r"charset=[\"']?([\w.-]+)", kind, re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:  # a charset that no one knows
        return body.decode("utf-8", "replace")


@dataclass
class Files(InputPartition):
    """Files of one task: place and path."""

    files: list[tuple[int, str]]

    def __post_init__(self) -> None:
        super().__init__(self.files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.fail = options["path"], options.get("broken", "row") == "fail"
        self.whole: list[set[str]] = []
        self.begins: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.whole.append({f.value})
            elif isinstance(f, In) and f.attribute == ("url",):
                self.whole.append(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("url",):
                self.begins.append(f.value)
            yield f  # Spark applies all of them again

    def _wanted(self, head: dict[str, str]) -> bool:
        url = head.get("warc-target-uri")
        if head.get("warc-type") not in ("response", "resource"):
            return False
        if (self.whole or self.begins) and url is None:
            return False
        return all(url in w for w in self.whole) and all(url.startswith(b) for b in self.begins)

    def partitions(self) -> Sequence[InputPartition]:
        where, folder = _file_system(self.path)
        found = where.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.path.endswith((".warc", ".warc.gz")) and "/_" not in i.path[len(folder) :])
        tasks: list[list[tuple[int, str]]] = []
        room = 0
        for k, (name, size) in enumerate(files):
            if room < size or not tasks:
                tasks.append([])
                room = TASK_BYTES
            tasks[-1].append((k, name))
            room -= size
        return [Files(t) for t in tasks] or [Files([])]

    def _rows(self, where: fs.FileSystem, files: list[tuple[int, str]]) -> Iterator[tuple]:
        for k, name in files:
            last = -1
            try:
                with where.open_input_file(name) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw)
                    for at, head, body in records(stream, self._wanted):
                        try:
                            text, wrong = text_of(head, body), None
                        except (OSError, EOFError, ValueError, zlib.error) as e:  # this record alone
                            text, wrong = None, f"{type(e).__name__}: {e}"
                        last = at
                        yield (k << 32) + at, head.get("warc-target-uri"), head.get("warc-date"), text, wrong
            except (OSError, EOFError, ValueError, zlib.error) as e:
                if self.fail:
                    raise
                yield (k << 32) + last + 1, None, None, None, f"{name.rsplit('/', 1)[-1]}: {e}"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = _file_system(self.path)
        rows, size = [], 0
        for row in self._rows(where, partition.files):
            rows.append(row)
            size += len(row[3] or "") + 100
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


@dataclass
class Written(WriterCommitMessage):
    """The file that a task wrote, or None."""

    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("an archive is only added to")
        self.path, self.stage = options["path"], f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = _file_system(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            dates = batch.column("date").to_pylist() if "date" in batch.schema.names else [None] * len(batch)
            for url, date, html in zip(batch.column("url").to_pylist(), dates, batch.column("html").to_pylist(), strict=True):
                if out is None:
                    where.create_dir(f"{folder}/{self.stage}")
                    out = where.open_output_stream(f"{folder}/{self.stage}/{name}", compression=None)
                out.write(gzip.compress(record_of(url, date, html), 6))
        if out is not None:
            out.close()
        return Written(None if out is None else name)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = _file_system(self.path)
        names = [m.name for m in messages if m and m.name]
        for name in names:
            where.move(f"{folder}/{self.stage}/{name}", f"{folder}/{name}")
        self._clear(where, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, where: fs.FileSystem, folder: str) -> None:
        if where.get_file_info(f"{folder}/{self.stage}").type == fs.FileType.Directory:
            where.delete_dir(f"{folder}/{self.stage}")


def record_of(url: str | None, date: str | None, html: str | None) -> bytes:
    """A page as a WARC record."""
    body = (html or "").encode()
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    one_line = lambda s: re.sub(r"[\r\n]", lambda m: quote(m[0]), s)
    lines += [f"WARC-Target-URI: {one_line(url)}"] if url is not None else []
    lines += [f"WARC-Date: {one_line(date)}"] if date is not None else []
    lines += [f"{NULL_MARK}: yes"] if html is None else []
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The archive in a folder. Registers the format, and turns on pushing filters to sources like it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def write_warc(pages: DataFrame, path: str) -> None:
    """Adds pages (url, html and, if there is one, date; other columns are left out) to the archive in a folder, a file a partition."""
    pages.sparkSession.dataSource.register(WarcSource)
    pages.select(*(c for c in ("url", "date", "html") if c in pages.columns)).write.format("warc").mode("append").save(path)
