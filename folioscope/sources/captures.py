"""Capture archives (WARC 1.0 and 1.1) as a data source: pages as they were answered, with URL, status, headers and bytes.

`read_captures` reads a file or a folder of `.warc` and `.warc.gz` files; `write_captures` writes one. A file is one partition, read as a stream: no archive and no part of one but a record at a time is held.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dom

SCHEMA = "url string, captured timestamp, status_code int, content_type string, headers map<string,string>, content binary"
#: Bytes of a header block beyond which a record counts as broken.
HEADERS = 1 << 20
#: Records that are passed to Spark at once, and bytes of bodies that end such a batch early.
ROWS, BYTES = 256, 1 << 22


def _files(path: str):
    """The file system of a path, as Spark names it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


def _head(stream: io.BufferedIOBase) -> list[str] | None:
    """Lines up to an empty one; None at the end of the stream or of what can be read as a header."""
    lines, size = [], 0
    while True:
        line = stream.readline(HEADERS)
        size += len(line)
        if not line or size > HEADERS:
            return None
        line = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not line:
            if lines:
                return lines
            continue
        lines.append(line)


def _fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; of repeated ones the last."""
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def records(stream: io.BufferedIOBase, wanted) -> Iterator[tuple]:
    """Responses of an archive whose URL is wanted, in order; other records, and bodies of unwanted ones, are passed over. Ends where the archive breaks off."""
    from datetime import datetime

    while (head := _head(stream)) is not None:
        if not head[0].startswith("WARC/"):
            return
        fields = _fields(head[1:])
        length = fields.get("content-length", "")
        if not length.isdigit():
            return
        url, left = fields.get("warc-target-uri", "").strip("<>"), int(length)
        if fields.get("warc-type") != "response" or not url.lower().startswith("http") or not wanted(url):
            while left > 0 and (skipped := stream.read(min(left, 1 << 20))):
                left -= len(skipped)
            continue
        body = stream.read(left)
        if len(body) < left:
            return
        inner = io.BytesIO(body)
        said = _head(inner) or [""]
        status = said[0].split(" ")[1] if said[0].count(" ") else ""
        try:
            when = datetime.fromisoformat(fields.get("warc-date", "").replace("Z", "+00:00")).astimezone(timezone.utc)
        except ValueError:
            when = None
        answered = _fields(said[1:])
        yield url, when, int(status) if status.isdigit() else None, answered.get("content-type"), answered, inner.read()


def _batches(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records as batches that a few large ones fill."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*[(*r[:4], list(r[4].items()), r[5]) for r in held])
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

    for row in rows:
        held.append(row)
        size += len(row[5])
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CapturesReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.kinds, self.filters = path, to_arrow_schema(schema), []

    def _wanted(self, url: str) -> bool:
        return all(url == f.value if isinstance(f, EqualTo) else url in f.value if isinstance(f, In) else url.startswith(f.value) for f in self.filters)

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        files, path = _files(self.path)
        if files.get_file_info(path).type == fs.FileType.File:
            return [Archive(self.path)]
        root = self.path.rstrip("/")
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        return [Archive(root + name[len(path.rstrip("/")) :]) for name in names]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        files, path = _files(partition.path)
        with files.open_input_stream(path, compression=None) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            yield from _batches(records(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream, self._wanted), self.kinds)


class PushedReader(CapturesReader):
    """Filters on the URL (equal, one of, begins with) are met while reading, so that bodies of other pages aren't parsed."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("url",):
                self.filters.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str


class CapturesWriter(DataSourceArrowWriter):
    """Each task writes an archive of its own under a name that is not read; it gets its name once all tasks are done, and goes if they fail."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        path = f"{root.rstrip('/')}/_{uuid.uuid4().hex}.warc.gz"
        with files.open_output_stream(path, compression=None) as raw:
            for batch in iterator:
                for i in range(batch.num_rows):
                    raw.write(gzip.compress(_record({name: c[i].as_py() for name, c in zip(batch.schema.names, batch.columns)})))
        return Written(path)

    def commit(self, messages: list) -> None:
        files, root = _files(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.type == fs.FileType.File and not f.base_name.startswith("_"):
                    files.delete_file(f.path)
        for i, m in enumerate(messages):
            if m:
                folder, _, name = m.path.rpartition("/")
                files.move(m.path, f"{folder}/part-{i:05d}-{name[1:]}")

    def abort(self, messages: list) -> None:
        files, _ = _files(self.path)
        for m in messages:
            if m:
                files.delete_file(m.path)


def _record(row: dict) -> bytes:
    headers = {k.lower(): v for k, v in dict(row.get("headers") or ()).items()} | ({"content-type": row["content_type"]} if row.get("content_type") else {})
    safe = lambda s: " ".join(str(s).split())
    head = f"HTTP/1.1 {row.get('status_code') or 0} -\r\n" + "".join(f"{safe(k)}: {safe(v)}\r\n" for k, v in headers.items()) + "\r\n"
    body = head.encode() + bytes(row.get("content") or b"")
    when = row["captured"].astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ") if row.get("captured") else ""
    fields = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Target-URI: {safe(row.get('url') or '')}\r\n" + (f"WARC-Date: {when}\r\n" if when else "")
    return (fields + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CapturesReader:
        return (PushedReader if self.options.get("push") == "true" else CapturesReader)(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> CapturesWriter:
        return CapturesWriter(self.options["path"], overwrite)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of an archive or of all in a folder, as many partitions as files; filters on the URL are met while reading."""
    spark.dataSource.register(Captures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    dom.bounded(spark)
    return spark.read.format("captures").option("push", "true").load(path)


def write_captures(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """rows(url, captured, status_code, content_type, headers, content), of which all but url and content may be missing, as archives, one a task."""
    rows.sparkSession.dataSource.register(Captures)
    dom.bounded(rows.sparkSession)
    given = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA)]
    rows.select(*given).write.format("captures").mode("overwrite" if overwrite else "append").save(path)
