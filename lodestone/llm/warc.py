"""WARC archives: a Python data source that writes and reads them.

Writing (``write``): DataFrame functions make one string for each record; each task packs its records, one gzip member
each, into a file of its own, and the driver's commit gives the files that tasks report their names. Files of lost or
repeated tasks stay hidden and are removed. Of
pages with equal payloads of at least ``LEAST`` bytes the one with the largest id is a response and the
others are revisits that refer to it; rows that share that id are all responses.

A member's gzip header has the extra field ``sl``, with the member's bytes and those of its content, four
each in little-endian order, so a reader knows where the next record begins before it inflates anything.

Reading (``spark.read.format("warc")``) plans partitions of whole files, inflates and parses a record's headers first, tests
the predicates on them, and only inflates and decodes the payload of records that pass; over other members it
steps by their length. Archives without that field, gzipped in one piece or plain, are read through. Predicates come from the options ``type``, ``uri_prefix`` and ``digest`` or, where
Spark pushes filters to Python sources, from filters on these columns. ``payload=false`` reads headers only. The payload of a record
that holds no HTTP message (``warcinfo``, ``metadata``, ...) is its whole block. Header bytes that aren't UTF-8 are replaced.

Null html counts as empty, a null url leaves out the header, null ids are written as ``null``
and read as null. Repeated rows are records of their own. An empty table makes an empty folder, which reads as no rows. A file that is cut off or no archive is an error.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

#: Bytes from which equal payloads are written once.
LEAST = 1000
#: Bytes of archives in one partition of a read, at least one file.
PART_BYTES = 64 << 20
BETWEEN = "\r\n\r\n"
#: zlib's level; bytes of a member before its deflated content; bytes of a member that are inflated first, for its headers.
LEVEL, HEAD, FIRST = 6, 24, 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, type string, target_uri string, digest string, refers_to string, full_length long, payload binary"
_HEADERS = {"record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


# --------------------------------------------------------------------------- writer


def records(pages: DataFrame, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """One string for each row of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    copies = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = rows.join(copies, ["digest", "n"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", text("n")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    return rows.select(
        F.concat(
            line("WARC/1.1"),
            line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID: <urn:page:", text("page_id"), ">"),
            line(f"WARC-Date: {date}"),
            F.coalesce(line("WARC-Target-URI: ", url), F.lit("")),
            line("WARC-Payload-Digest: sha1:", F.col("digest")),
            F.when(revisit, F.concat(line(f"WARC-Profile: {REVISIT}"), line("WARC-Refers-To: <urn:page:", text("kept"), ">"))).otherwise(""),
            line("Content-Type: application/http; msgtype=response"),
            line("Content-Length: ", length.cast("string")),
            F.lit("\r\n"),
            http,
            F.when(revisit, "").otherwise(F.col("html")),
        ).alias("value")
    )


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` in a folder."""
    pages.sparkSession.dataSource.register(WarcSource)
    records(pages).write.format("warc").mode("append").save(path)


def member(content: bytes) -> bytes:
    """``content`` as a gzip member that tells its length."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = press.compress(content) + press.flush()
    size = HEAD + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + b"\x0c\0sl\x08\0" + _four(size) + _four(len(content)) + body + _four(zlib.crc32(content)) + _four(len(content))


def _four(n: int) -> bytes:
    return (n & 0xFFFFFFFF).to_bytes(4, "little")


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _file_system(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for record in batch.column(0).to_pylist():
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/.{name}", compression=None, buffer_size=1 << 20)
                out.write(member((record + BETWEEN).encode()))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        names = {m.name for m in messages if m is not None and m.name is not None}
        for f in fs.get_file_info(pyarrow.fs.FileSelector(at)):
            if f.base_name.startswith(".part-"):
                if f.base_name[1:] in names:
                    fs.move(f.path, f"{at}/{f.base_name[1:]}")
                else:  # of a task that was run again
                    fs.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _file_system(self.path)
        for m in messages:
            if m is not None and m.name is not None:
                fs.delete_file(f"{at}/.{m.name}")


# --------------------------------------------------------------------------- data source


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []
        for option, column, how in (("type", "type", "in"), ("digest", "digest", "in"), ("uri_prefix", "target_uri", "prefix")):
            if option in options:
                self.tests.append((column, how, (options[option],)))

    def partitions(self) -> list[Files]:
        fs, at = _file_system(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
        parts: list[list[str]] = []
        size = PART_BYTES
        for f in sorted((f for f in found if f.is_file and f.size and f.base_name[0] not in "._"), key=lambda f: f.path):
            if size + f.size > PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Files(p) for p in parts] or [Files([])]

    def _passes(self, row: dict[str, str | None]) -> bool:
        return all(row[c] is not None and (row[c] in values if how == "in" else row[c].startswith(values[0])) for c, how, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in self._rows(raw):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)

    def _rows(self, raw: pa.NativeFile) -> Iterator[dict]:
        """The records that pass."""
        if _lengths(raw.read(HEAD)):
            at, end = 0, raw.size()
            while at < end:
                raw.seek(at)
                lengths = _lengths(raw.read(HEAD))
                if not lengths or at + lengths[0] > end:
                    raise ValueError(f"no whole record at byte {at}")
                inflate = zlib.decompressobj(-zlib.MAX_WBITS)
                content = inflate.decompress(raw.read(min(FIRST, lengths[0] - HEAD)))
                if len(content) < lengths[1] and b"\r\n\r\n" not in content:  # long headers
                    content += inflate.decompress(raw.read(at + lengths[0] - raw.tell())) + inflate.flush()
                row, left = self._row(content)
                if row is not None:
                    if len(content) < lengths[1] and (self._wants(row) or b"\r\n\r\n" not in content[left[0] :]):
                        content += inflate.decompress(raw.read(at + lengths[0] - raw.tell())) + inflate.flush()
                    yield self._told(row, io.BytesIO(content[left[0] :]), left[1])
                at += lengths[0]
            return
        raw.seek(0)
        zipped = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        with io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw, 1 << 20) as source:
            while (headers := _headers(source)) is not None:
                row, length = self._named(headers)
                start = source.tell()
                if self._passes(row):
                    yield self._told(row, source, length)
                source.seek(start + length + len(BETWEEN) - source.tell(), io.SEEK_CUR)

    def _row(self, content: bytes) -> tuple[dict | None, tuple[int, int]]:
        """A member's row if it passes; where its block begins, and the block's length."""
        source = io.BytesIO(content)
        row, length = self._named(_headers(source) or {})
        return row if self._passes(row) else None, (source.tell(), length)

    @staticmethod
    def _named(headers: dict[str, str]) -> tuple[dict, int]:
        row = {c: headers.get(name) for c, name in _HEADERS.items()}
        row["digest"] = row["digest"] and row["digest"].partition(":")[2]
        row["http"] = headers.get("content-type", "").lower().startswith("application/http")
        return row, int(headers["content-length"])

    def _wants(self, row: dict) -> bool:
        return self.payload and row["type"] != "revisit"

    def _told(self, row: dict, source: io.BufferedIOBase, left: int) -> dict:
        """The row with what its block tells."""
        if row["http"]:
            before = source.tell()
            inner = _headers(source) or {}
            left -= source.tell() - before
            row["full_length"] = int(inner.get("content-length", left))
        else:
            row["full_length"] = left
        row["payload"] = source.read(left) if self._wants(row) else None
        if row["payload"] is not None and len(row["payload"]) < left:
            raise ValueError(f"{row['record_id']} is cut off")
        return row


class PushingReader(WarcReader):
    """For sessions that push filters to Python sources; Spark refuses such readers in others."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in _HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            else:
                yield f  # Spark tests it


_ARROW = pa.schema([*((c, pa.string()) for c in _HEADERS), ("full_length", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def _lengths(head: bytes) -> tuple[int, int] | None:
    """Of a member that tells them: its bytes, and those of its content."""
    if head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x0c\0sl\x08\0":
        return None
    return int.from_bytes(head[16:20], "little"), int.from_bytes(head[20:24], "little")


def _headers(source: io.BufferedReader) -> dict[str, str] | None:
    """The named lines up to an empty one, after a first line; nothing at the file's end."""
    if not source.readline():
        return None
    found = {}
    while (line := source.readline().rstrip(b"\r\n")):
        name, _, value = line.decode(errors="replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ARG002
        return WarcWriter(dict(self.options)["path"])

    def reader(self, schema) -> WarcReader:  # noqa: ARG002
        options = dict(self.options)
        return (PushingReader if options.get("pushdown", "false") == "true" else WarcReader)(options)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records under ``path``; see the module for ``options``."""
    spark.dataSource.register(WarcSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").options(path=path, pushdown=pushdown, **options).load()
