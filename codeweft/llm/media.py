"""Media columns: payloads stored as images in archives, read back by a data
source of our own.

``media_archive`` is a Spark data source in both directions. Writing, each task
streams Arrow batches into ZIP archives of bounded size; every payload becomes
a member, an 8-bit greyscale PNG that any viewer opens. The archives of the
attempts that Spark committed are listed in a manifest, so that a task which is
lost and run again, or run twice, adds nothing twice. Reading, the driver plans
byte ranges from the archives' sizes alone; a task reads the directory at the
end of its archive, takes the members that begin in its range, and streams
them back in Arrow batches of bounded bytes. A member that can't be read (an
input error, a failed checksum) is read again by its offset, by itself, with
the file opened anew; the others aren't touched.

``doc_id, archive, offset, n_bytes, media, payload, feature, error`` come back:
the stored form, the decoded samples, the length before padding and a feature
of the samples, ``HEIGHTxWIDTH:HASH:MEAN:MIN:MAX`` (``HASH`` has a bit for each
of 64 consecutive equal stretches: is its mean at least the whole mean?). All
is exact integer arithmetic over one payload: equal payloads, equal values.

Options: ``archiveBytes`` and ``level`` when writing, ``rangeBytes``,
``batchBytes``, ``attempts`` and ``failures`` when reading. With ``failures``
at ``raise`` (the default) a member that stays unreadable fails the task; with
``rows`` it gives a row with ``error`` and null ``media``, ``payload`` and
``feature``.

Defined results: null and empty payloads are one whole row of padding; null and
repeated ids are members of their own. A payload isn't split, so memory follows
the longest one. No rows give no archives, and no archives give no rows; a
folder that holds no manifest reads as empty. Other columns aren't stored.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from codeweft.llm._store import scratch
from codeweft.runtime import ship

#: Samples of an image's row; payloads are padded to a multiple of it.
WIDTH = 576
#: A byte that UTF-8 never uses.
PADDING = 255
LEVEL = 6
ARCHIVE_BYTES = 128 << 20
#: A ZIP directory without extensions has up to 65,535 members.
ARCHIVE_MEMBERS = 50_000
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3

_MANIFEST = "_manifest-"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_ROWS = "doc_id bigint, archive string, offset bigint, n_bytes bigint, media binary, payload binary, feature string, error string"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` up to a positive multiple of ``width``."""
    return data + bytes([PADDING]) * (-len(data) % width if data else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit greyscale image of whole rows of ``width`` samples."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)  # each row begins with its filter: none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image as ``to_png`` writes it, by rows; ValueError for
    any other or a damaged one."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, header, data = 8, b"", []
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("the image breaks off")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if len(header) != 13 or header[8:] != bytes((8, 0, 0, 0, 0)):
        raise ValueError("not 8-bit greyscale")
    width, height = struct.unpack(">II", header[:8])
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if rows.size != height * (width + 1) or rows[:: width + 1].any():
        raise ValueError("not whole unfiltered rows")
    return rows.reshape(height, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Shape, hash, mean, least and largest of an image's samples."""
    height, width = samples.shape
    flat = samples.ravel()
    total = int(flat.sum(dtype=np.int64))
    stretches = flat[: flat.size // 64 * 64].reshape(64, -1)
    sums = stretches.sum(axis=1, dtype=np.int64)
    bits = sums * flat.size >= total * stretches.shape[1]
    return f"{height}x{width}:{np.packbits(bits).tobytes().hex()}:{total // flat.size}:{int(flat.min())}:{int(flat.max())}"


@dataclass
class Written(WriterCommitMessage):
    """Archives of one task, ``(name, bytes, members)``."""

    archives: list[tuple[str, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, archive_bytes: int, level: int, overwrite: bool) -> None:
        self.uri, self.archive_bytes, self.level, self.overwrite = uri, archive_bytes, level, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        rows = ((d, p or b"") for batch in iterator for d, p in zip(batch.column("doc_id").to_pylist(), _cells(batch.column("payload"))))
        row = next(rows, None)
        while row is not None:
            name, members = f"part-{uuid.uuid4().hex}.zip", 0
            with fs.open_output_stream(f"{base}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    while row is not None and members < ARCHIVE_MEMBERS and out.tell() < self.archive_bytes:
                        info = zipfile.ZipInfo(f"{members:06d}.png")
                        info.comment = f"{'' if row[0] is None else row[0]}:{len(row[1])}".encode()
                        archive.writestr(info, to_png(padded(row[1]), level=self.level))
                        members += 1
                        row = next(rows, None)
            done.append((name, fs.get_file_info(f"{base}/{name}").size, members))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(base, recursive=True)
        before = _manifests(fs, base) if self.overwrite else []
        archives = [a for m in messages if m is not None for a in m.archives]
        with fs.open_output_stream(f"{base}/{_MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(archives).encode())
        for path, old in before:
            fs.delete_file(path)
            for name, _, _ in old:
                fs.delete_file(f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        for name in (a[0] for m in messages if m is not None for a in m.archives):
            fs.delete_file(f"{base}/{name}")


def _cells(column: pa.Array) -> Iterator[bytes | None]:
    return (cell.as_py() for cell in column)


def _manifests(fs: pafs.FileSystem, base: str) -> list[tuple[str, list]]:
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    paths = sorted(i.path for i in found if i.base_name.startswith(_MANIFEST))
    out = []
    for path in paths:
        with fs.open_input_stream(path) as source:
            out.append((path, json.loads(source.read())))
    return out


@dataclass
class Range(InputPartition):
    """Members of ``archive`` that begin at ``begin`` or later, before ``end``."""

    archive: str
    begin: int
    end: int


def plan_ranges(archives: list[tuple[str, int, int]], range_bytes: int) -> list[Range]:
    """Ranges that cover each archive once, from its size alone."""
    return [Range(name, at, at + range_bytes) for name, size, _ in archives for at in range(0, size, range_bytes)]


def _media_at(source, info: zipfile.ZipInfo) -> tuple[bytes, np.ndarray]:
    """Stored and decoded form of the member at ``info``'s offset."""
    source.seek(info.header_offset)
    header = source.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no member begins here")
    name, extra = struct.unpack("<HH", header[26:30])
    source.seek(info.header_offset + 30 + name + extra)
    media = source.read(info.compress_size)
    if len(media) != info.compress_size or zlib.crc32(media) != info.CRC:
        raise ValueError("checksum of the member")
    return media, from_png(media)


def read_range(part: Range, opened: Callable[[str], object], attempts: int = ATTEMPTS, pause: float = 0.2) -> Iterator[tuple]:
    """Rows of the members of one range. ``opened`` gives a file to seek in;
    each member has ``attempts`` tries of its own, from its offset."""
    source = None

    def tried(read: Callable[[object], object]):
        nonlocal source
        for k in range(attempts):
            try:
                source = source or opened(part.archive)
                return read(source), None
            except (OSError, ValueError, zlib.error, struct.error, zipfile.BadZipFile) as problem:
                source, failed = None, problem  # the next try opens the file anew
                time.sleep(pause * k)
        return None, failed

    directory, failed = tried(lambda file: zipfile.ZipFile(file).infolist())
    if failed is not None:
        raise OSError(f"no directory in {part.archive}: {failed}")
    for info in directory:
        if not part.begin <= info.header_offset < part.end:
            continue
        ident, _, size = info.comment.decode().partition(":")
        row = (int(ident) if ident else None, part.archive, info.header_offset, int(size))
        found, failed = tried(lambda file, info=info: _media_at(file, info))
        if failed is None:
            media, samples = found
            yield (*row, media, samples.tobytes(), feature(samples), None)
        else:
            yield (*row, None, None, None, f"{type(failed).__name__}: {failed}")


class _Reader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, range_bytes: int, batch_bytes: int, attempts: int, failures: str) -> None:
        self.uri, self.range_bytes, self.batch_bytes, self.attempts, self.failures = uri, range_bytes, batch_bytes, attempts, failures

    def partitions(self) -> list[Range]:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        return plan_ranges([a for _, archives in _manifests(fs, base) for a in archives], self.range_bytes) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        names = [c.split()[0] for c in _ROWS.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows, held = [], 0
        for row in read_range(partition, lambda name: fs.open_input_file(f"{base}/{name}"), self.attempts) if partition.archive else ():
            if row[7] is not None and self.failures == "raise":
                raise OSError(f"member at {row[2]} of {row[1]}: {row[7]}")
            rows.append(row)
            held += sum(len(cell or b"") for cell in row[4:6])
            if held >= self.batch_bytes:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)`` and the same with
    ``df.write`` (columns ``doc_id`` and ``payload``)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _ROWS

    def _uri(self) -> str:
        return self.options["path"]

    def reader(self, schema: StructType) -> DataSourceReader:
        failures = self.options.get("failures", "raise")
        if failures not in ("raise", "rows"):
            raise ValueError("failures must be raise or rows")
        return _Reader(self._uri(), schema, int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("batchBytes", BATCH_BYTES)), int(self.options.get("attempts", ATTEMPTS)), failures)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._uri(), int(self.options.get("archiveBytes", ARCHIVE_BYTES)), int(self.options.get("level", LEVEL)), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MediaArchive)


def store_media(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", **options: object) -> None:
    """Add the whole texts of ``docs`` to the archives in ``path``, as UTF-8."""
    register(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("payload"))
    rows.write.format("media_archive").mode("append").options(**options).save(path)


def load_media(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """What was stored in ``path``: see the module's text."""
    register(spark)
    return spark.read.format("media_archive").options(**options).load(path)


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` and read them back; ``path`` keeps the
    archives, else they go to the shared scratch folder."""
    spark = docs.sparkSession
    place = path or scratch(spark, "media")
    store_media(docs, place)
    return load_media(spark, place)
