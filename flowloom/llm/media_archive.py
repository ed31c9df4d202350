"""Media columns: a data source for directories of archives with media members.

Archives are ZIP files whose members are stored images; their central directory names every
member with its offset. Reading plans byte ranges over the archives of a directory from their
sizes alone; a task reads the directory of its archive, takes the members whose header lies in
its range, reads each by its offset, decodes it and sends batches of bounded size through Arrow. A member that can't be
read or decoded is tried again by itself from its offset, and in the end gives a row with an error
instead of failing its neighbours. Writing goes to attempt files that only the commit moves to their names, so
lost and repeated tasks leave nothing behind that is read.

A member is an 8-bit grey PNG of width 576 whose samples are the payload; its `tEXt` chunk keeps the length
before padding. Equal payloads give equal bytes. PNG files of other encoders are read as long as they are
8-bit grey, unfiltered and not interlaced.

Defined results: NULL content is empty, and empty content is 576 padding bytes. NULL doc_id comes back as
NULL. Repeated rows are separate members. An empty directory gives no rows.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.bounded import shared_dir

WIDTH = 576
PAD = b"\xff"
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, feature string, archive string, offset long, error string"
COLUMNS = ["doc_id", "n_bytes", "payload", "media", "feature", "archive", "offset", "error"]
ARCHIVE_BYTES = 64 << 20
ARCHIVE_MEMBERS = 50_000
BATCH_BYTES = 8 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(content: bytes) -> bytes:
    """A PNG whose samples are `content` and padding up to a positive multiple of WIDTH."""
    rows = max(1, -(-len(content) // WIDTH))
    samples = np.frombuffer(content.ljust(rows * WIDTH, PAD), np.uint8).reshape(rows, WIDTH)
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = samples
    return b"".join([
        b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"length\0" + str(len(content)).encode()), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)),
        _chunk(b"IEND", b"")])


def decode(media: bytes) -> tuple[bytes, int]:
    """Samples and the length before padding of a PNG; ValueError if it is damaged or of another kind."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, data, length, size = 8, [], None, None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at:at + 8])
        body, crc = media[at + 8:at + 8 + n], media[at + 8 + n:at + 12 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != crc:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not a plain 8-bit grey image")
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"length\0"):
            length = int(body[7:])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    payload = lines[:, 1:].tobytes()
    return payload, len(payload) if length is None else length


def feature(payload: bytes) -> str:
    """Mean, deviation and average hash of the samples: 64 equal strips, a bit for each above the mean."""
    samples = np.frombuffer(payload, np.uint8)
    strips = samples[:len(samples) // 64 * 64].reshape(64, -1).mean(axis=1) if len(samples) >= 64 else np.zeros(64)
    bits = np.packbits(strips > samples.mean()).tobytes().hex()
    return f"{samples.mean():.4f};{samples.std():.4f};{bits}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ArchiveRange]:
        fs, root = _open(self.path)
        files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [ArchiveRange(f.path, at, at + self.range_bytes) for f in sorted(files, key=lambda f: f.path)
                if f.is_file and f.path.endswith(".zip") for at in range(0, f.size, self.range_bytes)] or [ArchiveRange("", 0, 0)]

    def _member(self, fs, path: str, offset: int, size: int, crc: int) -> bytes:
        """A stored member's bytes: its own header says where they begin."""
        with fs.open_input_file(path) as f:
            head = f.read_at(30, offset)
            name, extra = struct.unpack("<HH", head[26:30])
            media = f.read_at(size, offset + 30 + name + extra)
        if head[:4] != b"PK\x03\x04" or zlib.crc32(media) != crc:
            raise ValueError(f"damaged member at {offset}")
        return media

    def read(self, part: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if part.start <= m.header_offset < part.end]
        rows, held = [], 0
        for m in members:
            key = m.filename.rpartition("-")[2].removesuffix(".png")
            row = [None if key == "null" else int(key.replace("n", "-")), None, None, None, None, part.path, m.header_offset, None]
            for attempt in range(self.retries):
                try:
                    media = self._member(fs, part.path, m.header_offset, m.file_size, m.CRC)
                    payload, length = decode(media)
                    row[1:5], row[7] = [length, payload, media, feature(payload)], None
                    break
                except (OSError, ValueError, zlib.error, struct.error) as e:
                    row[7] = f"{type(e).__name__}: {e}"
                    if isinstance(e, OSError):
                        time.sleep(0.1 * 2 ** attempt)
            rows.append(row)
            held += len(row[2] or b"") + len(row[3] or b"")
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class MediaArchiveWriter(DataSourceArrowWriter):
    """Writes rows `(doc_id long, content binary)`."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.archive_bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files, z, out, n = [], None, None, 0
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if z is None:
                    files.append(f"{root}/attempt-{uuid.uuid4().hex}")
                    out = fs.open_output_stream(files[-1])
                    z, n = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                key = "null" if doc_id is None else str(doc_id).replace("-", "n")
                z.writestr(zipfile.ZipInfo(f"{n:08d}-{key}.png"), encode(content or b""))
                n += 1
                if out.tell() >= self.archive_bytes or n >= ARCHIVE_MEMBERS:
                    z.close()
                    out.close()
                    z = None
        if z is not None:
            z.close()
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.move(f, f.replace("/attempt-", "/archive-") + ".zip")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f)


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> MediaArchiveWriter:
        return MediaArchiveWriter(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def write(docs: DataFrame, path: str, **options) -> None:
    """Every whole text of `docs` (doc_id, text) as a member of the archives in `path`."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("content"))
    rows.write.format("media_archive").mode("append").options(**options).save(path)


def stored(docs: DataFrame) -> DataFrame:
    """`docs` written to a new folder of archives in the shared folder, and read back."""
    path = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write(docs, path)
    return read(docs.sparkSession, path)


def digests(media: DataFrame) -> DataFrame:
    """What the read-back columns hold, as lengths, digests and features."""
    return media.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error")
