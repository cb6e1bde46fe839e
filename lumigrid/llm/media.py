"""Media columns: payloads stored losslessly in archives, and a Spark data source that reads them back.

write_archives() turns each payload into an 8-bit gray PNG, 64 samples wide, and packs the images of a task into one
ZIP archive (members stored, not compressed again) in the shared folder. A task's archive gets a fresh name, and
only names that a successful task has returned are read, so retried and speculative tasks do no harm.

The data source "archive" plans byte ranges: each partition is an archive and a range of offsets, and reads the members
whose headers begin in that range. The driver knows archives and their sizes only; members are listed by the tasks,
from the directory at the archive's end. Payloads stream as Arrow batches of bounded bytes. Each member is read by its
own offset and checked against its CRC; a failed read is tried again from that offset, on a fresh handle, without
repeating its neighbours. A member that stays unreadable gives a row with its error and a null payload.

Defined results: null and empty texts make a payload of 64 zero bytes; equal texts give equal media; repeated rows are
members of their own; an empty table gives an empty result; a null id is kept as null.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumigrid.llm import common

WIDTH = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, doc_id long, n_bytes long, offset long, media binary, attempts int, error string"
#: Bytes of payload per Arrow batch, and of archive per input partition.
BATCH_BYTES, RANGE_BYTES = 8 << 20, 32 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An 8-bit gray PNG, one byte a sample; the payload's length is a multiple of WIDTH."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # a leading 0 in each line: no filter
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of an image that encode() has made; raises ValueError for anything else."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, data, rows = 8, [], 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            rows = struct.unpack(">I", body[4:8])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filter other than none")
    return lines[:, 1:].tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, and how many of its bytes are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and its path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the texts of docs (doc_id, text) as archives below folder; gives (archive, members, bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        out = zipfile_ = None
        name, n = f"part-{uuid.uuid4().hex}.zip", 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    zipfile_ = zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                payload, size = padded(text)
                entry = zipfile.ZipInfo(f"{n}.png")
                entry.comment = f"{'' if doc_id is None else doc_id},{size}".encode()
                zipfile_.writestr(entry, encode(payload))
                n += 1
        if out is not None:
            zipfile_.close()
            out.close()
            size = store.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "members": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return docs.mapInArrow(pack, "archive string, members long, bytes long")


class _Counted(io.RawIOBase):
    """A write-only stream that knows its place, as zipfile wants it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


class ArchiveRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveSource(DataSource):
    """Options: path, a folder of archives; manifest, a Parquet table (archive, bytes) of those that count (all, if it
    is missing); rangeBytes; batchBytes; retries."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges over all archives; sizes come from the file system, no archive is opened here."""
        if self.manifest:
            store, root = opened(self.manifest)
            listed = dataset.dataset(root, filesystem=store, format="parquet", exclude_invalid_files=False)
            found = [(r["archive"], r["bytes"]) for r in listed.to_table(columns=["archive", "bytes"]).to_pylist()] if listed.files else []
        else:
            store, root = opened(self.path)
            infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            found = [(f"{self.path}/{i.base_name}", i.size) for i in infos if i.is_file and i.path.endswith(".zip")]
        return [ArchiveRange(a, at, min(size, at + self.range_bytes)) for a, size in sorted(found) for at in range(0, size, self.range_bytes)] or [ArchiveRange("", 0, 0)]

    def read(self, part: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        store, place = opened(part.archive)
        with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
            entries = [e for e in z.infolist() if part.start <= e.header_offset < part.stop]
        rows, held = [], 0
        for e in sorted(entries, key=lambda e: e.header_offset):
            media, tries, error = self.member(store, place, e)
            doc_id, _, size = e.comment.decode().partition(",")
            rows.append((part.archive, int(doc_id) if doc_id else None, int(size), e.header_offset, media, tries, error))
            held += len(media or b"")
            if held >= self.batch_bytes:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def member(self, store: fs.FileSystem, place: str, e: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """The member's bytes, from its own offset; (None, tries, error) if it can't be read."""
        error = None
        for n in range(1, self.retries + 1):
            try:
                handle = self.handle(store, place, again=n > 1)
                handle.seek(e.header_offset)
                head = handle.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member header at its offset")
                name, extra = struct.unpack("<HH", head[26:30])
                handle.seek(e.header_offset + 30 + name + extra)
                data = handle.read(e.compress_size)
                if len(data) != e.file_size or zlib.crc32(data) != e.CRC:
                    raise OSError("bad checksum or length")
                return data, n, None
            except OSError as x:
                error = str(x)
                time.sleep(0.05 * (n - 1))
        return None, self.retries, error

    def handle(self, store: fs.FileSystem, place: str, again: bool):
        key = getattr(self, "_key", None)
        if again or key != place:
            if key is not None:
                self._open.close()
            self._open, self._key = store.open_input_file(place), place
        return self._open

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string())
        names = ("archive", "doc_id", "n_bytes", "offset", "media", "attempts", "error")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(path=folder, **options).load()


def features_of(payload: bytes) -> str:
    """Mean, deviation, entropy and share of zero samples of a payload."""
    n = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256).astype(float)
    p = n / n.sum()
    mean = (p * np.arange(256)).sum()
    dev = np.sqrt(max(0.0, (p * np.arange(256) ** 2).sum() - mean**2))
    q = p[p > 0]
    return f"mean={mean:.4f};dev={dev:.4f};bits={-(q * np.log2(q)).sum():.4f};zero={p[0]:.4f}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of media rows (doc_id, n_bytes, media, error), decoded in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, size, media, error in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                try:
                    raw = None if media is None else decode(media)
                except (ValueError, zlib.error, struct.error) as x:
                    raw, error = None, str(x)
                if raw is None:
                    out.append((doc_id, size, None, None, None, None, None, None, error))
                else:
                    out.append((doc_id, size, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features_of(raw), error))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, FEATURES)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text), reads the archives back, and gives a row of features for each."""
    spark = docs.sparkSession
    folder = common.fresh_path(spark, "archives")
    manifest = common.fresh_path(spark, "archive-list")
    write_archives(common.corpus(docs), folder).write.parquet(manifest)  # written once; names from successful tasks only
    return features(read_archives(spark, folder, manifest=manifest))
