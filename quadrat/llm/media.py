"""Media columns: a Spark data source over archives of stored payloads.

Writing: each task takes Arrow batches and puts their payloads, as 8-bit greyscale PNG images of width 576, into an archive file of its own
and closes it with a directory (one fixed-size record a member: offset, length, key).  The driver gets one file name a
task and commits them in a manifest of that write, which gets its name when it is whole; readers read the archives that
manifests name, so files of lost or repeated attempts are never read.  Appending adds a manifest; overwriting adds one that
hides those before it and then removes them with their archives; a job that fails removes all that its tasks wrote.

Reading: partitions are byte ranges over the committed archives, planned from file sizes alone.  A task reads the
records of its archive's directory that begin in its range, fetches neighbouring members in one read of bounded bytes
through ``pyarrow.fs`` and streams them as Arrow batches.  A member that fails (short read, checksum) is fetched again from
its own offset on a new handle, after a pause; other members are not read twice.

Cases: a null or empty text is stored as one row of padding; any bytes are stored whole; equal payloads give equal
stored bytes; null or repeated ``doc_id`` are kept row by row; an empty table makes a manifest without archives.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quadrat.llm.shared import opened

WIDTH = 576
PAD = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary"
RECORD = struct.Struct("<qqqqI")  # offset, stored length, unpadded length, key, crc32 of the stored bytes
NULL_KEY = -(1 << 63)
TAIL = struct.Struct("<qq8s")  # where the directory begins, number of records, mark
MARK = b"QDRARCH1"
MANIFESTS = "_manifests"
BATCH_BYTES = 4 << 20
#: Bytes of neighbouring members that one read fetches, records of a directory that one read fetches, and the first pause in seconds.
READ_BYTES, RECORDS, PAUSE = 1 << 20, 1024, 0.1


def padded(data: bytes) -> bytes:
    """The payload: ``data`` and bytes 255 up to a positive multiple of 576."""
    return data + PAD * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of width 576 whose samples are the payload."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; raises ValueError where a checksum or the form does not hold."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, b"", None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body += data
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Statistics of the samples: mean, deviation, entropy in bits and the share of steps across the mid level."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float((counts * np.arange(256)).sum() / len(x))
    dev = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / len(x)))
    crossings = float(np.count_nonzero(np.diff((x >= 128).view(np.int8)))) / len(x)
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};cross={crossings:.5f}"


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    members: int


def _manifests(store, root: str) -> list[tuple[int, str, dict]]:
    """(number, path, content) of the manifests that count, in order: those from the last overwrite on."""
    found = store.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    out = []
    for f in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.base_name):
        with store.open_input_stream(f.path) as stream:
            out.append((int(f.base_name.partition("-")[0]), f.path, json.loads(stream.read())))
    first = max((number for number, _, m in out if m["overwrite"]), default=0)
    return [x for x in out if x[0] >= first]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.arc"
        at, records = 0, []
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = data.as_py() or b""
                    media = encode(padded(text))
                    out.write(media)
                    records.append(RECORD.pack(at, len(media), len(text), NULL_KEY if key is None else key, zlib.crc32(media)))
                    at += len(media)
            out.write(b"".join(records))
            out.write(TAIL.pack(at, len(records), MARK))
        return Written(name, at + len(records) * RECORD.size + TAIL.size, len(records))

    def commit(self, messages) -> None:
        store, root = opened(self.path)
        store.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        old = _manifests(store, root)
        files = sorted(([m.name, m.size, m.members] for m in messages if m is not None), key=lambda x: x[0])
        name = f"{root}/{MANIFESTS}/{max((x[0] for x in old), default=0) + 1:012d}-{self.job}"
        with store.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files}).encode())
        store.move(f"{name}.part", f"{name}.json")
        for _, path, m in old if self.overwrite else []:
            store.delete_file(path)
            for archive, _, _ in m["files"]:
                store.delete_file(f"{root}/{archive}")

    def abort(self, messages) -> None:
        """Remove the archives of this job, of attempts that did not report too."""
        store, root = opened(self.path)
        for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-"):
                store.delete_file(f.path)


@dataclass
class Range(InputPartition):
    name: str
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, tries: int):
        self.path, self.split_bytes, self.tries = path, split_bytes, tries

    def partitions(self) -> list[Range]:
        files = [f for _, _, m in _manifests(*opened(self.path)) for f in m["files"]]
        return [Range(n, a, min(size, a + self.split_bytes)) for n, size, k in files if k for a in range(0, size, self.split_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = opened(self.path)
        place = f"{root}/{partition.name}"
        with store.open_input_file(place) as handle:
            begin, n, mark = TAIL.unpack(handle.read_at(TAIL.size, handle.size() - TAIL.size))
            if mark != MARK:
                raise OSError(f"{place} has no directory")
            rows, held = [], 0
            for near in self._runs(handle, begin, n, partition):
                first, size = near[0][0], near[-1][0] + near[-1][1] - near[0][0]
                block = memoryview(handle.read_at(size, first))
                for at, length, plain, key, crc in near:
                    media = bytes(block[at - first : at - first + length])
                    payload, media = self._checked(store, place, media, at, length, crc)
                    rows.append((None if key == NULL_KEY else key, plain, payload, media))
                    held += len(payload) + len(media)
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _runs(self, handle, begin: int, n: int, partition: Range) -> Iterator[list[tuple]]:
        """Records of members that begin in the partition, in runs of about READ_BYTES; the directory is read in blocks."""
        near, held = [], 0
        for i in range(self._first(handle, begin, n, partition.begin), n, RECORDS):
            block = handle.read_at(min(RECORDS, n - i) * RECORD.size, begin + i * RECORD.size)
            for record in RECORD.iter_unpack(block):
                if record[0] >= partition.end:
                    if near:
                        yield near
                    return
                near.append(record)
                held += record[1]
                if held > READ_BYTES:
                    yield near
                    near, held = [], 0
        if near:
            yield near

    def _checked(self, store, place: str, media: bytes, at: int, size: int, crc: int) -> tuple[bytes, bytes]:
        """(payload, stored bytes) of a member, fetched again on its own where what was read does not hold."""
        for trial in range(self.tries):
            try:
                if trial:
                    time.sleep(PAUSE * 2 ** (trial - 1))
                    with store.open_input_file(place) as again:
                        media = again.read_at(size, at)
                if len(media) != size or zlib.crc32(media) != crc:
                    raise OSError(f"member at {at} of {place}")
                return decode(media), media
            except (OSError, ValueError, zlib.error, struct.error):
                if trial + 1 == self.tries:
                    raise
        raise ValueError("tries must be 1 or more")

    @staticmethod
    def _first(handle, begin: int, n: int, offset: int) -> int:
        """The first record whose member begins at ``offset`` or later, by bisection over the directory."""
        low, high = 0, n
        while low < high:
            mid = (low + high) // 2
            if struct.unpack("<q", handle.read_at(8, begin + mid * RECORD.size))[0] < offset:
                low = mid + 1
            else:
                high = mid
        return low


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "payload", "media"])


class MediaArchive(DataSource):
    """``spark.read.format("quadrat_media").load(path)``; options ``split_bytes`` and ``tries``."""

    @classmethod
    def name(cls) -> str:
        return "quadrat_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", 16 << 20)), int(self.options.get("tries", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def store_media(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write the UTF-8 bytes of every text into archives under ``path``, beside those there or (overwrite) in their place."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).write.format("quadrat_media").mode(mode).save(path)


def read_media(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """Members of the archives under ``path``: doc_id, n_bytes, payload and media."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("quadrat_media").option("split_bytes", str(split_bytes)).load(path)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored members, one Arrow batch at a time."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, stored = batch.column("payload").to_pylist(), batch.column("media").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in stored], pa.string()),
                    pa.array([feature(p) for p in payloads], pa.string()),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(measure, kinds)
