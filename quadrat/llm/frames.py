"""Token ids in binary shards of independent zstandard frames.

A shard is a plain file: frames of little-endian unsigned 32-bit ids, a directory of documents, and a seek table last.

* A frame holds whole documents, about ``FRAME_IDS`` ids, and can be decompressed by itself; a longer document is a frame.
* The directory (a skippable frame, records of ``DOCUMENT``) names each document's frame and its place there.
* The seek table is the one of zstandard's public seekable format: a skippable frame with the compressed size,
  decompressed size and checksum (low 32 bits of XXH64) of each frame, and a footer.

So ``zstd -d`` gives all ids of a shard, and a reader of some documents fetches and decompresses their frames only.

Documents are dealt by ranges of ``doc_id`` and each range becomes one shard, so shards in order of their number hold all
documents in ascending order.  The shards' rows form the manifest, a table that Spark commits: files of attempts that were
lost or repeated have names of their own and are in no manifest.  A writer holds one frame and the directory of its shard.

Cases: a null or empty text is the closing id alone; null ids come first; rows of one id stand in the order they were read
in, and a range of rows of one id is cut like others; an empty table makes a manifest without rows; other columns are
ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm import packing
from quadrat.llm import textbytes as tb
from quadrat.llm.shared import opened

#: Ids of a frame, bytes of text of a shard, frames that one read fetches, tries of a frame and the first pause in seconds.
FRAME_IDS, SHARD_BYTES, GROUP, TRIES, PAUSE = 1 << 16, 64 << 20, 16, 3, 0.1
LEVEL = 3

# Fixed values of zstandard's frame and seekable formats.
SKIPPABLE, SEEKABLE, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
HEADER, ENTRY, FOOTER = struct.Struct("<II"), np.dtype([("stored", "<u4"), ("plain", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")

#: A document of the directory: id (the least long for null), frame, ids before it in the frame, ids.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])
NULL_ID = -(1 << 63)

MANIFEST = "shard int, name string, first_id long, last_id long, null_ids long, documents long, ids long, frames int, bytes long"


def _check(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Frames, directory and seek table of one shard, written to ``out`` in one pass."""

    def __init__(self, out):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.entries, self.directory = [], []
        self.parts, self.open_rows, self.held, self.ids, self.bytes = [], [], 0, 0, 0

    def add(self, names: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents one after the other; a frame closes at the first document's end at or beyond FRAME_IDS."""
        ends = np.cumsum(counts)
        row = 0
        while row < len(counts):
            begin = ends[row] - counts[row]
            last = min(len(counts), int(np.searchsorted(ends, begin + FRAME_IDS - self.held)) + 1)
            rows = np.zeros(last - row, DOCUMENT)
            rows["doc_id"], rows["n"] = names[row:last], counts[row:last]
            rows["frame"], rows["first"] = len(self.entries), self.held + ends[row:last] - counts[row:last] - begin
            self.directory.append(rows)
            self.parts.append(ids[begin : ends[last - 1]])
            self.held += int(ends[last - 1] - begin)
            if self.held >= FRAME_IDS:
                self.close_frame()
            row = last

    def close_frame(self) -> None:
        if self.held:
            plain = np.concatenate(self.parts).astype("<u4").tobytes()
            stored = self.compressor.compress(plain)
            self.out.write(stored)
            self.entries.append((len(stored), len(plain), _check(plain)))
            self.ids += self.held
            self.bytes += len(stored)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.close_frame()
        directory = np.concatenate([np.zeros(0, DOCUMENT), *self.directory])
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        for kind, body in ((SKIPPABLE, directory.tobytes()), (SEEKABLE, table)):
            self.out.write(HEADER.pack(kind, len(body)) + body)
            self.bytes += HEADER.size + len(body)
        self.names = directory["doc_id"]


class ShardReader:
    """A shard's seek table and directory; frames are fetched and decompressed when they are asked for."""

    def __init__(self, path: str, name: str):
        self.store, root = opened(path)
        self.place = f"{root}/{name}"
        self.decompressor = zstandard.ZstdDecompressor()
        with self.store.open_input_file(self.place) as f:
            n, flags, magic = FOOTER.unpack(f.read_at(FOOTER.size, f.size() - FOOTER.size))
            if magic != FOOTER_MAGIC or flags != CHECKSUMS:
                raise OSError(f"{self.place} has no seek table")
            size = n * ENTRY.itemsize + FOOTER.size
            self.entries = np.frombuffer(f.read_at(n * ENTRY.itemsize, f.size() - size), ENTRY)
            self.starts = np.concatenate([[0], np.cumsum(self.entries["stored"].astype(np.int64))])
            kind, length = HEADER.unpack(f.read_at(HEADER.size, int(self.starts[-1])))
            if kind != SKIPPABLE or self.starts[-1] + length + size + 2 * HEADER.size != f.size():
                raise OSError(f"{self.place} has no directory")
            self.directory = np.frombuffer(f.read_at(length, int(self.starts[-1]) + HEADER.size), DOCUMENT)
        self.before = np.concatenate([[0], np.cumsum(self.entries["plain"].astype(np.int64) // 4)])

    def fetch(self, frames: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(frame, ids) of frames in ascending order; each run of neighbours is one read."""
        with self.store.open_input_file(self.place) as f:
            for run in np.split(np.asarray(frames, np.int64), np.flatnonzero(np.diff(frames) != 1) + 1):
                if not len(run):
                    continue
                block = f.read_at(int(self.starts[run[-1] + 1] - self.starts[run[0]]), int(self.starts[run[0]]))
                for k in run:
                    at = int(self.starts[k] - self.starts[run[0]])
                    yield int(k), np.frombuffer(self._plain(int(k), block[at : at + int(self.entries["stored"][k])]), "<u4")

    def _plain(self, k: int, stored: bytes) -> bytes:
        """The frame's bytes; one that fails its checksum is fetched again on a new handle, after a pause."""
        for trial in range(TRIES):
            try:
                if trial:
                    time.sleep(PAUSE * 2 ** (trial - 1))
                    with self.store.open_input_file(self.place) as f:
                        stored = f.read_at(int(self.entries["stored"][k]), int(self.starts[k]))
                plain = self.decompressor.decompress(stored)
                if len(plain) != self.entries["plain"][k] or _check(plain) != self.entries["check"][k]:
                    raise OSError(f"frame {k} of {self.place} fails its checksum")
                return plain
            except (OSError, zstandard.ZstdError):
                if trial + 1 == TRIES:
                    raise
        raise AssertionError


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode all documents, closing id and all, and write shards and manifest into the new folder ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table = packing.tools(tokenizer_path)
        store, root = opened(path)
        name, writer, out = f"ids-{uuid.uuid4().hex}.zst", None, None
        try:
            for batch in tb.tidy(batches):
                names = batch.column(0).fill_null(NULL_ID).to_numpy()
                for a, z, raw, offsets in tb.steps(batch.column(1)):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)  # the name would have it compressed twice
                        writer = ShardWriter(out)
                    writer.add(names[a:z], *packing.closed(*packing.token_ids(tokenizer, table, raw, offsets)))
            if writer is not None:
                writer.close()
        finally:
            if out is not None:
                out.close()
        if writer is not None:
            known = writer.names[writer.names != NULL_ID]
            row = [TaskContext.get().partitionId(), name, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None]
            row += [len(writer.names) - len(known), len(writer.names), writer.ids, len(writer.entries), writer.bytes]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in MANIFEST.split(", ")])

    dealt.mapInArrow(shard, MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a shard, with ``before``: the ids of all shards before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.withColumn("before", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))  # one row a shard


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    With ``doc_ids`` only those documents are read: shards by their range of ids, frames by the directory.
    """
    units = manifest(spark, path)
    wanted = None if doc_ids is None else np.unique(np.asarray(doc_ids, np.int64))
    if wanted is not None:
        asked = F.array(*[F.lit(int(i)) for i in wanted]) if len(wanted) else F.array().cast("array<bigint>")
        units = units.where(F.exists(asked, lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id"))))
    units = units.select("name", "before", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(GROUP))).alias("frame"))
    # A number of partitions, since the rows are few and small but not the work that each of them stands for.
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("name"), F.col("frame"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                shard = ShardReader(path, unit["name"])
                rows = shard.directory
                near = (rows["frame"] >= unit["frame"]) & (rows["frame"] < unit["frame"] + GROUP)
                rows = rows[near if wanted is None else near & np.isin(rows["doc_id"], wanted)]
                for k, ids in shard.fetch(np.unique(rows["frame"]).tolist()):
                    yield _documents(rows[rows["frame"] == k], ids, unit["before"] + int(shard.before[k]), with_ids)

    return units.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _documents(rows: np.ndarray, ids: np.ndarray, before: int, with_ids: bool) -> pa.RecordBatch:
    first, n = rows["first"].astype(np.int64), rows["n"].astype(np.int64)
    parts = [ids[a : a + size] for a, size in zip(first, n)]
    columns = [
        pa.array(rows["doc_id"], mask=rows["doc_id"] == NULL_ID),
        pa.array(before + first),
        pa.array(n),
        pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
    ]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
