"""Token shards: exact round trip with the tokenizer, the file format, lookups and failures."""

import glob
import zlib

import numpy as np
import pytest
import zstandard
from compare import DATA
from test_llm import ODD, odd

from quadrat.llm import frames, packing, queries, shared


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def stored(spark, docs):
    path = shared.new_path(spark, "ids")
    frames.write(docs, path, queries.tokenizer_path())
    return path


def test_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    extra = [(-5, "Don't stop <|endoftext|> ½ 12345 a_b !!$$ ÀÉß× 日本語\x1c"), (-4, "x" * 3000), (-3, None), (-2, "a b " * 90_000), (-1, "")]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(5)
    rows = sorted(frames.read(spark, stored(spark, docs)).collect(), key=lambda r: r.start)
    want = sorted(docs.collect())
    assert [r.doc_id for r in rows] == [d.doc_id for d in want]
    before = 0
    for r, d in zip(rows, want):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert r.ids == ids and r.start == before and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        before += len(ids)


def test_odd_rows(spark, tokenizer):
    rows = sorted(frames.read(spark, stored(spark, odd(spark, ODD))).collect(), key=lambda r: r.start)
    want = {}
    for i, t in ODD:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    for i, all_ids in want.items():
        assert sorted(r.ids for r in rows if r.doc_id == i) == sorted(all_ids)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert frames.read(spark, stored(spark, odd(spark, []))).count() == 0


def test_files_are_frames_with_a_seek_table(spark, monkeypatch):
    monkeypatch.setattr(frames, "FRAME_IDS", 500)
    path = stored(spark, spark.read.parquet(f"{DATA}/documents.parquet"))
    for row in frames.manifest(spark, path).collect():
        name = f"{path.removeprefix('file:')}/{row.name}"
        data = open(name, "rb").read()
        shard = frames.ShardReader(path, row.name)
        assert len(shard.entries) == row.frames and len(shard.directory) == row.documents and len(data) == row.bytes
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(plain) == 4 * row.ids  # any reader of zstandard takes the file; what is skippable gives nothing
        whole = np.frombuffer(plain, "<u4")
        at = shard.before[shard.directory["frame"]] + shard.directory["first"]
        assert (whole[at + shard.directory["n"] - 1] == packing.CLOSING_ID).all()


def test_lookup_reads_only_its_frames(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(frames, "FRAME_IDS", 500)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        path = stored(spark, docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (name,) = [r.name for r in frames.manifest(spark, path).collect()]
    shard = frames.ShardReader(path, name)
    hit = int(shard.directory["doc_id"][60])
    keep = int(shard.directory["frame"][60])
    file = glob.glob(f"{path.removeprefix('file:')}/{name}")[0]
    data = bytearray(open(file, "rb").read())
    for k in range(len(shard.entries)):
        if k != keep:
            data[int(shard.starts[k]) + 12] ^= 0xFF
    open(file, "wb").write(data)
    (row,) = frames.read(spark, path, [hit, 10**9]).collect()
    text = docs.where(f"doc_id = {hit}").first().text
    assert row.ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    monkeypatch.setattr(frames, "PAUSE", 0.001)
    reader = frames.ShardReader(path, name)
    with pytest.raises((OSError, zstandard.ZstdError)):
        list(reader.fetch([keep + 1]))
    assert frames.read(spark, path, []).count() == 0


def test_files_of_lost_attempts_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    path = stored(spark, docs)
    open(f"{path.removeprefix('file:')}/ids-lost.zst", "wb").write(b"half a shard")
    assert frames.read(spark, path).count() == 30
    with pytest.raises(Exception, match="(?i)exist"):
        frames.write(docs, path, queries.tokenizer_path())


def test_word_table_stays_small():
    table = packing.WordTable(lambda words: [type("E", (), {"ids": [len(w), 7]})() for w in words], bits=6)
    rng = np.random.default_rng(3)
    for _ in range(50):
        words = [f"{w}" for w in rng.integers(0, 400, 20)]
        raw = np.frombuffer("\n".join(words).encode(), np.uint8)
        flat, counts = packing.token_ids(None, table, np.where(raw == 10, 32, raw), np.array([0, len(raw)]))
        assert counts[0] == len(flat) and table.n <= max(table.most, 20)
        assert flat.tolist() == [x for w in words for c in w for x in (1, 7)]
