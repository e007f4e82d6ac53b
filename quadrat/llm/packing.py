"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in the binary form of n (pieces of the
longest allowed length first, as often as they fit).  Every piece is a sequence of its own and sequences of one length
form one bucket, so a batch holds equal lengths, no sequence crosses documents and no position is padding.

The work is one pass over the scan: no shuffle, no state between tasks.  Cases: a null or empty text is the closing id
alone (one piece of length 1); texts of any length are cut whole; repeated rows and repeated or null ``doc_id`` are
packed row by row; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import textbytes as tb

CLOSING_ID = 1
#: Seed of the second hash of a word.
SECOND = 0x5851F42D4C957F2D
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, ids array<int>"


class WordTable:
    """Token ids of words, kept by a worker from task to task.

    The tokenizer cuts a text into words, encodes each word for itself and joins the ids, so a word met before need
    not be encoded again.  Keys are two independent 64-bit hashes of a word in an open-addressing table, so that two words
    share both with a chance of 1e-27 or less.  The table is emptied before it would hold more than ``most`` words or
    ``most_ids`` ids (about 45 MB in all); one step's own words always fit.
    """

    def __init__(self, encode, bits: int = 20):
        self.encode, self.bits = encode, bits
        self.most, self.most_ids = 1 << (bits - 1), 1 << (bits + 2)
        self.clear()

    def clear(self, words: int = 0) -> None:
        """Empty the table; room for ``words`` words at least, more than the usual only where one step has them."""
        size = 1 << max(self.bits, (2 * words).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.seconds = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.slot = np.full(size, -1, np.int32)
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.n = self.n_ids = 0

    def find(self, key: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entry of each pair of hashes, -1 for those that are not there."""
        at = (key & np.uint64(self.mask)).astype(np.int64)
        out = np.where((self.keys[at] == key) & (self.seconds[at] == second), self.slot[at], -1)
        rest = np.flatnonzero((out < 0) & (self.slot[at] >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            here = at[rest]
            hit = (self.keys[here] == key[rest]) & (self.seconds[here] == second[rest]) & (self.slot[here] >= 0)
            out[rest[hit]] = self.slot[here[hit]]
            rest = rest[~hit & (self.slot[here] >= 0)]
        return out

    def add(self, keys: np.ndarray, seconds: np.ndarray, words: list[str]) -> None:
        got = [x.ids for x in self.encode(words)]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.array(list(chain.from_iterable(got)), np.int32)
        while self.n + len(keys) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.first[self.n : self.n + len(keys)] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(keys)] = sizes
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        entry = np.arange(self.n, self.n + len(keys))
        self.n, self.n_ids = self.n + len(keys), self.n_ids + len(flat)
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            free = self.slot[at[rest]] < 0
            place, who = np.unique(at[rest[free]], return_index=True)
            took = rest[free][who]
            self.slot[place], self.keys[place], self.seconds[place] = entry[took], keys[took], seconds[took]
            left = np.ones(len(keys), bool)
            left[took] = False
            rest = rest[left[rest]]
            at[rest] = (at[rest] + 1) & self.mask


def _distinct(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first place of each distinct pair."""
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    return order[np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))]


# The rules of a tokenizer file under which ``token_ids`` may cut words itself.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(spec: dict) -> bool:
    """True if a tokenizer's normaliser and splitter are the ones that ``token_ids`` knows; else it encodes whole texts."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = splits[0] if splits else {}
    special = all(t["content"].startswith("<") and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens") or [])
    return (
        tuple(n["type"] for n in steps) == NORMALIZERS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and first.get("type") == "Split" and first["pattern"] == {"Regex": WORDS} and first["behavior"] == "Removed" and first["invert"] is True
        and [(p["type"], p.get("use_regex"), p.get("add_prefix_space")) for p in splits[1:]] == [("ByteLevel", False, False)] and special
    )


@lru_cache(maxsize=2)
def tools(tokenizer_path: str):
    """The tokenizer of this worker process, and its word table or None where its rules are others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    if not cuts_words(json.loads(tokenizer.to_str())):
        return tokenizer, None
    return tokenizer, WordTable(lambda words: tokenizer.encode_batch_fast(words, add_special_tokens=False))


def _plain(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that the word table may cut: ASCII and two-byte Latin letters, with nothing that the tokenizer treats apart.

    Apostrophes (contractions), '<' (special tokens), control characters and all other characters send the whole row
    to the tokenizer itself.
    """
    odd = np.zeros(256, bool)
    odd[:9] = odd[14:32] = True
    odd[[39, 60, 127]] = True
    odd[0x80:] = True
    bad = odd[raw]
    high = np.flatnonzero(raw >= 0x80)
    if len(high):
        lead = high[raw[high] == 0xC3]
        second = raw[np.minimum(lead + 1, len(raw) - 1)]
        good = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        bad[good] = bad[good + 1] = False
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offsets[1:]] == total[offsets[:-1]]


def token_ids(tokenizer, table: WordTable | None, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after the other, and how many each row has; equal to the tokenizer's own ids."""
    rows = len(offsets) - 1
    if table is None:
        whole = _encoded(tokenizer, raw, offsets, np.arange(rows))
        return np.concatenate([np.zeros(0, np.int32), *whole]), np.array([len(x) for x in whole], np.int64)
    plain = _plain(raw, offsets)
    low = tb.lowered(raw)
    kind = tb.CLASS[raw]
    starts, ends = tb.runs(kind, offsets)
    row = tb.row_of(starts, offsets)
    keep = plain[row]
    starts, ends, row = starts[keep], ends[keep], row[keep]
    digits = kind[starts] == tb.DIGIT
    if digits.any() and (ends - starts)[digits].max() > 1:  # each digit is a word
        sizes = np.where(digits, ends - starts, 1)
        first = tb.ragged(starts, sizes)
        ends = np.where(np.repeat(digits, sizes), first + 1, np.repeat(ends, sizes))
        row, starts = np.repeat(row, sizes), first
    key, second = tb.span_hash(low, starts, ends), tb.span_hash(low, starts, ends, SECOND)
    entry = table.find(key, second)
    new = np.flatnonzero(entry < 0)
    if len(new):
        if table.n_ids > table.most_ids or table.n + len(new) > table.most:
            new = np.arange(len(key))
            table.clear(len(new))
        new = new[_distinct(key[new], second[new])]
        text = low.tobytes()
        table.add(key[new], second[new], [text[starts[i] : ends[i]].decode() for i in new])
        entry = table.find(key, second)
    sizes = table.size[entry].astype(np.int64)
    flat = table.ids[tb.ragged(table.first[entry], sizes)]
    counts = np.bincount(row, sizes, rows).astype(np.int64)
    if plain.all():
        return flat, counts
    ends_of = np.cumsum(counts)
    parts = [flat[b - n : b] for b, n in zip(ends_of, counts)]
    others = np.flatnonzero(~plain)
    for i, ids in zip(others, _encoded(tokenizer, raw, offsets, others)):
        parts[i], counts[i] = ids, len(ids)
    return np.concatenate(parts), counts


def _encoded(tokenizer, raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The tokenizer's own ids of some rows, encoded together."""
    texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in rows]
    return [np.asarray(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def closed(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts with the closing id behind each row's."""
    out = np.full(len(flat) + len(counts), CLOSING_ID, np.int32)
    body = np.ones(len(out), bool)
    body[np.cumsum(counts + 1) - 1] = False
    out[body] = flat
    return out, counts + 1


def pieces_of(length: int, most: int) -> list[int]:
    """Powers of two that add up to ``length``: the longest allowed as often as it fits, then the binary form."""
    whole, rest = divmod(length, most)
    return [most] * whole + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids.

    ``sequence_id`` numbers a piece within its task and carries the bucket (log2 of the length) in its last four bits;
    rows keep their place in a scan, so a task that runs again gives the same numbers.
    """
    if max_length < 1 or max_length & (max_length - 1) or max_length > 1 << 15:
        raise ValueError("max_length must be a power of two up to 32768")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table = tools(tokenizer_path)
        for batch in tb.tidy(batches):
            names = batch.column(0)
            for a, z, raw, offsets in tb.steps(batch.column(1)):
                flat, counts = token_ids(tokenizer, table, raw, offsets)
                yield _pieces(names.slice(a, z - a), flat, counts, max_length, with_ids)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, PIECES)
    number = F.shiftleft(F.monotonically_increasing_id(), 4).bitwiseOR(F.log2("length").cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset", "ids")


def _pieces(names: pa.Array, flat: np.ndarray, counts: np.ndarray, most: int, with_ids: bool) -> pa.RecordBatch:
    rows, start, size, crc, parts = [], [], [], [], []
    at = 0
    for i, n in enumerate(counts):
        ids = np.append(flat[at : at + n], CLOSING_ID).astype("<u4")
        at += n
        begin = 0
        for piece in pieces_of(len(ids), most):
            part = ids[begin : begin + piece]
            rows.append(i)
            start.append(begin)
            size.append(piece)
            crc.append(zlib.crc32(part.tobytes()))
            parts.append(part)
            begin += piece
    rows = np.asarray(rows, np.int64)
    if with_ids:
        where = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(where), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))
    else:
        ids = pa.nulls(len(rows), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(rows)),
            pa.array(start, pa.int64()),
            pa.array(size, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array(counts[rows] + 1 if len(rows) else [], pa.int64()),
            pa.array(np.zeros(len(rows), np.int64)),
            ids,
        ],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "ids"],
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences bucketed by length: one folder a length, so that a reader gets batches of equal lengths."""
    pieces.write.partitionBy("length").mode("errorifexists").parquet(path)
