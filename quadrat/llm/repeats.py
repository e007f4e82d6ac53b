"""Removal of byte strings that repeat anywhere, by prefix-free parsing.

Phrases: a byte is a trigger where the rolling hash of the 16 bytes from it is the least of a window of ``WINDOW``
places; a phrase runs from a trigger to the end of the next trigger's 16 bytes, so that no phrase suffix in question is a
prefix of another.  The dictionary holds the phrases that stand twice, in one order; the parse of a text is its sequence
of phrase numbers.

Suffix order of the parse: distributed prefix doubling ranks the sequences of 1, 2, 4, ... phrases that stand twice; two
ranks that overlap name a sequence of any length, an interval of that order.

Combination: of a string of ``LENGTH`` bytes the triggers of its first and of its last window are known from the string
alone, and so are all phrases between them.  Starts with the same two triggers are a class.  A class has an inner sequence,
the phrases between its triggers, and a covering one, the phrases that hold every string that starts in it.  If the inner
sequence stands nowhere else no start has a copy; if the covering one stands twice all have one.  Only classes at the ends
of repeats are left, with a shared inner and a lone covering sequence: there the rest of a string is a suffix of the
phrase before and a prefix of the phrase after, and starts are compared by these dictionary strings, first in ranges of
``RANGE`` starts and then one by one, each against one class of each covering sequence.

Phrases are named by 128 bits, ranges by 64 bits and single strings by 128 bits of polynomial hashes; ranks are exact.
Sums by name combine before a shuffle, and tables to join with are written first, so that the join can split a very common
phrase over tasks.

Cases: null and empty texts have 0 bytes and the digest of nothing; texts shorter than LENGTH lose nothing; matches
never cross texts; repeated rows are copies of each other; null or repeated ``doc_id`` are kept row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm import textbytes as tb
from quadrat.llm.shared import dropped, keyed, ranks, written

LENGTH, WINDOW, RANGE, GRAM = 200, 92, 16, 16
#: From the first window of a string to its last one; the two never share a trigger.
STEP = LENGTH - (GRAM - 1) - WINDOW
#: Bytes of text that one step hashes, and texts whose rows one step gives on.
STEP_BYTES, STEP_TEXTS = 1 << 18, 500
UID = "__quadrat_row"
#: A trigger's place, and the least and largest distance of its starts, in one long.
NAMES = "uid long, at long, core long, context long"
_PLACE = (1 << 28) - 1


def pack(trigger: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (trigger << 16) | (high << 8) | low


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, at & 255, (at >> 8) & 255


_LOW = 1 << 16


@lru_cache(maxsize=8)
def _powers(high: int) -> list[tuple[np.ndarray, ...]]:
    """For two bases: values of bytes, and powers and inverse powers of 0 to 2^16 and of multiples of 2^16."""
    out = []
    for seed, base in ((3, 0x9E3779B97F4A7C15), (4, 0xC2B2AE3D27D4EB4F)):
        values = np.random.default_rng(seed).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            for factor, n in ((b, _LOW), (pow(b, _LOW, 1 << 64), high)):
                table = np.full(n, factor, np.uint64)
                table[0] = 1
                tables.append(np.multiply.accumulate(table))
        out.append((values, *tables))
    return out


class Hashes:
    """Hashes of any stretch of some bytes under either base."""

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        self.tables = _powers(1 << max(6, (n >> 16).bit_length()))
        self.sums = []
        for values, low, high, _, _ in self.tables:
            total = np.zeros(n, np.uint64)
            for i in range(0, n - 1, _LOW):
                part = raw[i : i + _LOW]
                total[i + 1 : i + 1 + len(part)] = values[part] * low[: len(part)] * high[i >> 16]
            self.sums.append(np.cumsum(total, out=total))

    def _down(self, base: int, at: np.ndarray) -> np.ndarray:
        _, _, _, low, high = self.tables[base]
        return low[at & (_LOW - 1)] * high[at >> 16]

    def __call__(self, base: int, begin: np.ndarray, end: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
        total = self.sums[base]
        value = (total[end] - total[begin]) * self._down(base, begin)
        return tb.mix(value ^ (np.asarray(end - begin, np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.asarray(more).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, done = values, 1
    while done * 2 <= width:
        out, done = np.minimum(out[:-done], out[done:]), done * 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def triggers(hashes: Hashes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigger, turn) of all texts of LENGTH bytes at least: a trigger is that of the windows from its turn on."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= LENGTH)
    if not len(long):
        return (np.zeros(0, np.int64),) * 3
    grams = int(offsets[-1]) - GRAM + 1
    at = np.arange(grams)
    place = at.astype(np.uint64) & np.uint64(_PLACE)
    least = _least((hashes(0, at, at + GRAM) & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - place), WINDOW)  # of equals the last
    windows = sizes[long] - (GRAM - 1) - (WINDOW - 1)
    x = tb.ragged(offsets[long], windows)
    text = np.repeat(long, windows)
    trigger = x + ((np.uint64(_PLACE) - (least[x] & np.uint64(_PLACE))).astype(np.int64) - x & _PLACE)
    new = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])))
    return text[new], trigger[new], x[new]


def names(hashes: Hashes, begin: int, end: int, at: tuple, low: np.ndarray, high: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(core, context) of triggers whose starts are ``low`` to ``high`` bytes before them, whole ranges."""
    trigger = begin + at
    core = hashes(0, trigger - low, trigger - high + LENGTH)
    a, z = np.maximum(trigger - high, begin), np.minimum(trigger - low + LENGTH, end)
    cut = (trigger - a) * 1024 + (z - trigger)
    return core, hashes(1, a, z, 0 if single else cut)


CUT = "uid long, size int, at array<int>, turn array<int>, most int, a array<long>, b array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut into phrases: triggers, their turns, and the two names of each phrase; phrase 0 begins with the text."""
    for batch in batches:
        for first, z, raw, offsets in tb.steps(batch.column(1), STEP_BYTES):
            hashes = Hashes(raw)
            text, trigger, turn = triggers(hashes, offsets)
            begin = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
            own, count = text[begin], np.diff(np.append(begin, len(text)))
            rows = len(own)
            # One phrase more than triggers: from the text's start, then from each trigger.
            place = np.arange(len(text)) + np.searchsorted(begin, np.arange(len(text)), "right")
            starts, ends = np.empty(len(text) + rows, np.int64), np.empty(len(text) + rows, np.int64)
            starts[place], ends[place - 1] = trigger, trigger + GRAM
            heads = begin + np.arange(rows)
            starts[heads], ends[heads + count] = offsets[own], offsets[own + 1]
            where = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = lambda values, sizes: pa.ListArray.from_arrays(where(sizes), pa.array(values))
            base = np.repeat(offsets[own], count)
            at, since = (trigger - base).astype(np.int32), (turn - base).astype(np.int32)
            size = np.diff(offsets)[own].astype(np.int32)
            most = [int(_longest(at[i : i + n], since[i : i + n], int(m))) for i, n, m in zip(begin, count, size)]
            columns = [
                batch.column(0).slice(first, z - first).take(pa.array(own)),
                pa.array(size), lists(at, count), lists(since, count), pa.array(most, pa.int32()),
                *[lists(hashes(k, starts, ends).view(np.int64), count + 1) for k in (0, 1)],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "size", "at", "turn", "most", "a", "b"])


def classes(at: np.ndarray, turn: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(low, high, k, l, from, to) of the classes of starts of a text.

    Strings that start in [low, high] have triggers k and l (from 0) in their first and last windows; phrases from + 1 to
    to hold them all, where phrase i + 1 begins at trigger i.
    """
    final = size - LENGTH
    edges = np.unique(np.concatenate([turn, turn - STEP]))
    low = edges[(edges >= 0) & (edges <= final)]
    low = low if len(low) and low[0] == 0 else np.append(0, low)
    high = np.append(low[1:] - 1, final)
    k, l = np.searchsorted(turn, low, "right") - 1, np.searchsorted(turn, low + STEP, "right") - 1
    return low, high, k, l, np.searchsorted(at, low, "right") - 1, np.searchsorted(at + GRAM, high + LENGTH)


def _longest(at: np.ndarray, turn: np.ndarray, size: int) -> int:
    """Most phrases that a class of starts of a text is covered by."""
    *_, a, z = classes(at, turn, size)
    return (z - a).max()


CLASSES = "uid long, at long, inner long, cn long, cr long, cs long, settled boolean"


def _classes(levels: int):
    """A task that gives the classes of texts their inner and covering sequences, as numbers of phrases and two ranks.

    Classes whose inner sequence stands nowhere else are left out.  ``settled`` are those that lie in a sequence of 2^j
    phrases that stands twice; of the others a covering sequence that stands nowhere else has cn 0 and its place.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP_TEXTS) for b in batches for i in range(0, len(b), STEP_TEXTS)):
            parts = []
            for i in range(len(batch)):
                uid, size = batch.column("uid")[i].as_py(), batch.column("size")[i].as_py()
                at, turn = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("at", "turn"))
                known = batch.column("ranks")[i].values
                table = np.full((levels, len(at) + 1), -1, np.int64)
                table[known.field("j").to_numpy(), known.field("k").to_numpy()] = known.field("rank").to_numpy()
                low, high, k, l, a, z = classes(at, turn, size)
                n, r, s = _sequence(table, k + 1, l - k)
                keep = np.flatnonzero((r >= 0) & (s >= 0))
                low, high, k, a, z, n, r, s = (x[keep] for x in (low, high, k, a, z, n, r, s))
                cn, cr, cs = _sequence(table, a + 1, z - a)
                lone = (cr < 0) | (cs < 0)
                cn = cn << 32 | (k - a) << 16 | n  # with the place and length of the inner sequence in it
                first = at[k]
                inner = tb.mix(tb.mix(r.astype(np.uint64) + tb.mix(n.astype(np.uint64))) ^ s.astype(np.uint64)).view(np.int64)
                parts.append((np.full(len(low), uid), pack(first, first - high, first - low), inner, np.where(lone, 0, cn), np.where(lone, uid, cr), np.where(lone, low, cs), _within(table, a + 1, z - a)))
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6 + [np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "at", "inner", "cn", "cr", "cs", "settled"])

    return task


def _within(table: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """True for sequences that lie in one of 2^j phrases that has a rank, 2^j the least power from n on."""
    out = np.zeros(len(n), bool)
    power = np.frexp(n - 0.5)[1]
    for j in range(len(table)):
        which = np.flatnonzero(power == j)
        if len(which):
            has = np.concatenate([[0], np.cumsum(table[j] >= 0)])
            last = begin[which]
            first = np.maximum(last + n[which] - (1 << j), 0)
            out[which] = has[np.maximum(last, first - 1) + 1] > has[first]
    return out


def _sequence(table: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, rank of its first 2^j phrases, rank of its last) of sequences; 2^j is the largest power up to n."""
    j = np.frexp(n)[1] - 1
    return n, table[j, begin], table[j, begin + n - (1 << j)]


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], ["uid", "at", "core", "context"])


def _split(width: int):
    """A task that cuts given triggers of texts into ranges of ``width`` distances and names those."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, offsets in tb.steps(batch.column(1), STEP_BYTES):
                hashes, parts = Hashes(raw), []
                for i in range(len(offsets) - 1):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    at, low, high = unpack(batch.column(2)[a + i].values.to_numpy(zero_copy_only=False))
                    first = low // width
                    n = high // width - first + 1
                    part = tb.ragged(first, n) * width
                    at, low, high = (np.repeat(x, n) for x in (at, low, high))
                    # Classes of one trigger may share a range: it stands at one place, so it is one row.
                    _, where, same = np.unique(at * 256 + part, return_index=True, return_inverse=True)
                    below, above = np.full(len(where), 255), np.zeros(len(where), np.int64)
                    np.minimum.at(below, same, low)
                    np.maximum.at(above, same, high)
                    at, part, low, high = at[where], part[where], below, above
                    found = names(hashes, begin, end, at, part, part + width - 1, width == 1)
                    uid = np.full(len(at), batch.column(0)[a + i].as_py())
                    parts.append((uid, pack(at, np.maximum(low, part), np.minimum(high, part + width - 1)), *found))
                yield _rows(parts)

    return task


def _spans(rows: DataFrame) -> DataFrame:
    """uid, begin and end of the bytes that strings with the packed starts cover."""
    trigger, low, high = F.shiftright("at", 16), F.col("at").bitwiseAND(255), F.shiftright("at", 8).bitwiseAND(255)
    return rows.select("uid", (trigger - high).alias("begin"), (trigger - low + LENGTH).alias("end"))


def _sorted_out(rows: DataFrame, inner: list[str], cover: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows all of whose starts have a copy, rows to split further with what they are held against), of written rows.

    ``settled`` rows have a copy whatever their group shows.
    """
    groups = written(rows.groupBy(*inner, *cover).agg(F.count("*").alias("count"), F.min(F.struct("uid", "at")).alias("one")), "groups")
    sizes = groups.groupBy(*inner).agg(F.sum("count").alias("all"), F.min("count").alias("least"))
    twice = written(groups.where("count > 1").select(*inner, *cover), "twice")
    open_ = written(sizes.where("all > 1 and least = 1").select(*inner), "open")
    full = rows.where("not settled").join(twice, [*inner, *cover], "left_semi").unionByName(rows.where("settled"))
    full, ends = written(_spans(full), "full"), written(groups.join(open_, inner, "left_semi").select("one.uid", "one.at"), "ends")
    dropped(groups, twice, open_)
    return full, ends


def parsed(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(texts cut into phrases; ranks of their sequences of 2^j phrases: uid, k, j, rank; number of levels)."""
    cut = written(texts.where(F.length("data") >= LENGTH).select("uid", "data").mapInArrow(_cut, CUT), "phrases")
    levels = (cut.agg(F.max("most")).first()[0] or 1).bit_length()
    phrases = cut.select("uid", "most", F.posexplode(F.arrays_zip("a", "b")).alias("k", "e")).select("uid", "most", "k", "e.a", "e.b")
    dictionary = ranks(phrases, ["a", "b"])
    level = written(phrases.join(dictionary, ["a", "b"]).select("uid", "most", "k", "rank"), "level")
    dropped(dictionary)
    parse = level.withColumn("j", F.lit(0))
    for j in range(1, levels):  # texts whose classes are covered by fewer than 2^j phrases are done
        on = 1 << (j - 1)
        ahead = Window.partitionBy("uid").orderBy("k").rangeBetween(on, on)
        pairs = level.where(F.col("most") >= 1 << j).withColumn("next", F.max("rank").over(ahead)).where("next is not null")
        pairs = written(pairs.withColumnRenamed("rank", "own"), "pairs")
        order = ranks(pairs, ["own", "next"])
        level = written(pairs.join(order, ["own", "next"]).select("uid", "most", "k", "rank"), "level")
        dropped(pairs, order)
        parse = parse.unionByName(level.withColumn("j", F.lit(j)))
    return cut.select("uid", "size", "at", "turn"), parse.select("uid", "k", "j", "rank"), levels


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that lose bytes or may: uid and data; (uid, list of byte spans, each a begin and an end))."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data")
    texts = docs.select(F.col(UID).alias("uid"), text)
    cut, parse, levels = parsed(texts)
    own = parse.groupBy("uid").agg(F.collect_list(F.struct("k", "j", "rank")).alias("ranks"))  # of one text
    rows = written(cut.join(own, "uid").mapInArrow(_classes(levels), CLASSES), "classes")
    dropped(cut, parse)
    out, ends = _sorted_out(rows, ["inner"], ["cn", "cr", "cs"])
    dropped(rows)
    known = written(texts.join(out.select("uid").union(ends.select("uid")).distinct(), "uid", "left_semi"), "texts")
    for width in (RANGE, 1):
        wanted = ends.groupBy("uid").agg(F.collect_list("at").alias("at"))  # of one text
        rows = written(known.join(wanted, "uid").select("uid", "data", "at").mapInArrow(_split(width), NAMES).withColumn("settled", F.lit(False)), "ranges")
        dropped(ends)
        full, ends = _sorted_out(rows, ["core"], ["context"])
        dropped(rows)
        out = out.unionByName(full)
    return known, out.groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("at"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, STEP_TEXTS) for b in batches for i in range(0, len(b), STEP_TEXTS)):
        out = []
        for uid, data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            begin, end = (at.values.field(c).to_numpy() for c in ("begin", "end"))
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((uid, int(gone.sum()), spans, kept))
        columns = list(zip(*out)) if out else [()] * 4
        digests = [hashlib.sha256(k).hexdigest() for k in columns[3]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(digests, pa.string())], ["uid", "removed", "spans", "kept", "digest"])


def _changed(docs: DataFrame) -> DataFrame:
    known, starts = covered(docs)
    return known.join(starts, "uid").select("uid", "data", "at").mapInArrow(_remove, "uid long, removed long, spans long, kept binary, digest string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = keyed(docs.select("doc_id", "text"), UID)
    found = _changed(rows).drop("kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = rows.select(F.col(UID), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("plain"))
    out = plain.join(found, F.col(UID) == F.col("uid"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("digest", "plain").alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and the bytes left of the rows that lose some."""
    rows = keyed(docs.select("doc_id", "text"), UID)
    return rows.select(UID, "doc_id").join(_changed(rows).where("removed > 0"), F.col(UID) == F.col("uid")).select("doc_id", "kept")
