"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the weighted set of its shingles (five words next to each other, lower case; all words where there are
fewer), a shingle weighing as often as it occurs.  Similarity is the probability Jaccard index, which is the plain one
where every shingle occurs once; texts are linked from ``SIMILARITY`` on, and a class is a connected component of links.

Signatures: every shingle sends exponential arrivals to the registers in an order of its own; the k-th arrival waits for
the rest of the registers only, so that each register sees one arrival of rate ``weight``.  A register keeps the shingle
that arrives first, and a shingle stops once it is later than all registers of its text.  Bands are fixed subsets of
registers; texts that agree in a band share a bucket.

Equal texts are one node.  Classes grow in rounds.  In a round every bucket that still holds two classes has a pivot, the
node that meets most others over all its buckets, so that one node serves as pivot of most buckets of a group of near
copies; the other classes' nodes are verified against it, the classes that this links are merged, and the pivot leaves
the bucket: a round costs one pair a member at most, mostly far less.  The first ``ROUNDS`` rounds are over ``LEAD`` bands
only; of the other bands only buckets that hold two classes by then are joined with their members, so that a group that
is one class meets itself in ``LEAD`` buckets a node and not in all.  After as many rounds over those every two nodes that
still share a bucket but no class are compared within the join, first by four bits of each register and then by the exact
index on their shingles, in the least bucket that they share: only true links come out, so copies are never expanded
into pairs and no link between two classes is left out.  Buckets of more than ``CHUNK`` nodes are split over tasks.

Cases: null and empty texts, and texts without a letter or digit, have no shingles; equal ones are copies of each other
like other equal texts, and nothing else is linked to them.  Null ``doc_id`` are rows like others; a class is named by
its least doc_id (null only if it has no other); repeated rows share a class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import textbytes as tb
from quadrat.llm.shared import written

WORDS, SIMILARITY = 5, 0.8
REGISTERS, BANDS, ROWS = 256, 64, 8
#: A similarity that is the threshold but for rounding is a link.
ENOUGH = SIMILARITY - 1e-9
#: Texts whose registers agree in a smaller share are not verified: six standard deviations below SIMILARITY.
LEAST_AGREEMENT = 0.64
#: Rounds of pivots before the rest is compared; more or fewer change the work, not the classes.
ROUNDS = 2
#: Bands whose buckets are merged by rounds before the others' are looked at; more or fewer change the work, not the classes.
LEAD = 8
#: Members of a bucket that one task compares with the others of that bucket.
CHUNK = 4096
#: Registers in each long of a sketch, at four bits each.
PER_LONG = 16

_FIELDS = np.stack([np.random.default_rng(20 + b).permutation(REGISTERS)[:ROWS] for b in range(BANDS)])


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, occurrences), sorted by row and hash."""
    word = ((tb.CLASS == tb.LETTER) | (tb.CLASS == tb.DIGIT)).astype(np.uint8)[raw]
    starts, ends = tb.runs(word, offsets)
    row = tb.row_of(starts, offsets)
    key = tb.span_hash(tb.lowered(raw), starts, ends)
    n = len(key)
    sizes = np.bincount(row, minlength=len(offsets) - 1)
    take = np.minimum(sizes, WORDS)[row]  # words of the shingle that starts here
    first = np.cumsum(sizes) - sizes
    whole = np.arange(n) - first[row] <= sizes[row] - take
    out = np.zeros(n, np.uint64)
    for i in range(WORDS):
        part = np.zeros(n, np.uint64)
        part[: n - i] = key[i:]
        out = np.where(i < take, tb.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ part), out)
    row, out = row[whole], out[whole]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], out[at], np.diff(np.append(at, len(out)))


def registers(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The shingle in each register of each row (0 where a row has none)."""
    m = REGISTERS
    time, held = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    a = (tb.mix(shingle ^ np.uint64(0xA5A5)) & np.uint64(m - 1)) | np.uint64(1)
    b = tb.mix(shingle ^ np.uint64(0x5A5A))
    live, x = np.arange(len(row)), np.zeros(len(row))
    for k in range(m):
        s = shingle[live]
        u = ((tb.mix(s + np.uint64((k + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        x = x - np.log(u) / (weight[live] * (m - k))
        place = row[live] * m + ((a[live] * np.uint64(k) + b[live]) & np.uint64(m - 1)).astype(np.int64)
        better = np.flatnonzero(x < time[place])
        order = better[np.argsort(-x[better], kind="stable")]  # the earliest is written last
        time[place[order]], held[place[order]] = x[order], s[order]
        last = time.reshape(rows, m).max(1)
        keep = x < last[row[live]]
        live, x = live[keep], x[keep]
        if not len(live):
            break
    return held.reshape(rows, m)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text digest, sketch and band keys (null without shingles) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.tidy(batches):
            for a, z, raw, offsets in tb.steps(batch.column(2)):
                row, key, n = shingles(raw, offsets)
                held = registers(row, key, n, z - a)
                four = (tb.mix(held) & np.uint64(15)).reshape(z - a, -1, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(4))
                sketch = np.bitwise_or.reduce(four, 2).view(np.int64)
                bands = np.stack([_band(held[:, f], i) for i, f in enumerate(_FIELDS)], 1) if z > a else np.zeros((0, BANDS), np.uint64)
                none = np.bincount(row, minlength=z - a) == 0
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, z - a),
                        batch.column(1).slice(a, z - a),
                        pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), REGISTERS // PER_LONG).cast(pa.list_(pa.int64())),
                        pa.compute.if_else(pa.array(~none), lists, pa.scalar(None, lists.type)),
                    ],
                    ["doc_id", "node", "sketch", "bands"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text")).mapInArrow(sign, "doc_id long, node binary, sketch array<long>, bands array<long>")


def _band(held: np.ndarray, band: int) -> np.ndarray:
    out = np.full(len(held), band + 1, np.uint64)
    for j in range(held.shape[1]):
        out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ held[:, j])
    return out


def similarity(a: tuple, b: tuple, pairs: int) -> np.ndarray:
    """Probability Jaccard index of pairs of shingle tables, each (pair, shingle, occurrences) sorted by both."""
    pair = np.concatenate([a[0], b[0]])
    key = np.concatenate([a[1], b[1]])
    side = np.repeat([0, 1], [len(a[0]), len(b[0])])
    count = np.concatenate([a[2], b[2]]).astype(float)
    order = np.lexsort((side, key, pair))
    pair, key, side, count = pair[order], key[order], side[order], count[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    n = int(new.sum())
    x, y = np.bincount(group, count * (side == 0), n), np.bincount(group, count * (side == 1), n)
    pair = pair[new]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.lexsort((ratio, pair))
    pair, x, y = pair[order], x[order], y[order]
    start = np.searchsorted(pair, np.arange(pairs + 1))
    sx, sy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    place = np.arange(n)
    above = sx[start[pair + 1]] - sx[place]  # x of this and all larger ratios
    below = sy[place] - sy[start[pair]]
    both = (x > 0) & (y > 0)
    return np.bincount(pair[both], 1 / (above[both] / x[both] + below[both] / y[both]), pairs)


def agreement(a: Column, b: Column) -> Column:
    """Share of registers in which two sketches agree, less what four bits agree by chance."""

    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftright(z, 1))
        z = z.bitwiseOR(F.shiftright(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda t, x: t + x)
    return 1 - differ * (16 / 15 / REGISTERS)


class Verifier:
    """Exact similarities of pairs of nodes; pairs whose sketches agree too little are left out."""

    def __init__(self, sketches: DataFrame, texts: DataFrame):
        self.sketches, self.texts = sketches, texts

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(p, q, j) of distinct pairs (p, q)."""

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tb.tidy(batches):
                for i in range(0, len(batch), 128):
                    part = batch.slice(i, 128)
                    sides = [[np.concatenate(x) for x in zip(*((s[0] + a, *s[1:]) for a, _, raw, offsets in tb.steps(part.column(c)) for s in [shingles(raw, offsets)]))] for c in ("tp", "tq")]
                    yield pa.RecordBatch.from_arrays([part.column("p"), part.column("q"), pa.array(similarity(*sides, len(part)))], ["p", "q", "j"])

        near = pairs.join(self.sketches.toDF("p", "sp"), "p").join(self.sketches.toDF("q", "sq"), "q")
        near = near.where(agreement(F.col("sp"), F.col("sq")) >= LEAST_AGREEMENT).select("p", "q")
        full = near.join(self.texts.toDF("p", "tp"), "p").join(self.texts.toDF("q", "tq"), "q")
        return written(full.mapInArrow(measure, "p binary, q binary, j double"), "verified")

    def shingle_sets(self, nodes: DataFrame) -> DataFrame:
        """node and its shingles by how often they occur: an array of (w, s)."""

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tb.tidy(batches):
                for a, z, raw, offsets in tb.steps(batch.column(1)):
                    row, key, n = shingles(raw, offsets)
                    order = np.lexsort((key, n, row))
                    row, key, n = row[order], key[order], n[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (row[1:] != row[:-1]) | (n[1:] != n[:-1])
                    at = np.flatnonzero(new)
                    inner = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), pa.array(key.view(np.int64)))
                    each = pa.StructArray.from_arrays([pa.array(n[at].astype(np.int32)), inner], ["w", "s"])
                    where = np.searchsorted(row[at], np.arange(z - a + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.ListArray.from_arrays(pa.array(where), each)], ["node", "shingles"])

        return self.texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(sets, "node binary, shingles array<struct<w:int,s:array<long>>>")


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + of(v))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_index(p: Column, q: Column) -> Column:
    """Probability Jaccard index of two arrays of (w, s), as ``similarity`` gives it.

    A shared shingle of counts x and y adds 1 / (sum over all of max(x_j / x, y_j / y)); shingles of equal counts on both
    sides add the same, so the sum runs over pairs of counts.
    """

    def size(side: Column) -> Column:
        return _total(side, lambda e: e["w"] * F.size(e["s"]))

    def of(shared: Column) -> Column:
        only_p = size(p) - _total(shared, lambda e: e["c"] * e["x"])
        only_q = size(q) - _total(shared, lambda e: e["c"] * e["y"])

        def term(e: Column, more: Column, less: Column) -> Column:
            above = F.filter(shared, lambda o: o["x"] * e["y"] >= e["x"] * o["y"])
            below = F.filter(shared, lambda o: o["x"] * e["y"] < e["x"] * o["y"])
            return e["c"] / ((more + _total(above, lambda o: o["c"] * o["x"])) / e["x"] + (less + _total(below, lambda o: o["c"] * o["y"])) / e["y"])

        return _once(only_p, lambda more: _once(only_q, lambda less: _total(shared, lambda e: term(e, more, less))))

    pairs = F.flatten(F.transform(p, lambda a: F.transform(q, lambda b: F.struct(a["w"].alias("x"), b["w"].alias("y"), F.size(F.array_intersect(a["s"], b["s"])).alias("c")))))
    return _once(F.filter(pairs, lambda e: e["c"] > 0), of)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a link: the least node of the component, by spreading and shortening labels.

    A node of more than CHUNK links is split over tasks wherever rows meet its label.
    """
    both = links.select("p", "q").unionByName(links.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    nodes = written(both.groupBy(F.col("p").alias("node")).agg(F.least(F.min("q"), F.first("p")).alias("label"), F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "labels")
    many = nodes.where("parts > 1").select(F.col("node").alias("q"), "parts")
    edges = both.join(many, "q", "left").select("p", "q", F.pmod(F.xxhash64("p"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    edges, labels = written(edges, "edges"), nodes
    while True:
        known = labels.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        told = edges.join(known, (edges.q == known.node) & (edges.part == known.part)).groupBy("p").agg(F.min("label").alias("told"))
        spread = written(labels.join(told, labels.node == told.p).select("node", "label", "parts", F.least("label", "told").alias("next")), "spread")
        # One row for each label that is in use, and as many as a label with many nodes has parts.
        used = spread.groupBy("next").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
        jump = used.join(labels.select(F.col("node").alias("next"), F.col("label").alias("jump")), "next")
        jump = written(jump.where("jump < next"), "jump")
        if not jump.isEmpty():
            split = spread.join(jump.where("n > 1").select("next", "n"), "next", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("n", F.lit(1))).cast("int"))
            jump = jump.select("next", "jump", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
            spread = split.join(jump, ["next", "part"], "left").select("node", "label", "parts", F.least("next", "jump").alias("next"))
        after = written(spread.select("node", F.col("next").alias("label"), "parts", (F.col("next") != F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label", "parts")
        if after.where("changed").isEmpty():
            return labels.select("node", "label")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) after links between nodes of the classes so far; nodes without a row are their own class."""
    if labels is None:
        return components(links)
    for side in "pq":
        name = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        links = links.join(name, side, "left").withColumn(side, F.coalesce(f"{side}_label", side)).drop(f"{side}_label")
    links = written(links.select("p", "q").distinct(), "class-links")
    if links.isEmpty():
        return labels
    found = components(links)
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("into")), "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    return written(moved.unionByName(found.join(labels, "node", "left_anti")), "labels")


def _sides(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` (key, node and more) with the class of each."""
    side = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return written(side, "sides")


def _two_classes(side: DataFrame, *more: Column) -> DataFrame:
    """key and ``more`` of the buckets that hold two classes."""
    return side.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), *more).where("low <> high").drop("low", "high")


def _split_buckets(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, label) of the members of buckets that hold two classes."""
    side = _sides(members, labels)
    return side.join(written(_two_classes(side), "split"), "key")


def _against_pivots(side: DataFrame, verify: Verifier) -> tuple[DataFrame, DataFrame]:
    """(links of bucket members to the pivot of another class, members (key, node, weight) besides the pivots).

    ``side`` has key, node, weight and label; buckets of one class get no pivot, and their members go no further.
    """
    top = written(_two_classes(side, F.max(F.struct("weight", "node", "label")).alias("top")), "pivots")
    pivots = top.select("key", F.col("top.node").alias("p"), F.col("top.label").alias("p_label"))
    tried = written(side.join(pivots, "key").where("node <> p"), "tried")
    pairs = tried.where("label <> p_label").select("p", F.col("node").alias("q")).distinct()
    links = verify(pairs).where(F.col("j") >= ENOUGH).select("p", "q")
    return links, tried.select("key", "node", "weight")


def _open_buckets(nodes: DataFrame, labels: DataFrame | None, bands: Column) -> DataFrame:
    """(key, node, n) of the members of buckets of the given bands that hold two classes, n being the bucket's members; labels are told apart by 64 bits.

    Buckets of one class are never joined with their members: each bucket is summed up before the shuffle.
    """
    own = nodes.select("node", bands.alias("keys"))
    own = own.withColumn("label", F.col("node")) if labels is None else own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    places = own.select("node", F.xxhash64("label").alias("label"), F.explode("keys").alias("key"))
    split = written(_two_classes(places, F.count("*").alias("n")), "open")
    return written(places.select("key", "node").join(split, "key"), "buckets")


def _rounds(members: DataFrame, labels: DataFrame | None, rounds: int, verify: Verifier) -> tuple[DataFrame | None, DataFrame]:
    """(labels after so many rounds of pivots, members (key, node) that are left)."""
    if not rounds:
        return labels, members.select("key", "node")
    weights = written(members.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    members = members.select("key", "node").join(weights, "node")
    for _ in range(rounds):
        links, members = _against_pivots(_sides(members, labels), verify)
        labels = _merged(labels, links)
    return labels, members.select("key", "node")


def _labels(docs: DataFrame, signed: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, labels of those that are linked)."""
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "nodes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.unhex(F.md5(text)).alias("own"), text.alias("text"))

    def verifier(members: DataFrame) -> Verifier:
        wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
        texts = wanted.join(own, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
        return Verifier(nodes.select("node", "sketch"), written(texts.select("node", "text").dropDuplicates(["node"]), "texts"))

    first = _open_buckets(nodes, None, F.slice("bands", 1, LEAD))
    labels, first = _rounds(first, None, rounds, verifier(first))
    others = _open_buckets(nodes, labels, F.slice("bands", LEAD + 1, BANDS - LEAD))
    verify = verifier(others.select("key", "node").unionByName(first))
    labels, others = _rounds(others, labels, rounds, verify)
    side = written(_split_buckets(first.unionByName(others), labels), "rest")
    parts = written(verify.shingle_sets(side.select("node").distinct()), "parts")
    known = nodes.join(parts, "node").select("node", "sketch", "bands", "shingles")
    links = _links(written(side.join(known, "node"), "compared"))
    return nodes, _merged(labels, links)


def _links(side: DataFrame) -> DataFrame:
    """Links (p, q) between members of one bucket and two classes."""
    size = side.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    side = side.join(written(size, "large"), "key", "left").na.fill(1, ["chunks"])
    own = F.struct("node", "label", "sketch", "bands", "shingles")
    a = side.select(F.col("key").alias("key_p"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk_p"), own.alias("p"))
    b = side.select(F.col("key").alias("key_q"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_q"), own.alias("q"))
    apart = (F.col("p.node") < F.col("q.node")) & (F.col("p.label") != F.col("q.label"))
    # Each is asked only where the one before holds.
    here = F.when(agreement(F.col("p.sketch"), F.col("q.sketch")) >= LEAST_AGREEMENT, F.array_min(F.array_intersect("p.bands", "q.bands")) == F.col("key_p"))
    alike = F.when(F.when(apart, here), exact_index(F.col("p.shingles"), F.col("q.shingles")) >= ENOUGH).otherwise(False)
    found = a.join(b, (F.col("key_p") == F.col("key_q")) & (F.col("chunk_p") == F.col("chunk_q")) & alike)
    return written(found.select(F.col("p.node").alias("p"), F.col("q.node").alias("q")), "links")


def _classes(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(signed rows, (node, doc_id, class, class_id))."""
    signed = written(signatures(docs), "signatures")
    nodes, labels = _labels(docs, signed, rounds)
    full = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("class"))
    names = full.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return signed, written(full.join(names, "class").select("node", "doc_id", "class", "class_id"), "classes")


def classes(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and class_id of every row."""
    signed, named = _classes(docs, rounds)
    return signed.select("doc_id", "node").join(named.select("node", "class_id"), "node").select("doc_id", "class_id")


def dedup(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, of which one stays for each class: that of the least doc_id."""
    signed, named = _classes(docs)
    best = named.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best")).select("best.doc_id", "best.node")
    best = best.toDF("__quadrat_id", "__quadrat_node")
    same = signed.groupBy("doc_id", "node").count().where("count > 1").toDF("__quadrat_again_id", "__quadrat_again", "__quadrat_n")
    best = best.join(same, (F.col("__quadrat_node") == F.col("__quadrat_again")) & F.col("__quadrat_id").eqNullSafe(F.col("__quadrat_again_id")), "left")
    best = best.select("__quadrat_id", "__quadrat_node", (F.col("__quadrat_n") > 1).alias("__quadrat_many"))
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = docs.withColumn("__quadrat_own", node).join(best, (F.col("__quadrat_own") == F.col("__quadrat_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__quadrat_id")))
    once = kept.where("__quadrat_many is null")
    many = kept.where("__quadrat_many").dropDuplicates(["__quadrat_id", "__quadrat_node"])
    return once.unionByName(many).select(*docs.columns)
