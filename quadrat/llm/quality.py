"""Quality by importance resampling.

Two generative models over hashed word and word-pair counts are fitted: one on target text (labelled documents of good
quality) and one on the raw text of all documents.  A document's log importance weight is the log ratio of the two
models over its n-grams; Gumbel noise drawn from a hash of the row is added, and the k rows with the largest sums are
the sample: sampling without replacement in proportion to the weights.

``k`` is a parameter.  Where it is not given it is the number of documents whose weight reaches a cut that separates
good from bad labelled documents best.  Raw counts cover all documents; labelled text is a bounded sample
(``label_rows``), which is all that is broadcast.  The k-th largest sum is found by counting leading bits of the sums,
16 at a time, so nothing is sorted and nothing that grows with the documents comes to the driver.

Cases: null and empty texts have no n-grams and weight 0; null ``doc_id`` are kept as rows; repeated rows get equal
noise and stand or fall together (ties with the k-th row stay); without usable labels all weights are 0 and, without
``k``, every row stays; an empty table gives no rows; other columns, whatever their names, pass through ``resample``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import textbytes as tb
from quadrat.llm.shared import written

BUCKETS = 1 << 14
LABEL_ROWS = 20_000
#: Pseudo-counts of the target model, dealt as the raw model deals its mass: n-grams the target text is too short to
#: show lean to ratio 1.
PRIOR = 4 * BUCKETS
#: Of so many parts of the labelled sample one is kept from the target model, for the cut.
FOLDS = 4


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words (runs of letters, digits or marks, case kept) and adjacent pairs, with their rows."""
    starts, ends = tb.runs(tb.CLASS[raw], offsets)
    row = tb.row_of(starts, offsets)
    word = tb.span_hash(raw, starts, ends)
    pair = tb.mix(word[:-1] * np.uint64(3) + word[1:])[row[1:] == row[:-1]] if len(word) > 1 else word[:0]
    pair_row = row[1:][row[1:] == row[:-1]] if len(word) > 1 else row[:0]
    return (np.concatenate([word, pair]) % np.uint64(buckets)).astype(np.int64), np.concatenate([row, pair_row])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled ids, chosen by hash, and only those are broadcast."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """n-gram counts by bucket over all rows; tasks send their own sums, the driver gets ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in tb.tidy(batches):
            for _, _, raw, offsets in tb.steps(batch.column(0)):
                total += np.bincount(ngram_buckets(raw, offsets, buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    sums = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of the two models' probabilities by bucket."""
    q = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + prior * q) / (target.sum() + prior) / q)


def weight_of(ratio: np.ndarray):
    """An Arrow function from text to its log importance weight."""

    @F.arrow_udf("double")
    def weight(text: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for a, z, raw, offsets in tb.steps(text):
            bucket, row = ngram_buckets(raw, offsets, len(ratio))
            parts.append(np.bincount(row, ratio[bucket], z - a))
        tb.release()
        return pa.array(np.concatenate(parts))

    return weight


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest share of good rows at or above it less that of bad rows; the middle of its gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    gain = np.concatenate([[0], np.cumsum(np.where(g, -1 / g.sum(), 1 / (~g).sum()))])
    inner = np.concatenate([[True], w[1:] > w[:-1], [True]])
    at = int(np.flatnonzero(inner)[np.argmax(gain[inner])])
    return -np.inf if at == 0 else np.inf if at == len(w) else float((w[at - 1] + w[at]) / 2)


def gumbel(seed: int) -> Column:
    """Gumbel noise from a hash of doc_id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")), 11)
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


#: Sums are compared in steps of 2^-20; those beyond 2^26 count as that.
STEP, BOUND = float(1 << 20), float(1 << 26)


def stepped(value: Column) -> Column:
    """The value as a whole number of steps."""
    return F.floor(F.least(F.greatest(value, F.lit(-BOUND)), F.lit(BOUND)) * STEP).cast("long")


def kth_largest(keys: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a column of longs below 2^47 in size, by counts over 16 leading bits at a time."""
    head, left = None, k
    for shift in (32, 16, 0):
        part = keys if head is None else keys.where(F.shiftright(column, shift + 16) == head)
        for value, n in sorted(part.groupBy(F.shiftright(column, shift)).count().collect(), reverse=True):
            if n >= left:
                head = value
                break
            left -= n
    return head


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", label_rows: int = LABEL_ROWS) -> tuple[np.ndarray, float]:
    """The log ratios by bucket and the cut between good and bad labelled documents."""
    sample = labelled_sample(docs, labels, label, label_rows)
    sample = written(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS))), "quality-sample")
    ratio = log_ratio(bucket_counts(sample.where("label = 1 and fold <> 0")), bucket_counts(docs))
    rows = sample.where("fold = 0").select(weight_of(ratio)("text"), F.col("label") == 1).collect()
    return ratio, best_cut(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool)) if rows else -np.inf


def weighed(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """doc_id, log_weight, noisy_weight and its steps (``key``) of every row, written."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), weight_of(ratio)(F.col("text").cast("string")).alias("log_weight"), gumbel(seed).alias("noise"))
    noisy = F.col("log_weight") + F.col("noise")
    return written(out.select("doc_id", "log_weight", noisy.alias("noisy_weight"), stepped(noisy).alias("key")), "quality-keys")


def threshold(keys: DataFrame, cut: float, k: int | None = None) -> int | None:
    """Steps of the k-th largest noisy weight over all rows of ``weighed``; None where every row stays."""
    rows, above = keys.select(F.count("*"), F.count_if(F.col("log_weight") >= F.lit(cut))).first()
    k = above if k is None else k
    if k >= rows:
        return None
    return kth_largest(keys, "key", k) if k > 0 else int(2 * BOUND * STEP)


def scores(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, label_rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, log_weight, noisy_weight and selected of every document."""
    ratio, cut = fit(docs, labels, label_rows=label_rows)
    keys = weighed(docs, ratio, seed)
    least = threshold(keys, cut, k)
    return keys.select("doc_id", "log_weight", "noisy_weight", (F.lit(True) if least is None else F.col("key") >= least).alias("selected"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, label_rows: int = LABEL_ROWS) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    ratio, cut = fit(docs, labels, label_rows=label_rows)
    least = threshold(weighed(docs, ratio, seed), cut, k)
    if least is None:
        return docs
    return docs.where(stepped(weight_of(ratio)(F.col("text").cast("string")) + gumbel(seed)) >= least)
