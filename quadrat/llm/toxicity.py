"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features of a text: densities of two word lists (a fixed one, and one of words that labelled toxic documents hold far
more often than others), the same list read through obfuscation (digits and signs for letters, signs between letters),
listed words near a second-person word, capitals, words in capitals, punctuation, exclamation and repeated marks, and
tokens that mix letters with digits or signs.  The trees are fitted on a bounded sample of labelled training rows
(``LABEL_ROWS`` ids by hash), a quarter of which is kept for the calibration.  Scoring is one pass over the scan.

Cases: null and empty texts have features of 0 and are scored like any text; labels that conflict count as toxic; with
no labels, or labels of one kind, every score is that kind's share (0 without labels); null ``doc_id`` are scored and
count as not held out; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import textbytes as tb
from quadrat.llm.quality import labelled_sample
from quadrat.llm.shared import shared_folder, written

LABEL_ROWS = 20_000
#: Words learnt from labels: at most so many, each in this share of toxic sample rows at least, so many times as often.
LEARNT_WORDS, LEARNT_SHARE, LEARNT_TIMES = 200, 0.02, 8.0

# Insults and abuse in the languages of the corpus, and second-person words.
INSULTS = """
abruti asshole asqueroso bastard basura bitch blöd blödmann bouffon burro cabrón clown connard coward cretin crétin
crap débile depp despreciable dick disgusting dreck dumb dummkopf dégoûtant estúpido filth filthy fool freak fuck
garbage hate idiot idiota idiote imbecile imbécil imbécile inútil jerk kill liar loser maldito merde mierda minable
miserable moron müll nazi nutte ordure pathetic payaso perdedor pig pute puta puto raclure racaille repugnante salaud
scheiße scum shit slut stupid stupide trash trottel tonto ugly useless verlierer vermin versager whore widerlich
worthless wertlos
""".split()
SECOND_PERSON = """
you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tuyo usted ustedes vosotros
""".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NEAR_WORDS = 6

FEATURES = (
    "listed", "listed_any", "learnt", "learnt_any", "hidden", "near_you", "second_person", "capitals", "capital_words",
    "punctuation", "exclamation", "repeated_marks", "mixed_tokens", "log_words", "mean_word",
)


def word_keys(words: list[str]) -> np.ndarray:
    """Sorted hashes of words as ``word_hashes`` gives them."""
    raw = "\n".join(sorted(set(words))).encode()
    data = tb.lowered(np.frombuffer(raw, np.uint8))
    starts, ends = tb.runs(tb.CLASS[data], np.array([0, len(data)]))
    return np.unique(tb.span_hash(data, starts, ends))


def _folding() -> np.ndarray:
    table = tb.LOWER.copy()
    table[tb.CLASS == tb.MARK] = 0
    table[tb.CLASS == tb.DIGIT] = 0
    for sign, letter in LEET.items():
        table[ord(sign)] = ord(letter)
    return table


FOLD = _folding()


def features_of(raw: np.ndarray, offsets: np.ndarray, listed: np.ndarray, learnt: np.ndarray, you: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    rows = len(offsets) - 1
    kind, low = tb.CLASS[raw], tb.lowered(raw)
    starts, ends = tb.runs(kind, offsets)
    row, what = tb.row_of(starts, offsets), kind[starts]
    letters = what == tb.LETTER
    at, stop, of = starts[letters], ends[letters], row[letters]
    key = tb.span_hash(low, at, stop)
    hit, own, second = np.isin(key, listed), np.isin(key, learnt), np.isin(key, you)
    near = np.zeros(len(key), bool)
    if second.any():
        seats, hits = np.flatnonzero(second), np.flatnonzero(hit | own)
        j = np.searchsorted(seats, hits)
        for s in (np.maximum(j - 1, 0), np.minimum(j, len(seats) - 1)):  # the second-person words before and after
            near[hits] |= (np.abs(seats[s] - hits) <= NEAR_WORDS) & (of[seats[s]] == of[hits])
    upper = (raw >= 65) & (raw <= 90)
    upto = np.concatenate([[0], np.cumsum(upper)])
    caps = upto[stop] - upto[at]
    shout = (caps == stop - at) & (stop - at > 1)
    marks = what == tb.MARK

    tokens, token_ends = tb.runs((kind != tb.SPACE).astype(np.uint8), offsets)
    token_row = tb.row_of(tokens, offsets)
    folded = FOLD[low]
    keep = folded != 0
    upto_kept = np.concatenate([[0], np.cumsum(keep)])
    a, z = upto_kept[tokens], upto_kept[token_ends]
    letters_in = np.concatenate([[0], np.cumsum(kind == tb.LETTER)])
    own_letters = letters_in[token_ends] - letters_in[tokens]
    ends_trim = _trimmed(kind, tokens, token_ends)
    mixed = (own_letters > 0) & (own_letters < ends_trim)
    pick = np.flatnonzero(mixed & (z > a))
    hidden = np.isin(tb.span_hash(folded[keep], a[pick], z[pick]), np.concatenate([listed, learnt]))

    def per_row(r: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(r, weights, rows).astype(float)

    words = np.maximum(per_row(of), 1)
    chars = np.maximum(np.diff(offsets), 1)
    letters_n = np.maximum(per_row(of, (stop - at).astype(float)), 1)
    first_marks = np.flatnonzero(marks)
    size = (ends - starts)[first_marks]
    shouts = raw == ord("!")
    upto_shouts = np.concatenate([[0], np.cumsum(shouts)])
    columns = [
        per_row(of[hit]) / words,
        np.log1p(per_row(of[hit])),
        per_row(of[own]) / words,
        np.log1p(per_row(of[own])),
        per_row(token_row[pick[hidden]]) / words,
        per_row(of[near]) / words,
        per_row(of[second]) / words,
        per_row(of, caps.astype(float)) / letters_n,
        per_row(of[shout]) / words,
        per_row(row[first_marks], size.astype(float)) / chars,
        (upto_shouts[offsets[1:]] - upto_shouts[offsets[:-1]]) / chars,
        per_row(row[first_marks[size > 1]]) / words,
        per_row(token_row[mixed]) / words,
        np.log1p(per_row(of)),
        letters_n / words,
    ]
    return np.stack(columns, 1)


def _trimmed(kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of each token from its first to its last byte that is no mark."""
    plain = np.flatnonzero(kind[: ends[-1]] != tb.MARK) if len(ends) else np.zeros(0, np.int64)
    a, z = np.searchsorted(plain, starts), np.searchsorted(plain, ends)
    out = np.zeros(len(starts), np.int64)
    full = z > a
    out[full] = plain[z[full] - 1] - plain[a[full]] + 1
    return out


def features(text: Column, learnt: np.ndarray) -> Column:
    """array<double> of FEATURES of a text column."""
    listed, you = word_keys(INSULTS), word_keys(SECOND_PERSON)

    @F.arrow_udf("array<double>")
    def measure(text: pa.Array) -> pa.Array:
        parts = [np.zeros((0, len(FEATURES)))]
        parts += [features_of(raw, offsets, listed, learnt, you) for _, _, raw, offsets in tb.steps(text)]
        flat = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(FEATURES), dtype=np.int32)), pa.array(flat.ravel()))

    return measure(text)


def learnt_words(sample: DataFrame) -> np.ndarray:
    """Hashes of words that sample rows labelled 1 hold far more often than those labelled 0 (LEARNT_* at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1))
            for a, _, raw, offsets in tb.steps(batch.column(0)):
                low = tb.lowered(raw)
                starts, ends = tb.runs(tb.CLASS[raw], offsets)
                row = tb.row_of(starts, offsets)
                key = tb.span_hash(low, starts, ends)
                order = np.lexsort((key, row))
                new = np.ones(len(key), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
                key, kind = key[order][new], label[a + row[order][new]]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32))], ["word", "label"])

    n1, n0 = (x or 0 for x in sample.select(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    counts = sample.select("text", "label").mapInArrow(count, "word long, label int").groupBy("word").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    times = F.col("n1") / n1 / ((F.col("n0") + 1) / n0)
    best = counts.where((F.col("n1") >= max(3, LEARNT_SHARE * n1)) & (times >= LEARNT_TIMES)).orderBy(times.desc(), "word").limit(LEARNT_WORDS)
    return np.sort(np.array([r[0] for r in best.select("word").collect()], np.int64).view(np.uint64))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", trees: int = 16, depth: int = 3, label_rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared_folder(docs.sparkSession)
    sample = written(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), label, label_rows), "toxic-sample")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
    learnt = learnt_words(sample.where(fold != 0))  # the calibration's fold must not know its own labels
    rows = sample.select("label", fold.alias("fold"), array_to_vector(features("text", learnt)).alias("features"))
    rows = written(rows.withColumn("label", F.col("label").cast("double")), "toxic-rows")
    kinds = {(r[0], r[1]): r[2] for r in rows.groupBy("label", (F.col("fold") == 0).alias("own")).count().collect()}
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not kinds.get((0.0, False)) or not kinds.get((1.0, False)):
        share = sum(n for (v, _), n in kinds.items() if v) / max(1, sum(kinds.values()))
        scored = whole.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, checkpointInterval=-1).fit(rows.where("fold <> 0"))
        chance = vector_to_array("probability")[1]
        own = model.transform(rows.where("fold = 0")).select("label", chance.alias("chance"))
        both = kinds.get((0.0, True)) and kinds.get((1.0, True))
        scored = model.transform(whole.select("doc_id", array_to_vector(features("text", learnt)).alias("features"))).select("doc_id", chance.alias("chance"))
        if both:
            curve = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(own)
            scored = curve.transform(scored)
        else:
            scored = scored.withColumn("score", F.col("chance"))
        scored = scored.select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
