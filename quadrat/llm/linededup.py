"""Line dedup over line-identifier sequences, in DataFrame functions only.

Every text is a sequence of lines, a line is the 128-bit name of its content.  A run of lines that stands at two or
more places is repeated; its weight is the number of its words, an empty line counting as one.  Of every repeated run
of at least ``min_words`` the copy that comes first (by doc_id, then row, then line) stays, and the lines of later copies
are deleted.

Ranks: lines that stand twice are numbered in one order; then suffixes are sorted by their first 2, 4, 8, ... lines: the
rank of 2^(j+1) lines from a place is the place of (rank of 2^j lines there, rank of 2^j lines on) in the sorted table of
such pairs.  A suffix leaves once its first lines stand nowhere else.  Equal ranks are an interval of the suffix array
with a common prefix of 2^j lines; an interval with a common prefix of k lines is a pair of ranks that overlap.

Runs: of the intervals only those matter whose common prefix has just ``min_words`` words, read forwards from a line or
backwards to one: every line of a longer repeated run lies in one of these, and every one of these lies in a repeated
run.  So doubling ends when 2^(j+1) lines are more than any of them has.  The places of an interval but the first are
later copies, and the union of their lines is what the maximal repeated runs cover.

Sums by name are combined before each shuffle and written, so that joins with them can be split where a line is very
common; nothing is gathered by name, and a window only ever holds the repeated lines of one document.

Cases: null and empty texts are one empty line, which is never deleted for itself; null ``doc_id`` come first; repeated
rows are copies like others (the first row stays); a run within one document may overlap its own copy, and then only its
first lines stay; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.shared import doubled, ranks, written

MIN_WORDS = 10
UID = "__quadrat_row"
GONE = "__quadrat_gone"


def _numbered(docs: DataFrame) -> DataFrame:
    return written(docs.withColumn(UID, F.monotonically_increasing_id()), "line-docs")


def _lines(base: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = base.select(F.col("doc_id").cast("long").alias("doc"), F.col(UID).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    words = F.greatest(F.regexp_count("line", F.lit(r"\S+")), F.lit(1)).cast("long")
    return flat.select("doc", "row", "at", words.alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))


def _stretches(live: DataFrame, min_words: int) -> DataFrame:
    """``live`` with ``run`` of lines next to each other, and the lines of the shortest stretches of enough words.

    ``ahead`` is the number of lines of the one that begins here, ``back`` of the one that ends here, null without.
    """
    run = Window.partitionBy("row", "run").orderBy("at")
    live = live.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at")))
    live = live.withColumn("end", F.sum("words").over(run)).withColumn("begin", F.col("end") - F.col("words"))
    ahead = Window.partitionBy("row", "run").orderBy("begin").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("row", "run").orderBy("end").rangeBetween(-(min_words - 1), 0)
    live = live.withColumn("ahead", F.when(F.max("end").over(ahead) - F.col("begin") >= min_words, F.count("*").over(ahead)))
    live = live.withColumn("back", F.when(F.col("end") - F.min("begin").over(back) >= min_words, F.count("*").over(back)))
    return live.select("doc", "row", "run", "at", F.col("ahead").cast("int"), F.col("back").cast("int"), F.col("rank").alias("rank0"))


def suffix_ranks(base: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, int]:
    """(repeated lines with their stretches and rank0, rank1, ... of 1, 2, ... lines from there; number of levels).

    A rank is null where its lines stand nowhere else or end with the run of repeated lines.
    """
    lines = _lines(base)
    live = lines.join(ranks(lines, ["a", "b"]), ["a", "b"])
    live = written(_stretches(live, min_words), "suffixes")
    longest = live.agg(F.greatest(F.max("ahead"), F.max("back"))).first()[0] or 1
    levels = longest.bit_length()
    return doubled(live, "row", "at", levels), levels


def intervals(base: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Members (doc, row, at, k, first, last) of the intervals whose common prefix, of k lines, has just enough words."""
    live, levels = suffix_ranks(base, min_words)
    run = Window.partitionBy("row", "run").orderBy("at")
    moved = lambda name, by: F.lead(name, by).over(run) if by > 0 else F.lag(name, -by).over(run) if by < 0 else F.col(name)
    parts = []
    for side in ("ahead", "back"):
        first = second = F.lit(None).cast("long")
        for k in range(1, min((1 << levels) - 1, max(1, min_words)) + 1):
            j = k.bit_length() - 1
            begin = 0 if side == "ahead" else 1 - k
            first = F.when(F.col(side) == k, moved(f"rank{j}", begin)).otherwise(first)
            second = F.when(F.col(side) == k, moved(f"rank{j}", begin + k - (1 << j))).otherwise(second)
        parts.append(F.struct(F.col(side).alias("k"), (F.col("at") - (F.col(side) - 1 if side == "back" else 0)).cast("int").alias("at"), first.alias("r"), second.alias("s")))
    each = live.select("doc", "row", *[p.alias(f"e{i}") for i, p in enumerate(parts)]).select("doc", "row", F.explode(F.array("e0", "e1")).alias("e")).select("doc", "row", "e.*")
    each = written(each.where("k is not null and r is not null and s is not null"), "intervals")
    here = F.struct("doc", "row", "at")
    groups = each.groupBy("k", "r", "s").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(F.col("first") < F.col("last"))
    return each.join(written(groups, "groups"), ["k", "r", "s"]).select("doc", "row", "at", "k", "first", "last")


def deleted_lines(base: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, at) of every line that a later copy of a repeated run holds; a line may stand in several."""
    later = intervals(base, min_words).where(F.struct("doc", "row", "at") > F.col("first"))
    return later.select("row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)).alias("at"))


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """Columns of ``docs`` with the text cleaned, and UID, GONE (numbers of deleted lines, or null)."""
    base = _numbered(docs)
    gone = deleted_lines(base, min_words).groupBy(F.col("row").alias(UID)).agg(F.sort_array(F.collect_set("at")).alias(GONE))
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(GONE))
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return base.join(gone, UID, "left").withColumn("text", text)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, drop_empty: bool = True) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted; a document that lost every word is dropped with them.

    ``n_chars``, where it is a column, is the length of the new text.
    """
    out = _cleaned(docs, min_words)
    if drop_empty:
        out = out.where(F.col(GONE).isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(GONE).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed, n_runs (maximal deleted runs) and the digest and length of the text left, for every row."""
    own = docs.select("doc_id", "text")
    runs = F.size(F.filter(GONE, lambda x, i: (i == 0) | (F.get(GONE, i - 1) != x - 1)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _cleaned(own, min_words).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.size(GONE), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(runs, F.lit(0)).cast("long").alias("n_runs"),
        F.length(text).cast("long").alias("n_kept"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


def oracle(min_words: int = MIN_WORDS) -> str:
    """The report as SQL for another engine: all pairs of equal lines, and their islands along the diagonals."""
    return f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id AS d, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS l FROM split),
        weighed AS (SELECT *, greatest(1, len(regexp_extract_all(l, '\\S+'))) AS w FROM lines),
        pairs AS (SELECT x.d AS xd, y.d AS yd, x.i AS xi, y.i AS yi, y.w
                  FROM weighed x JOIN weighed y ON x.l = y.l AND (x.d < y.d OR x.d = y.d AND x.i < y.i)),
        islands AS (SELECT *, yi - row_number() OVER (PARTITION BY xd, yd, yi - xi ORDER BY yi) AS island FROM pairs),
        heavy AS (SELECT *, sum(w) OVER (PARTITION BY xd, yd, yi - xi, island) AS total FROM islands),
        gone AS (SELECT DISTINCT yd AS d, yi AS i FROM heavy WHERE total >= {min_words}),
        marked AS (SELECT l.d, l.i, l.l, g.d IS NOT NULL AS out,
                   coalesce(lag(g.d) OVER (PARTITION BY l.d ORDER BY l.i) IS NOT NULL, false) AS before
                   FROM lines l LEFT JOIN gone g ON l.d = g.d AND l.i = g.i),
        sums AS (SELECT d AS doc_id, count(*) FILTER (out)::BIGINT AS n_removed,
                 count(*) FILTER (out AND NOT before)::BIGINT AS n_runs,
                 coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT out), '') AS text FROM marked GROUP BY d)
        SELECT doc_id, n_removed, n_runs, length(text)::BIGINT AS n_kept, sha256(text) AS kept_sha256 FROM sums
    """
