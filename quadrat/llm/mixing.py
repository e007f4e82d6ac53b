"""Mixing to target weights by soft domain membership, in DataFrame functions only.

A classifier is fitted on a bounded sample of the labelled table (``LABEL_ROWS`` ids by hash): multinomial logistic
regression over dense features that SQL expressions compute from the text.  Every document then has a posterior over the
domains, and a nonnegative rate is fitted to every document so that the expected tokens of each domain, sums of rate x
tokens x posterior, match the targets in the least-squares sense.

Targets are token totals by domain, given as such or as shares of the tokens that are there.  The fit is projected
gradient descent from rate 1.  The gradient of a document is its posterior times one multiplier a domain, so an iteration
is one aggregate over a narrow table of (tokens, posterior), and what comes to the driver is one sum for each domain and
pair of domains.  Distances are measured per token; a step first takes the misfit in the metric of the Gram matrix of the
domains over documents whose rate is not 0; once that does not lower it, the plain gradient over the largest row sum of the
Gram matrix over all documents, twice as far after each step that lowers it and half as far after one that does not.  After t steps a document's
rate is a fold over t multiplier vectors, so no state is carried from row to row or step to step.  The misfit that is left
is part of the result.  Whole copies are drawn from rates by a hash of the row: a rate r gives floor(r) copies and one more
with the chance of the rest.  Tokens and posteriors are computed once and written.

Cases: null and empty texts have no tokens, rate 1 and stay; null ``doc_id`` and repeated rows are rows like others, and
equal rows get equal rates; without labels, or with labels of one domain, all posteriors are equal for all documents; a
domain without tokens keeps its misfit; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import written

LABEL_ROWS = 20_000
DOMAINS = ("clean", "junk", "toxic")
#: Factors of ``reduced``, for callers that name no weights.
TARGETS = {"clean": 1.0, "junk": 0.5, "toxic": 0.5}
#: Wanted shares of tokens, whatever is present; the query and the pipeline use these.
WEIGHTS = {"clean": 0.94, "junk": 0.02, "toxic": 0.04}
STEPS = 30

# Words of abuse whose rate is a feature.
ABUSE = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "hate", "dumb", "ugly", "fool", "liar")


def label_domain() -> Column:
    """Domain of a labelled row from its ``quality`` and ``toxic``."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")


MEASURES = 10


def measured(text: Column) -> Column:
    """Dense features of a text, each between 0 and about 1, and after them its tokens.

    Words become one letter each first, so that most counts are taken from the short rest; a count is the length that a
    plain replacement leaves.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def left(value: Column, gone: str, by: str = "") -> Column:
        return F.regexp_replace(value, gone, by)

    def number(value: Column, counted: str) -> Column:
        return F.length(value) - F.length(left(value, counted))

    def features(t: Column, brief: Column, tight: Column, signs: Column, abuse: Column) -> Column:
        size = F.greatest(F.length(t), F.lit(1)).cast("double")
        share = lambda n: n / size
        return F.array(
            share(number(t, "[A-Z]+")) * 4, share(number(signs, "[!]+")) * 10, share(number(signs, "[#$%&*]+")) * 4, share(number(signs, "[|]+")) * 20,
            share(number(t, "[0-9]+")) * 10, share(number(signs, "[.,;:?]+")) * 10, share(F.length(brief) - F.length(tight)) * 4,
            F.least(abuse / F.lit(3.0), F.lit(1.0)), F.least(abuse * 200 / size, F.lit(2.0)), F.log1p(size) / 10, F.length(tight).cast("double"),
        )

    abuse = F.regexp_count(text, F.lit(r"\b(?i:" + "|".join(ABUSE) + r")\b")).cast("double")

    def of(t: Column) -> Column:
        brief = left(t, r"[a-zA-Z0-9\p{L}\p{N}]+", "a")
        return once(brief, lambda b: once(left(b, r"\s+"), lambda w: once(left(w, "a+"), lambda s: once(abuse, lambda n: features(t, b, w, s, n)))))

    return once(text, of)


def measures(text: Column) -> Column:
    return F.slice(measured(text), 1, MEASURES)


def tokens(text: Column) -> Column:
    """Tokens of a text: runs of letters and digits, and every other sign."""
    return F.get(measured(text), F.lit(MEASURES))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, label_rows: int = LABEL_ROWS):
    """A function from an array column of measures to the array of posteriors of ``domains``.

    ``labelled`` has doc_id and domain.
    """
    ids = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double").alias("label"))
    ids = ids.where("doc_id is not null and label > 0").groupBy("doc_id").agg((F.max("label") - 1).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = written(own.join(F.broadcast(ids), "doc_id").select("label", "text"), "mixing-texts")  # so that only these are measured
    sample = written(few.select("label", array_to_vector(measures(F.col("text"))).alias("features")), "mixing-sample")
    counts = {int(r[0]): r[1] for r in sample.groupBy("label").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        even = [counts.get(i, 0) / n if n else 1 / len(domains) for i in range(len(domains))]
        return lambda x: F.array(*map(F.lit, map(float, even)))
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(sample)
    rows, bias = model.coefficientMatrix.toArray().tolist(), list(model.interceptVector)
    seen = sorted(counts)

    table = F.array(*[F.array(F.lit(float(bias[i])), *[F.lit(float(w)) for w in rows[i]]) for i in range(len(domains))])
    never = [i for i in range(len(domains)) if i not in seen]

    def chances(x: Column) -> Column:
        # Measures are computed once, not once a domain.
        raw = once(x, lambda v: F.transform(table, lambda w: dot(F.concat(F.array(F.lit(1.0)), v), w)))
        if never:
            raw = F.transform(raw, lambda r, i: F.when(i.isin(*never), F.lit(float("-inf"))).otherwise(r))
        odds = once(raw, lambda r: once(F.array_max(r), lambda top: F.transform(r, lambda v: F.exp(v - top))))
        return once(odds, lambda o: once(total(o), lambda t: F.transform(o, lambda v: v / t)))

    return chances


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system; directions without weight get 0."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    scale = max((abs(matrix[i][i]) for i in range(n)), default=0) or 1.0
    used: dict[int, int] = {}  # row -> its unknown
    for c in range(n):
        best = max((r for r in range(n) if r not in used), key=lambda r: abs(rows[r][c]))
        if abs(rows[best][c]) <= 1e-12 * scale:
            continue
        used[best] = c
        pivot = rows[best][c]
        rows[best] = [v / pivot for v in rows[best]]
        for r in range(n):
            if r != best and rows[r][c]:
                factor = rows[r][c]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[best])]
    out = [0.0] * n
    for r, c in used.items():
        out[c] = rows[r][n]
    return out


def rate(chance: Column, multipliers: list[list[float]]) -> Column:
    """The rate of a document after the steps so far."""
    start = F.lit(1.0)
    if not multipliers:
        return start
    steps = F.array(*[F.array(*map(F.lit, m)) for m in multipliers])

    def step(r: Column, m: Column) -> Column:
        return F.greatest(r + dot(chance, m), F.lit(0.0))

    return F.aggregate(steps, start, step)


def totals(narrow: DataFrame, shares: list[float]) -> list[float]:
    """Token totals that are the given shares of the tokens of ``narrow``."""
    return [w * float(narrow.agg(F.sum("tokens")).first()[0] or 0) for w in shares]


def reduced(narrow: DataFrame, factors: list[float]) -> list[float]:
    """Token totals that follow from what is there: documents that most likely are of a domain count by its factor."""
    p = [F.get("chance", F.lit(i)) for i in range(len(factors))]
    row = narrow.agg(*[F.sum(F.col("tokens") * x) for x in p], *[F.sum(F.when(x > 0.5, F.col("tokens") * x)) for x in p]).first()
    row = [float(x or 0) for x in row]
    return [x - (1 - f) * c for f, x, c in zip(factors, row, row[len(factors) :])]


def fit_rates(narrow: DataFrame, targets: list[float], steps: int = STEPS, close: float = 1e-4) -> tuple[list[list[float]], list[float]]:
    """(multipliers of all steps, expected tokens by domain at the end) for a table of ``tokens`` and ``chance``.

    Ends when every domain is within ``close`` of all tokens, or after ``steps`` trials.
    """
    n = len(targets)
    p = [F.get("chance", F.lit(i)) for i in range(n)]

    def sums(multipliers: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """Expected tokens by domain, and the Gram matrix of the documents whose rate is not 0."""
        each = narrow.select("tokens", "chance", rate(F.col("chance"), multipliers).alias("rate"))
        full = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0.0)
        got = each.agg(*[F.sum(F.col("tokens") * F.col("rate") * x) for x in p], *[F.sum(full * x * y) for x in p for y in p]).first()
        got = [float(x or 0) for x in got]
        return got[:n], [got[n + i * n : 2 * n + i * n] for i in range(n)]

    def misfit(got: list[float]) -> float:
        return sum((t - x) ** 2 for t, x in zip(targets, got))

    multipliers: list[list[float]] = []
    now, gram = sums(multipliers)
    budget = max(sum(now), 1.0)
    widest = max((sum(map(abs, row)) for row in gram), default=0.0) or 1.0
    whole, pace = True, 1.0
    for _ in range(steps):
        gap = [t - x for t, x in zip(targets, now)]
        if max(map(abs, gap)) <= close * budget or pace < 1 / 64:
            break
        trial = [*multipliers, solve(gram, gap) if whole else [pace * g / widest for g in gap]]
        then, then_gram = sums(trial)
        if misfit(then) < misfit(now):
            multipliers, now, gram = trial, then, then_gram
            pace *= 1 if whole else 2
        elif whole:
            whole = False
        else:
            pace /= 2
    return multipliers, now


def _plan(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], wanted, steps: int, keep: list[str]):
    """(columns ``keep`` of ``docs`` with tokens, chance and draw, written; multipliers; misfit as a share of all tokens)."""
    chances = posteriors(docs, labels.select("doc_id", label_domain().alias("domain")), domains)
    # Measures and tokens are read off one column, which is used twice and so stays a projection of its own.
    x, tokens, chance, draw = (f"__quadrat_{n}" for n in ("measures", "tokens", "chance", "draw"))
    full = docs.select(*keep, measured(F.col("text")).alias(x), _draw().alias(draw))
    full = full.select(*keep, F.get(x, F.lit(MEASURES)).alias(tokens), chances(F.slice(x, 1, MEASURES)).alias(chance), draw)
    full = written(full, "mixing")
    narrow = full.select(F.col(tokens).alias("tokens"), F.col(chance).alias("chance"))
    targets = wanted(narrow)
    multipliers, got = fit_rates(narrow, targets, steps)
    left = sum((t - g) ** 2 for t, g in zip(targets, got)) ** 0.5
    return full, multipliers, left / max(1.0, sum(targets))


def _wanted(factors: dict[str, float] | None, weights: dict[str, float] | None, tokens: dict[str, float] | None):
    """(domains, a function from the narrow table to their targets)."""
    given = tokens or weights or factors or TARGETS
    values = list(given.values())
    if tokens:
        return tuple(given), lambda narrow: values
    return tuple(given), (lambda narrow: totals(narrow, values)) if weights else (lambda narrow: reduced(narrow, values))


def _draw(seed: int = 13) -> Column:
    """A number in [0, 1) from a hash of the row's doc_id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")), 11) / float(1 << 53)


def copies(rates: Column, draw: Column) -> Column:
    return F.floor(rates + draw).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, steps: int = STEPS, weights: dict[str, float] | None = None, tokens: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, a posterior column for each domain, rate, copies and misfit of every document.

    The output's token totals are to be ``tokens``, or the shares ``weights`` of what is there, or what is there reduced by
    ``targets``.  ``misfit``, the same in all rows, is the distance of the expected totals from them over their sum.
    """
    domains, wanted = _wanted(targets, weights, tokens)
    full, multipliers, misfit = _plan(docs, labels, domains, wanted, steps, ["doc_id"])
    chance = F.col("__quadrat_chance")
    out = full.withColumn("rate", rate(chance, multipliers))
    each = [F.get(chance, F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__quadrat_tokens").alias("tokens"), *each, "rate", copies(F.col("rate"), F.col("__quadrat_draw")).alias("copies"), F.lit(float(misfit)).alias("misfit"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, steps: int = STEPS, weights: dict[str, float] | None = None, tokens: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs`` as often as their rates say, with their own columns."""
    domains, wanted = _wanted(targets, weights, tokens)
    full, multipliers, _ = _plan(docs, labels, domains, wanted, steps, docs.columns)
    n = "__quadrat_copies"
    out = full.withColumn(n, copies(rate(F.col("__quadrat_chance"), multipliers), F.col("__quadrat_draw"))).where(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
