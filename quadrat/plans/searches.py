"""Queries over registered grids of policies that change rankings: one row a policy, its F1 and its place in the choice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.operators import compose as C
from quadrat.operators import grids as G
from quadrat.operators import ranking as R
from quadrat.operators import search as S
from quadrat.plans.inputs import _PARTS, risk_gates
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.tables import sql

_TRUTH = "truth AS (SELECT survey, count(*) AS truth FROM pairs GROUP BY 1)"
_CAND = f"{_TRUTH}, cand AS MATERIALIZED (SELECT c.survey, c.species, p, q, (y.species IS NOT NULL)::INT AS hit FROM scores c LEFT JOIN pairs y USING (survey, species))"
_SIZES = "sizes AS (SELECT survey, count(*) AS size FROM cand GROUP BY 1)"


def _choice_sql(each: str, fields: str, smaller: str, by: str = "") -> str:
    """SQL of a row a policy from f(place, survey, f1)."""
    own = f"{by}, " if by else ""
    return f"""means AS (SELECT {own}place, count(*) AS surveys, round(avg(f1), 9) AS f1 FROM {each} GROUP BY ALL)
    SELECT {own}place, surveys, round(m.f1, 6) AS f1, (row_number() OVER ({f"PARTITION BY {by} " if by else ""}ORDER BY m.f1 DESC, {smaller}place))::INT AS choice FROM means m JOIN pol USING ({own}place)"""


def _ranked_sql(head: str, grid: str, fields: list[str], keys: list[str], value: str, length: str, smaller: str = "", rows: str = "SELECT survey FROM sizes") -> str:
    """SQL of a grid whose policies rank candidates ``cand`` (survey, species, hit and what ``value`` names) and cut the ranking."""
    same = " AND ".join(f"r.{k} IS NOT DISTINCT FROM m.{k}" for k in keys)
    k = ", ".join(keys)
    return f"""WITH {head}, pol AS {G.values(grid, *fields)}, rk AS (SELECT DISTINCT {k} FROM pol), own AS MATERIALIZED ({rows}),
    v AS (SELECT survey, {k}, species, hit, round({value}, 9) AS val FROM cand JOIN own USING (survey) CROSS JOIN rk),
    r AS MATERIALIZED (SELECT survey, {k}, val, row_number() OVER w AS rank, sum(hit) OVER w AS hits FROM v WINDOW w AS (PARTITION BY survey, {k} ORDER BY val DESC, species)),
    m AS (SELECT survey, pol.*, least({length}, size)::INT AS n FROM own JOIN sizes USING (survey) CROSS JOIN pol),
    f AS (SELECT m.place, m.survey, 2 * coalesce(hits, 0) / greatest(n + coalesce(truth, 0), 1)::DOUBLE AS f1 FROM m LEFT JOIN r ON r.survey = m.survey AND r.rank = m.n AND {same} LEFT JOIN truth t ON t.survey = m.survey),
    {_choice_sql("f", "", smaller)}"""


_GATES = f"""{_PARTS}, gates AS (SELECT survey, 1.0::DOUBLE AS uniform, round(pa, 6) AS pa_distance, round(0.6 * pa + 0.4 * po, 6) AS pa_po, round(0.45 * pa + 0.30 * po + 0.25 * dis, 6) AS pa_po_disagreement FROM parts)"""
_GATE = "CASE gate WHEN 'uniform' THEN uniform WHEN 'pa_distance' THEN pa_distance WHEN 'pa_po' THEN pa_po ELSE pa_po_disagreement END"
_MIXED = f"(1 - alpha * {_GATE}) * p + alpha * {_GATE} * q"
_NEEDS = ("scores", "pairs", "surveys")


def _cands(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    """Candidates as ``_x``, a survey's one after the other, with its number of labels and what ``own`` has of it."""
    rows = T.marked(spark, d, own=own)
    return rows.withColumn("_x", F.struct("species", "hit", "p", "q")).drop("species", "hit", "p", "q", "n")


def _gate_of() -> Column:
    out = F.col(G.GATES[-1])
    for g in G.GATES[:-1]:
        out = F.when(F.col("gate") == g, F.col(g)).otherwise(out)
    return out


def _mixtures(spark: SparkSession, d: str, grid: str) -> tuple[DataFrame, DataFrame]:
    """Every mixture policy over all surveys: members mixed by alpha times a gate, lengths near and far by the gate."""
    gates = risk_gates(spark, d).drop("shift")
    policies = G.table(spark, grid).select("place", "alpha", "gate", "k", "k_far", "transition")
    value = lambda x, k: (1 - k["alpha"] * x[k["gate"]]) * x["p"] + k["alpha"] * x[k["gate"]] * x["q"]
    length = lambda p, s: F.when(_gate_of() < F.coalesce(p["transition"], F.lit(2.0)), p["k"]).otherwise(F.coalesce(p["k_far"], p["k"]))
    return S.ranked(_cands(spark, d, gates), policies, ["alpha", "gate"], value, length, given=["p", "q", *G.GATES]), policies


def _gated_sql(grid: str) -> str:
    return sql(_ranked_sql(f"{_CAND}, {_SIZES}, {_GATES}", grid, ["alpha", "gate", "k"], ["alpha", "gate"], _MIXED, "k", rows="SELECT * FROM gates"), *_NEEDS)


@register("gated_search", _gated_sql("gated"))
def gated_search(spark: SparkSession, d: str) -> DataFrame:
    """Twenty species after mixing two members by alpha and a gate: 12 policies."""
    return S.chosen(*_mixtures(spark, d, "gated"), [])


@register("gated_wide_search", _gated_sql("gated_wide"))
def gated_wide_search(spark: SparkSession, d: str) -> DataFrame:
    return S.chosen(*_mixtures(spark, d, "gated_wide"), [])


_LESS = "alpha, abs(k - 20) + abs(k_far - 20), gate <> 'uniform', "


@register("transition_search", sql(_ranked_sql(f"{_CAND}, {_SIZES}, {_GATES}", "transition", ["alpha", "gate", "k", "k_far", "transition"], ["alpha", "gate"], _MIXED, f"CASE WHEN {_GATE} < transition THEN k ELSE k_far END", _LESS, "SELECT * FROM gates"), *_NEEDS))
def transition_search(spark: SparkSession, d: str) -> DataFrame:
    """96 policies of four gates and two lengths: ties prefer small alphas, small changes of length and the uniform gate."""
    less = [F.col("alpha"), F.abs(F.col("k") - 20) + F.abs(F.col("k_far") - 20), F.col("gate") != "uniform"]
    return S.chosen(*_mixtures(spark, d, "transition"), less)


@register("transition_application", sql(_ranked_sql(f"{_CAND}, {_SIZES}, {_GATES}", "transition", ["alpha", "gate", "k", "k_far", "transition"], ["alpha", "gate"], _MIXED, f"CASE WHEN {_GATE} < transition THEN k ELSE k_far END", _LESS, "SELECT * FROM gates").replace("SELECT place, surveys, round(m.f1, 6) AS f1, (row_number()", ", ranked AS (SELECT place, (row_number()").replace("FROM means m JOIN pol USING (place)", """FROM means m JOIN pol USING (place)), best AS (SELECT pol.* FROM pol JOIN ranked USING (place) WHERE choice = 1),
    z AS (SELECT survey, species, row_number() OVER (PARTITION BY survey ORDER BY round(""" + _MIXED + f""", 9) DESC, species) AS rank, CASE WHEN {_GATE} < transition THEN k ELSE k_far END AS n FROM cand JOIN gates USING (survey) CROSS JOIN best)
    SELECT survey, species, rank::INT AS rank FROM z WHERE rank <= n"""), *_NEEDS))
def transition_application(spark: SparkSession, d: str) -> DataFrame:
    """The lists of the policy that the search chooses, if it stands in the grid."""
    from quadrat.operators.policy import registered

    best = transition_search(spark, d).where("choice = 1").select("place")
    policies = G.table(spark, "transition").select("place", "alpha", "gate", "k", "k_far", "transition")
    own = registered(policies.join(best, "place"), policies, ["alpha", "gate", "k", "k_far", "transition"])
    rows = T.marked(spark, d, own=risk_gates(spark, d).drop("shift")).join(F.broadcast(own), F.lit(True))
    weight = F.col("alpha") * _gate_of()
    ranked = R.ranked(rows.withColumn("v", F.round((1 - weight) * F.col("p") + weight * F.col("q"), 9)), "v")
    return ranked.where(F.col("rank") <= F.when(_gate_of() < F.col("transition"), F.col("k")).otherwise(F.col("k_far"))).select("survey", "species", "rank")


@register("challenger_search", sql(_ranked_sql(f"{_CAND}, {_SIZES}", "challenger", ["weight", "kind", "k", "threshold", "minimum_k", "maximum_k"], ["weight"], "(1 - weight) * p + weight * q",
    "CASE WHEN kind = 'top_k' THEN k ELSE greatest(minimum_k, least((SELECT count(*) FROM r WHERE r.survey = own.survey AND r.weight = pol.weight AND r.val >= pol.threshold), maximum_k)) END"), *_NEEDS))
def challenger_search(spark: SparkSession, d: str) -> DataFrame:
    """Five weights of the challenger by 25 cuts: each weight is ranked once for all its cuts."""
    policies = G.table(spark, "challenger").select("place", "weight", "kind", "k", "threshold", "minimum_k", "maximum_k")
    value = lambda x, k: (1 - k["weight"]) * x["p"] + k["weight"] * x["q"]
    length = lambda p, s: F.when(p["kind"] == "top_k", p["k"]).otherwise(F.greatest(p["minimum_k"], F.least(S.reached(s, p["threshold"]), p["maximum_k"])))
    return S.chosen(S.ranked(_cands(spark, d), policies, ["weight"], value, length, given=["p", "q"]), policies, [])


_RAMP = "least(greatest(ln(1 + abs(lat - 48) * 111) / ln(201::DOUBLE), 0), 1)"
_BLEND = f"""{_TRUTH}, cand AS MATERIALIZED (SELECT c.survey, c.species, hit, CASE WHEN rank <= 96 THEN p / greatest(top, 1e-8) ELSE 0 END AS own, CASE WHEN (c.survey + c.species) % 3 = 0 THEN q ELSE 0 END AS po, CASE WHEN (c.survey + c.species) % 4 = 1 THEN q ELSE 0 END AS pa
    FROM (SELECT s.*, (y.species IS NOT NULL)::INT AS hit, row_number() OVER (PARTITION BY s.survey ORDER BY p DESC, s.species) AS rank, max(p) OVER (PARTITION BY s.survey) AS top FROM scores s LEFT JOIN pairs y USING (survey, species)) c), {_SIZES}"""


@register("blend_search", sql(_ranked_sql(_BLEND, "blend", ["scale", "po_weight", "pa_weight"], ["po_weight", "pa_weight"], "own + CASE WHEN risk >= 0.5 THEN po_weight ELSE 0.05 END * po + pa_weight * pa",
    "least(greatest(round_even((exp(ln(1 + labels)) - 1) * scale, 0), 4), 50)", rows=f"SELECT survey, {_RAMP} AS risk, truth AS labels FROM surveys JOIN truth USING (survey)"), *_NEEDS))
def blend_search(spark: SparkSession, d: str) -> DataFrame:
    """60 policies of the three-way blend: scale of the length by weights of presence-only and spatial candidates."""
    policies = G.table(spark, "blend").select("place", "scale", "po_weight", "pa_weight")
    risk = T.surveys(spark, d).select("survey", R.log_ramp(F.abs(F.col("lat") - 48) * 111, 201.0).alias("risk"))
    s = R.ranked(T.marked(spark, d, own=risk), "p").withColumn("own", F.when(F.col("rank") <= 96, F.col("p") / F.greatest(F.max("p").over(Window.partitionBy("survey")), F.lit(1e-8))).otherwise(0.0))
    part = lambda n, k, c: F.when((F.col("survey") + F.col("species")) % n == k, F.col("q")).otherwise(0.0).alias(c)
    rows = s.where("truth > 0").select("survey", "truth", "risk", "_row", F.struct("species", "hit", "own", part(3, 0, "po"), part(4, 1, "pa")).alias("_x"))
    value = lambda x, k: x["own"] + np.where(x["risk"] >= 0.5, k["po_weight"], 0.05) * x["po"] + k["pa_weight"] * x["pa"]
    length = lambda p, s: R.adaptive_count(F.log1p("truth"), p["scale"], 4, 50)
    return S.chosen(S.ranked(rows, policies, ["po_weight", "pa_weight"], value, length, given=["own", "po", "pa", "risk"]), policies, [])


# A list of twelve and a second ranking: what each gives to a species, and the lengths that the second one would have.
_TWO = """two AS MATERIALIZED (SELECT s.survey, s.species, p, q, (y.species IS NOT NULL)::INT AS hit, row_number() OVER (PARTITION BY s.survey ORDER BY p DESC, s.species) AS rp, row_number() OVER (PARTITION BY s.survey ORDER BY q DESC, s.species) AS rq, count(*) OVER (PARTITION BY s.survey) AS size FROM scores s LEFT JOIN pairs y USING (survey, species)),
    cand AS MATERIALIZED (SELECT survey, species, hit, p, q, CASE WHEN rp <= 12 THEN rp END AS base, CASE WHEN rp <= 12 THEN 1 - 0.7::DOUBLE * (rp - 1) / greatest(least(size, 12) - 1, 1) ELSE 0 END AS own, CASE WHEN rq <= 64 THEN 1 - 0.85::DOUBLE * (rq - 1) / greatest(least(size, 64) - 1, 1) ELSE 0 END AS other,
        ((survey + species) % 4 = 1)::INT * q AS near, ((survey + species) % 3 = 0)::INT * p AS along, coalesce(n, 0) BETWEEN 1 AND 25 AS rare FROM two LEFT JOIN prevalence USING (species))"""


def _best_sql(scale: str, alias: str) -> str:
    return f"""(SELECT survey, rank AS {alias} FROM (SELECT survey, rq AS rank, round(2 * sum(q) OVER (PARTITION BY survey ORDER BY rq) / (rq + {scale} * sum(q) OVER (PARTITION BY survey) + 1e-8), 9) AS v FROM two) WHERE rank BETWEEN 8 AND 40 QUALIFY row_number() OVER (PARTITION BY survey ORDER BY v DESC, rank) = 1)"""


_LENGTHS = f"SELECT o.survey, n0, l08, l10, l12, risk FROM (SELECT survey, count(base)::DOUBLE AS n0 FROM cand GROUP BY 1) o JOIN {_best_sql('0.8', 'l08')} a USING (survey) JOIN {_best_sql('1.0', 'l10')} b USING (survey) JOIN {_best_sql('1.2', 'l12')} c USING (survey) JOIN (SELECT survey, {_RAMP} AS risk FROM surveys) USING (survey)"
_OTHER = "CASE scale WHEN 0.8 THEN l08 WHEN 1.2 THEN l12 ELSE l10 END"


def _two(spark: SparkSession, d: str, reached: list[float] = [], lengths: bool = True) -> DataFrame:  # noqa: B006
    """A row a candidate, ``_x`` with what the list and the second ranking give it, and of its survey n0, lengths by scale, risk; ``reach``:
    how many of the second ranking reach each threshold of ``reached``."""
    risk = T.surveys(spark, d).select("survey", R.log_ramp(F.abs(F.col("lat") - 48) * 111, 201.0).alias("risk"))
    best = ("q", list(G.DECODE_SCALES), 8, 40) if lengths else None
    rows = S.placed(T.marked(spark, d, T.prevalence(spark, d), risk), ["p", "q"], best, ("q", reached) if reached else None).where("size >= 8")
    p, q = F.col("rank_p"), F.col("rank_q")
    own = F.when(p <= 12, 1 - 0.7 * (p - 1) / F.greatest(F.least("size", F.lit(12)) - 1, F.lit(1))).otherwise(0.0)
    other = F.when(q <= 64, 1 - 0.85 * (q - 1) / F.greatest(F.least("size", F.lit(64)) - 1, F.lit(1))).otherwise(0.0)
    part = lambda n, k, c: F.when((F.col("survey") + F.col("species")) % n == k, F.col(c)).otherwise(0.0)
    x = F.struct("species", "hit", "p", "q", F.when(p <= 12, p).alias("base"), own.alias("own"), other.alias("other"), part(4, 1, "q").alias("near"), part(3, 0, "p").alias("along"), F.col("n").between(1, 25).alias("rare"))
    each = {f"l{int(10 * c):02d}": F.get("best", F.lit(i)) for i, c in enumerate(G.DECODE_SCALES)} if lengths else {}
    return rows.select("survey", "risk", "truth", "_row", x.alias("_x"), F.least("size", F.lit(12)).cast("double").alias("n0"), *[c.alias(n) for n, c in each.items()], *(["reach"] if reached else []))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """One row a survey: its number of labels and its candidates ``c``, with what the list and the second ranking give them."""
    rows = S.gathered(T.marked(spark, d, own=T.surveys(spark, d).select("survey")), ["species", "hit", "p", "q"], ["p"]).where(F.size("c") >= 8)
    values = lambda x: F.struct(x["species"].alias("species"), x["hit"].alias("hit"), x["p"].alias("p"), x["q"].alias("q"), F.when(x["rank_p"] <= 12, x["rank_p"]).alias("base"))
    return rows.select("survey", "truth", F.transform("c", values).alias("c"))


def _other_length(scale: Column) -> Column:
    return F.when(scale == 0.8, F.col("l08")).when(scale == 1.2, F.col("l12")).otherwise(F.col("l10"))


_ALL = ("scores", "pairs", "surveys", "prevalence")


@register("decode_search", sql(_ranked_sql(f"{_TRUTH}, {_TWO}, {_SIZES}", "decode", ["alpha", "scale"], ["alpha"], "(1 - alpha) * own + alpha * other", f"least(greatest(round_even((1 - alpha) * n0 + alpha * {_OTHER}, 0), 8), 40)", "alpha, ", _LENGTHS), *_ALL))
def decode_search(spark: SparkSession, d: str) -> DataFrame:
    """13 policies: the weight of a second ranking and the scale of the length that it would have."""
    policies = G.table(spark, "decode").select("place", F.col("alpha"), F.col("alpha").alias("a"), "scale")
    value = lambda x, k: (1 - k["alpha"]) * x["own"] + k["alpha"] * x["other"]
    length = lambda p, s: C.blended_length(F.col("n0"), _other_length(p["scale"]), p["a"], None, 8, 40)
    return S.chosen(S.ranked(_two(spark, d), policies, ["alpha"], value, length, given=["own", "other"]), policies, [F.col("alpha")])


_FUSED = "(1 - alpha - (alpha_far - alpha) * risk) * own + (alpha + (alpha_far - alpha) * risk) * other + rare_weight * rare::INT + spatial * near + cooccurrence * along + kept_rare * (rare AND base IS NOT NULL)::INT"
_FUSED_KEYS = ["alpha", "alpha_far", "rare_weight", "spatial", "cooccurrence", "kept_rare"]
_FUSED_LENGTH = """least(greatest(round_even(least(greatest((1 - count_weight) * n0 + count_weight * CASE WHEN threshold IS NULL THEN l10 ELSE (SELECT count(*) FROM cand WHERE cand.survey = own.survey AND q >= threshold) END, coalesce(n0 - change, -1e9)), coalesce(n0 + change, 1e9)), 0), minimum_k), maximum_k)"""


def _fused_sql(grid: str) -> str:
    text = _ranked_sql(f"{_TRUTH}, {_TWO}, {_SIZES}", grid, ["alpha", "alpha_far", "rare", "spatial", "cooccurrence", "kept_rare", "count_weight", "change", "minimum_k", "maximum_k", "threshold"], _FUSED_KEYS, _FUSED, _FUSED_LENGTH, "alpha + alpha_far, ", _LENGTHS)
    return sql(text.replace("alpha_far, rare, spatial", "alpha_far, rare_weight, spatial", 1), *_ALL)


def _fused(spark: SparkSession, d: str, grid: str) -> DataFrame:
    fields = ["alpha", "alpha_far", F.col("rare").alias("rare_weight"), "spatial", "cooccurrence", "kept_rare", "count_weight", "change", F.col("minimum_k").alias("low"), F.col("maximum_k").alias("high"), "threshold"]
    policies = G.table(spark, grid).select("place", *fields)

    def value(x: dict, k: dict) -> np.ndarray:
        a = k["alpha"] + (k["alpha_far"] - k["alpha"]) * x["risk"]
        return (1 - a) * x["own"] + a * x["other"] + k["rare_weight"] * x["rare"] + k["spatial"] * x["near"] + k["cooccurrence"] * x["along"] + k["kept_rare"] * (x["rare"] * (x["base"] > 0))

    thresholds = sorted({r["threshold"] for r in G.rows_of(grid)} - {None})

    def length(p: Column, s: Column) -> Column:
        other = F.col("l10")
        for i, v in enumerate(thresholds):
            other = F.when(p["threshold"] == v, F.col("reach")[i]).otherwise(other)
        mixed = (1 - p["count_weight"]) * F.col("n0") + p["count_weight"] * other
        kept = F.least(F.greatest(mixed, F.coalesce(F.col("n0") - p["change"], F.lit(-1e9))), F.coalesce(F.col("n0") + p["change"], F.lit(1e9)))
        return F.least(F.greatest(F.rint(kept), p["low"]), p["high"])

    return S.chosen(S.ranked(_two(spark, d, thresholds), policies, _FUSED_KEYS, value, length, given=["own", "other", "rare", "near", "along", "base", "risk"]), policies, [F.col("alpha") + F.col("alpha_far")])


@register("bonus_search", _fused_sql("bonus"))
def bonus_search(spark: SparkSession, d: str) -> DataFrame:
    """Nine policies: the second ranking's weight near and far, and bonuses of rare, spatial and co-occurring species."""
    return _fused(spark, d, "bonus")


@register("adaptive_search", _fused_sql("adaptive"))
def adaptive_search(spark: SparkSession, d: str) -> DataFrame:
    """Seven policies with bounded changes of the length, by the second ranking or by a threshold."""
    return _fused(spark, d, "adaptive")


@register("spatial_search", _fused_sql("spatial"))
def spatial_search(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, "spatial")


@register("pyramid_search", _fused_sql("pyramid"))
def pyramid_search(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, "pyramid")


_MEMBER = "first * p + second * q + third * sqrt(p * q) + fourth * (p + q) / 2"


@register("members_search", sql(_ranked_sql(f"{_TRUTH}, {_TWO}, {_SIZES}", "members", ["first", "second", "third", "fourth", "learned", "alpha"], ["first", "second", "third", "fourth", "alpha"], f"(1 - alpha) * own + alpha * ({_MEMBER})", "least(greatest(round_even((1 - learned) * n0 + learned * l10, 0), 8), 40)", "alpha, learned, ", _LENGTHS), *_ALL))
def members_search(spark: SparkSession, d: str) -> DataFrame:
    """31 policies: weights of four members, the share of the learnt length, the weight against the list."""
    policies = G.table(spark, "members").select("place", "first", "second", "third", "fourth", "learned", "alpha")
    mix = lambda x, k: k["first"] * x["p"] + k["second"] * x["q"] + k["third"] * np.sqrt(x["p"] * x["q"]) + k["fourth"] * (x["p"] + x["q"]) / 2
    value = lambda x, k: (1 - k["alpha"]) * x["own"] + k["alpha"] * mix(x, k)
    length = lambda p, s: C.blended_length(F.col("n0"), F.col("l10"), p["learned"], None, 8, 40)
    return S.chosen(S.ranked(_two(spark, d), policies, ["first", "second", "third", "fourth", "alpha"], value, length, given=["p", "q", "own"]), policies, [F.col("alpha"), F.col("learned")])


_TRIO = "(first * p + second * q + third * sqrt(p * q)) / (first + second + third)"


@register("trio_search", sql(_ranked_sql(f"{_CAND}, {_SIZES}", "trio", ["first", "second", "third", "scale", "k"], ["first", "second", "third"], _TRIO,
    """coalesce(k, (SELECT arg_max(b.rank, (b.s, -b.rank)) FROM (SELECT x.survey, x.first, x.second, x.third, x.rank, e.scale, round(2 * upto / (x.rank + e.scale * total + 1e-8), 9) AS s
        FROM (SELECT *, sum(val) OVER (PARTITION BY survey, first, second, third ORDER BY rank) AS upto, sum(val) OVER (PARTITION BY survey, first, second, third) AS total FROM r) x CROSS JOIN (VALUES (0.7::DOUBLE), (1.0), (1.3)) AS e(scale) WHERE x.rank BETWEEN 8 AND 40) b
        WHERE b.survey = own.survey AND b.first = pol.first AND b.second = pol.second AND b.third = pol.third AND b.scale = pol.scale))"""), *_NEEDS))  # fmt: skip
def trio_search(spark: SparkSession, d: str) -> DataFrame:
    """15 policies: three ensembles of three members, at their own best length by scale or at a fixed one."""
    policies = G.table(spark, "trio").select("place", "first", "second", "third", "scale", "k")
    value = lambda x, k: (k["first"] * x["p"] + k["second"] * x["q"] + k["third"] * np.sqrt(x["p"] * x["q"])) / (k["first"] + k["second"] + k["third"])
    length = lambda p, s: F.coalesce(p["k"], S.best_length(s, p["scale"], 8, 40))
    return S.chosen(S.ranked(_cands(spark, d), policies, ["first", "second", "third"], value, length, given=["p", "q"]), policies, [])


def _swap_sql(grid: str, fields: list[str], value: str, allowed: str, gain: str, smaller: str, kept: float, most: int = 8) -> str:
    return sql(f"""WITH {_TRUTH}, {_TWO}, pol AS {G.values(grid, *fields)}, risks AS (SELECT survey, {_RAMP} AS risk FROM surveys),
    v AS (SELECT c.survey, pol.*, species, hit, base, risk, p, q, round({value}, 9) AS val, count(base) OVER (PARTITION BY c.survey, place) AS n FROM cand c JOIN risks USING (survey) CROSS JOIN pol),
    o AS (SELECT survey, place, val, hit, row_number() OVER (PARTITION BY survey, place ORDER BY val, base DESC) AS i FROM v WHERE base > ceil(n * {kept}::DOUBLE)),
    u AS (SELECT survey, place, swaps, val, hit, margin, row_number() OVER (PARTITION BY survey, place ORDER BY val DESC, species) AS i FROM v WHERE base IS NULL AND {allowed}),
    g AS (SELECT o.survey, o.place, sum(u.hit - o.hit) AS more FROM o JOIN u USING (survey, place, i) WHERE i <= u.swaps AND {gain} GROUP BY ALL),
    b AS (SELECT survey, place, any_value(n) AS n, sum(hit) FILTER (base IS NOT NULL) AS hits FROM v GROUP BY ALL),
    f AS (SELECT b.place, b.survey, 2 * (coalesce(hits, 0) + coalesce(more, 0)) / greatest(n + coalesce(truth, 0), 1)::DOUBLE AS f1 FROM b LEFT JOIN g USING (survey, place) LEFT JOIN truth USING (survey)),
    {_choice_sql("f", "", smaller)}""", *_ALL)


_RESIDUAL = "(p + first * q + second * sqrt(p * q)) / (1 + first + second)"


def _every(x: dict, k: dict) -> np.ndarray:
    return np.ones(len(x["p"]), bool)


def _swaps(spark: SparkSession, d: str, grid: str, fields: list[str], value: Callable, gain: Callable, kept: float, smaller: list[Column]) -> DataFrame:
    policies = G.table(spark, grid).select("place", *dict.fromkeys([*fields, "swaps"]))
    each = S.swapped(_two(spark, d, lengths=False), policies, "base", ["p", "q", "along"], value, _every, gain, kept, 8, fields)
    return S.chosen(each, policies, smaller)


def _residual(spark: SparkSession, d: str, grid: str) -> DataFrame:
    value = lambda x, k: (x["p"] + k["first"] * x["q"] + k["second"] * np.sqrt(x["p"] * x["q"])) / (1 + k["first"] + k["second"])
    return _swaps(spark, d, grid, ["first", "second"], value, lambda low, high: high > low, 0.6, [F.col("swaps"), F.col("first") + F.col("second")])


def _residual_sql(grid: str) -> str:
    return _swap_sql(grid, ["first", "second", "swaps", "margin"], _RESIDUAL, "true", "u.val > o.val", "swaps, first + second, ", 0.6)


@register("habitat_search", _residual_sql("habitat"))
def habitat_search(spark: SparkSession, d: str) -> DataFrame:
    """15 policies: weights of two further members in the tail's scores, and the greatest number of swaps."""
    return _residual(spark, d, "habitat")


@register("bag_search", _residual_sql("bag"))
def bag_search(spark: SparkSession, d: str) -> DataFrame:
    return _residual(spark, d, "bag")


@register("attention_search", _residual_sql("attention"))
def attention_search(spark: SparkSession, d: str) -> DataFrame:
    return _residual(spark, d, "attention")


@register("graph_search", _swap_sql("graph", ["alpha", "weight", "swaps", "margin"], "p + alpha * weight * along", "true", "u.val > o.val", "swaps, alpha, weight, ", 0.6).replace("risk, p, q, round(", "risk, p, q, round("))
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """17 policies: the strength of co-occurring species, their weight, the greatest number of swaps."""
    value = lambda x, k: x["p"] + k["alpha"] * k["weight"] * x["along"]
    return _swaps(spark, d, "graph", ["alpha", "weight"], value, lambda low, high: high > low, 0.6, [F.col("swaps"), F.col("alpha"), F.col("weight")])


@register("tail_search", _swap_sql("tail", ["swaps", "risk", "score", "margin"], "CASE WHEN base IS NULL THEN q ELSE p END", "q >= score AND risk >= least_risk", "u.val - o.val >= u.margin", "swaps, ", 0.5).replace("v(place, swaps, risk, score", "v(place, swaps, least_risk, score"))
def tail_search(spark: SparkSession, d: str) -> DataFrame:
    """Five policies: swaps of the lower half for species seen nearby, where the risk, the score and the margin allow."""
    value = lambda x, k: np.where(x["base"] == 0, x["q"], x["p"])
    policies = G.table(spark, "tail").select("place", "swaps", F.col("risk").alias("least_risk"), "score", "margin")
    allowed = lambda x, k: (x["q"] >= k["score"]) & (x["risk"] >= k["least_risk"])
    each = S.swapped(_two(spark, d, lengths=False), policies, "base", ["p", "q", "base", "risk"], value, allowed, lambda low, high: F.round(high - low, 9) >= F.col("margin"), 0.5, 8, ["least_risk", "score", "margin"])
    return S.chosen(each, policies, [F.col("swaps")])


@register("edit_search", sql(f"""WITH {_TRUTH}, {_TWO}, pol AS {G.values("edits", "swaps", "delta", "margin")},
    x AS MATERIALIZED (SELECT survey, species, hit, base, round(CASE WHEN base IS NOT NULL THEN 0.3 - q ELSE q - 0.7 END, 9)::DOUBLE AS gain, count(base) OVER (PARTITION BY survey) AS n FROM cand),
    o AS MATERIALIZED (SELECT survey, gain, hit, row_number() OVER (PARTITION BY survey ORDER BY gain DESC, species DESC) AS i FROM x WHERE base > ceil(0.6::DOUBLE * n)),
    u AS MATERIALIZED (SELECT survey, gain, hit, row_number() OVER (PARTITION BY survey ORDER BY gain DESC, species DESC) AS i FROM x WHERE base IS NULL),
    sw AS (SELECT o.survey, place, count(*) AS s FROM o JOIN u USING (survey, i) CROSS JOIN pol WHERE i <= swaps AND round(o.gain + u.gain, 9) > margin GROUP BY ALL),
    st AS (SELECT a.survey, n, h, pol.*, coalesce(s, 0) AS s FROM (SELECT survey, any_value(n) AS n, sum(hit) FILTER (base IS NOT NULL) AS h FROM x GROUP BY 1) a CROSS JOIN pol LEFT JOIN sw ON sw.survey = a.survey AND sw.place = pol.place),
    pick AS (SELECT st.*, u.gain AS plus, o.gain AS minus FROM st LEFT JOIN u ON u.survey = st.survey AND u.i = s + 1 LEFT JOIN o ON o.survey = st.survey AND o.i = s + 1),
    way AS (SELECT *, CASE WHEN n < 40 AND plus > margin AND (NOT coalesce(n > 8 AND minus > margin, false) OR plus >= minus) THEN 1 WHEN n > 8 AND minus > margin THEN -1 ELSE 0 END AS way FROM pick),
    gone AS (SELECT w.survey, w.place, count(*) AS k, sum(o.hit) AS h FROM way w JOIN o ON o.survey = w.survey WHERE i <= s OR (way = -1 AND i <= s + least(delta, n - 8) AND gain > margin) GROUP BY ALL),
    came AS (SELECT w.survey, w.place, count(*) AS k, sum(u.hit) AS h FROM way w JOIN u ON u.survey = w.survey WHERE i <= s OR (way = 1 AND i <= s + least(delta, 40 - n) AND gain > margin) GROUP BY ALL),
    f AS (SELECT w.place, w.survey, 2 * (coalesce(w.h, 0) - coalesce(g.h, 0) + coalesce(c.h, 0)) / greatest(n - coalesce(g.k, 0) + coalesce(c.k, 0) + coalesce(truth, 0), 1)::DOUBLE AS f1
        FROM way w LEFT JOIN gone g USING (survey, place) LEFT JOIN came c USING (survey, place) LEFT JOIN truth USING (survey)),
    {_choice_sql("f", "", "swaps + delta, ")}""", *_ALL))  # fmt: skip
def edit_search(spark: SparkSession, d: str) -> DataFrame:
    """11 policies of the set editor: swaps, one-sided edits and the margin of predicted gains."""
    policies = G.table(spark, "edits").select("place", "swaps", "delta", "margin")
    gain = lambda x: F.round(F.when(x["base"].isNotNull(), 0.3 - x["q"]).otherwise(x["q"] - 0.7), 9)
    each = S.edited(_listed(spark, d), policies, lambda x: x["base"], gain, 8, 40, 0.6, 8)
    return S.chosen(each, policies, [F.col("swaps") + F.col("delta")])
