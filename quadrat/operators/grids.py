"""Registered policy grids and gate sets as data: tables that queries join, and the same rows as SQL values."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

# The registered grids, as the fields over which each is a product.  A grid may begin with a control row.
TOP_K = (1, 2, 4, 8, 10, 12, 14, 16, 18, 20, 22, 25, 30)
THRESHOLDS = (0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.22, 0.26, 0.30)
MINIMUM_K = (1, 2, 4, 8, 12, 14, 16)
CHALLENGER_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
CHALLENGER_TOP_K = (8, 12, 16, 18, 20, 24, 30)
CHALLENGER_THRESHOLDS = (0.08, 0.12, 0.16, 0.20, 0.25, 0.30)
CHALLENGER_MINIMUM_K = (4, 12, 18)
BLEND_SCALES, BLEND_PO, BLEND_PA = (0.75, 0.9, 1.0, 1.15, 1.3), (0.0, 0.2, 0.4, 0.6), (0.0, 0.4, 0.8)
GATED_ALPHAS = (0.0, 0.025, 0.05, 0.1, 0.15, 0.2)
WIDE_ALPHAS = (0.0, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5)
TRANSITION_ALPHAS = (0.0, 0.025, 0.05, 0.10, 0.20, 0.35)
GATES = ("uniform", "pa_distance", "pa_po", "pa_po_disagreement")
NEAR_FAR = ((20, 20), (16, 20), (18, 22), (20, 24), (20, 28))
DECODE_ALPHAS, DECODE_SCALES = (0.25, 0.5, 0.75, 1.0), (0.8, 1.0, 1.2)
MEMBERS = ((0.5, 0.0, 0.5, 0.0), (1 / 3, 0.0, 1 / 3, 1 / 3), (0.6, 0.0, 0.2, 0.2), (0.2, 0.0, 0.4, 0.4), (0.3, 0.1, 0.3, 0.3))
LEARNED, MEMBER_ALPHAS = (0.0, 0.5, 1.0), (0.75, 1.0)
HABITAT, HABITAT_SWAPS = ((0.5, 0.0), (0.5, 0.25), (0.5, 0.5), (1.0, 0.0), (1.0, 0.25), (1.0, 0.5), (0.0, 1.0)), (2, 4)
BAG = ((0.5, 0.0), (1.0, 0.0), (0.0, 0.5), (0.0, 1.0), (0.5, 0.5), (1.0, 0.5), (1.0, 1.0))
ATTENTION = ((0.5, 0.0), (1.0, 0.0), (0.0, 0.5), (0.0, 1.0), (0.5, 0.5), (1.0, 0.5), (0.5, 1.0), (1.0, 1.0))
MORE_SWAPS = (2, 4, 8)
GRAPH_ALPHAS, GRAPH_WEIGHTS, GRAPH_SWAPS = (0.0, 0.25, 0.5, 1.0), (1.0, 2.0), (2, 4)
EDIT_STEPS, EDIT_MARGINS = ((2, 0), (4, 0), (0, 1), (0, 2), (2, 2)), (0.0, 0.0005)
TRIOS = ((1.0, 1.0, 1.0), (1.0, 2.0, 1.0), (0.0, 1.0, 1.0))
TRIO_SCALES, TRIO_LENGTHS = (0.7, 1.0, 1.3), (18, 24)
# Alpha near and far, weights of rare, spatial and co-occurring candidates, weight of the other length.
BONUS = (
    (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.10, 0.18, 0.0, 0.0, 0.0, 0.25), (0.16, 0.28, 0.0, 0.0, 0.0, 0.35),
    (0.14, 0.28, 0.055, 0.0, 0.0, 0.35), (0.14, 0.28, 0.0, 0.0, 0.035, 0.35), (0.12, 0.24, 0.0, 0.045, 0.0, 0.35),
    (0.14, 0.28, 0.045, 0.035, 0.025, 0.35), (0.10, 0.20, 0.030, 0.025, 0.020, 0.25), (0.08, 0.34, 0.060, 0.025, 0.020, 0.40),
)
# As above, then the greatest change of the length, its bounds, a threshold of the length or none, the bonus of kept rare species.
ADAPTIVE = (
    (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 10, 36, None, 0.0), (0.10, 0.20, 0.0, 0.0, 0.0, 0.50, 8, 12, 34, None, 0.02),
    (0.14, 0.28, 0.0, 0.0, 0.0, 1.0, 16, 10, 36, None, 0.025), (0.14, 0.30, 0.02, 0.025, 0.02, 1.0, 16, 10, 36, None, 0.03),
    (0.16, 0.32, 0.0, 0.0, 0.0, 1.0, 18, 14, 36, 0.10, 0.02), (0.16, 0.32, 0.0, 0.0, 0.0, 1.0, 18, 14, 36, 0.15, 0.02),
    (0.16, 0.32, 0.0, 0.0, 0.0, 1.0, 18, 14, 36, 0.20, 0.02),
)
# Alpha near and far, weight of the other length, its greatest change and bounds, the bonus of kept rare species.
SPATIAL = (
    (0.0, 0.0, 0.0, 0, 10, 40, 0.0), (0.10, 0.10, 0.0, 0, 10, 40, 0.04), (0.20, 0.20, 0.0, 0, 10, 40, 0.04),
    (0.30, 0.30, 0.0, 0, 10, 40, 0.05), (0.16, 0.24, 0.20, 3, 10, 40, 0.05), (0.22, 0.32, 0.35, 5, 10, 40, 0.06),
)
PYRAMID = (
    (0.0, 0.0, 0.0, 0, 10, 40, 0.0), (0.25, 0.25, 0.0, 0, 10, 40, 0.0), (0.40, 0.40, 0.0, 0, 10, 40, 0.0),
    (0.30, 0.40, 0.35, 5, 10, 40, 0.0), (0.38, 0.50, 0.50, 7, 9, 40, 0.0), (0.48, 0.60, 0.65, 10, 8, 40, 0.0),
)
# Swaps, least risk, least score of the newcomer, least margin.
TAIL = ((0, 1.0, 1.0, 1.0), (1, 0.30, 0.62, 0.30), (2, 0.38, 0.58, 0.24), (3, 0.50, 0.54, 0.20), (4, 0.58, 0.50, 0.16))

FIELDS = {
    "grid": "string", "place": "int", "kind": "string", "alpha": "double", "alpha_far": "double", "gate": "string", "k": "int", "k_far": "int", "transition": "double",
    "threshold": "double", "minimum_k": "int", "maximum_k": "int", "scale": "double", "po_weight": "double", "pa_weight": "double", "weight": "double",
    "first": "double", "second": "double", "third": "double", "fourth": "double", "learned": "double", "swaps": "int", "delta": "int", "margin": "double",
    "rare": "double", "spatial": "double", "cooccurrence": "double", "count_weight": "double", "change": "int", "kept_rare": "double", "risk": "double", "score": "double",
}


def _cuts(top: tuple, thresholds: tuple, least: tuple) -> list[dict]:
    return [{"kind": "top_k", "k": k} for k in top] + [{"kind": "threshold_min_k", "threshold": t, "minimum_k": m, "maximum_k": 50} for t, m in product(thresholds, least)]


def _fused(r: tuple, low: int, high: int, change: int | None, threshold: float | None = None, kept: float = 0.0, bonus: tuple = (0.0, 0.0, 0.0), count: float = 0.0) -> dict:
    return {"kind": "fused", "alpha": r[0], "alpha_far": r[1], "rare": bonus[0], "spatial": bonus[1], "cooccurrence": bonus[2], "count_weight": count, "change": change, "minimum_k": low, "maximum_k": high, "threshold": threshold, "kept_rare": kept}


def _grids() -> dict[str, list[dict]]:
    swaps = lambda kind, pairs, steps: [{"kind": "control", "first": 0.0, "second": 0.0, "swaps": 0}] + [{"kind": kind, "first": a, "second": b, "swaps": k} for (a, b), k in product(pairs, steps)]
    gated = lambda alphas: [{"kind": "gated", "alpha": a, "gate": g, "k": 20} for a, g in product(alphas, GATES[:2])]
    one = {"alpha": 0.0, "swaps": 0, "delta": 0}
    return {
        "cut": _cuts(TOP_K, THRESHOLDS, MINIMUM_K),
        "challenger": [{**c, "weight": w} for w, c in product(CHALLENGER_WEIGHTS, _cuts(CHALLENGER_TOP_K, CHALLENGER_THRESHOLDS, CHALLENGER_MINIMUM_K))],
        "blend": [{"kind": "blend", "scale": c, "po_weight": po, "pa_weight": pa} for c, po, pa in product(BLEND_SCALES, BLEND_PO, BLEND_PA)],
        "gated": gated(GATED_ALPHAS),
        "gated_wide": gated(WIDE_ALPHAS),
        "transition": [{"kind": "gated", "alpha": a, "gate": g, "k": n, "k_far": f, "transition": 0.5} for a, g, (n, f) in product(TRANSITION_ALPHAS, GATES, NEAR_FAR) if g != "uniform" or n == f],
        "bonus": [_fused(r, 8, 40, None, bonus=r[2:5], count=r[5]) for r in BONUS],
        "adaptive": [_fused(r, r[7], r[8], r[6], r[9], r[10], r[2:5], r[5]) for r in ADAPTIVE],
        "spatial": [_fused(r, r[4], r[5], r[3], kept=r[6], count=r[2]) for r in SPATIAL],
        "pyramid": [_fused(r, r[4], r[5], r[3], kept=r[6], count=r[2]) for r in PYRAMID],
        "tail": [{"kind": "tail" if s else "control", "swaps": s, "risk": r, "score": p, "margin": m} for s, r, p, m in TAIL],
        "decode": [{"kind": "control", "alpha": 0.0, "scale": 1.0}] + [{"kind": "decode", "alpha": a, "scale": c} for a, c in product(DECODE_ALPHAS, DECODE_SCALES)],
        "members": [{"kind": "control", **dict(zip(("first", "second", "third", "fourth"), MEMBERS[0])), "learned": 0.0, **one}]
        + [{"kind": "members", **dict(zip(("first", "second", "third", "fourth"), m)), "learned": c, "alpha": a} for m, c, a in product(MEMBERS, LEARNED, MEMBER_ALPHAS)],
        "habitat": swaps("swap", HABITAT, HABITAT_SWAPS),
        "bag": swaps("swap", BAG, MORE_SWAPS),
        "attention": swaps("swap", ATTENTION, MORE_SWAPS),
        "graph": [{"kind": "control", "alpha": 0.0, "weight": 0.0, "swaps": 0}] + [{"kind": "graph", "alpha": a, "weight": w, "swaps": k} for a, w, k in product(GRAPH_ALPHAS, GRAPH_WEIGHTS, GRAPH_SWAPS)],
        "edits": [{"kind": "control", "swaps": 0, "delta": 0, "margin": 0.0}] + [{"kind": "edit", "swaps": s, "delta": c, "margin": m} for (s, c), m in product(EDIT_STEPS, EDIT_MARGINS)],
        "trio": [{"kind": "trio", "first": a, "second": b, "third": c, **mode} for (a, b, c), mode in product(TRIOS, [{"scale": s} for s in TRIO_SCALES] + [{"k": k} for k in TRIO_LENGTHS])],
    }


def rows_of(grid: str) -> list[dict]:
    """The policies of a grid, with ``place`` in it; fields that it does not have are left out."""
    return [{"grid": grid, "place": i, **r} for i, r in enumerate(_grids()[grid])]


def names() -> list[str]:
    return list(_grids())


def table(spark: SparkSession, *grids: str) -> DataFrame:
    """Policies of some grids (of all, if none is named), one row each; null where a grid has no such field."""
    rows = [tuple(r.get(c) for c in FIELDS) for g in grids or names() for r in rows_of(g)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in FIELDS.items()))


def values(grid: str, *fields: str) -> str:
    """The same rows as SQL: a table of place and the fields."""
    say = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    kinds = {"double": "DOUBLE", "int": "INT", "string": "VARCHAR"}
    rows = ", ".join("(" + ", ".join(f"{say(r.get(f))}::{kinds[FIELDS[f]]}" for f in ("place", *fields)) + ")" for r in rows_of(grid))
    return f"(SELECT * FROM (VALUES {rows}) AS v(place, {', '.join(fields)}))"


#: Gate sets: (set, gate, metric, group, comparison, bound).  A gate holds if all rows of its metric in the group's class compare so with the
#: bound, ``at least n`` counts the rows that are over the bound, and a metric that is absent or not a number holds nothing.
RULES = "gate_set string, gate string, metric string, level string, comparison string, bound double, least int"

# The registered sets of conditions.
_COMMON = [("gain", "gain", "all", ">", 0.0, None), ("interval", "ci_low", "all", ">", 0.0, None)]
_INTEGRITY = ("integrity", "integrity", "check", "==", 1.0, 1)
_SETS = {
    "first_expert": [
        ("registered_policy", "registered", "policy", "==", 1.0, None), ("nonzero_weight", "alpha", "policy", ">", 0.0, None), *_COMMON,
        ("gain_over_zero", "gain_over_zero", "all", ">", 0.0, None), ("blocks", "blocks", "all", ">=", 2.0, None), ("iterations", "iterations", "all", "==", 500.0, None),
        ("seed", "seed_matches", "all", "==", 1.0, None), _INTEGRITY,
    ],
    "retained_expert": [
        _COMMON[1], ("gain_over_base", "gain_over_base", "all", ">", 0.0, None), ("gain_over_zero", "gain_over_zero", "all", ">", 0.0, None), ("every_fold", "gain", "fold", ">", 0.0, 2),
        ("weight_every_fold", "alpha", "fold", ">", 0.0, 2), ("weight_in_production", "alpha", "production", ">", 0.0, None), _INTEGRITY,
    ],
    "single_head": [
        _COMMON[1], ("gain_over_zero", "gain_over_zero", "all", ">", 0.0, None), ("gain_over_retained", "gain_over_retained", "all", ">", 0.0, None), ("every_fold", "gain", "fold", ">", 0.0, 2),
        ("weight_every_fold", "alpha", "fold", ">", 0.0, 2), ("weight_in_production", "alpha", "production", ">", 0.0, None), _INTEGRITY,
    ],
    "pyramid": [
        *_COMMON, ("every_fold", "gain", "fold", ">", 0.0, 2), ("countries", "gain", "country_200", "count >", 0.0, 2), ("common_species", "common_f1_change", "fold", ">=", -0.002, 2),
        ("length_error", "length_mae_change", "all", "<=", 0.25, None), ("rare_species", "rare_f1_ratio", "all", ">=", 0.8, None), ("new_policy", "new_policy", "policy", "==", 1.0, None),
    ],
    "tail": [
        *_COMMON, ("every_fold", "gain", "fold", ">", 0.0, 2), ("countries", "gain", "country_100", "count >", 0.0, 2), ("length_unchanged", "length_changed", "all", "==", 0.0, None),
        ("some_swaps", "most_swaps", "all", ">", 0.0, None), ("few_swaps", "most_swaps", "all", "<=", 4.0, None), ("new_policy", "new_policy", "policy", "==", 1.0, None),
    ],
    "residual": [
        *_COMMON, ("every_fold", "gain", "fold", ">", 0.0, 2), ("country_macro", "macro_gain", "country_30", ">", 0.0, None), ("outside_core", "gain", "outside", ">", 0.0, None),
        ("outside_rows", "rows", "outside", ">=", 30.0, None), ("buffer", "buffer_km", "fold", ">=", 20.0, 2), ("new_policy", "new_policy", "policy", "==", 1.0, None),
    ],
    "practical": [
        ("practical_gain", "gain", "all", ">=", 0.001, None), ("interval", "ci_low", "all", ">=", 0.00025, None), ("every_fold", "gain", "fold", ">", 0.0, 2), ("country_macro", "macro_gain", "country_30", ">", 0.0, None),
        ("outside_core", "gain", "outside", ">=", 0.0005, None), ("outside_rows", "rows", "outside", ">=", 30.0, None), ("buffer", "buffer_km", "fold", ">=", 20.0, 2), _INTEGRITY,
    ],
}


def gate_rows() -> list[tuple]:
    return [(s, g, m, level, c, b, n) for s, rules in _SETS.items() for g, m, level, c, b, n in rules]


def gate_table(spark: SparkSession) -> DataFrame:
    """The rules of all gate sets: gate_set, gate, metric, level, comparison, bound and the least number of rows, if any."""
    return spark.createDataFrame(gate_rows(), RULES)
