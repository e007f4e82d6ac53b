"""Queries that read labels and ranks off one row a candidate."""

import pytest
from compare import DATA

from quadrat.queries import QUERIES


@pytest.mark.parametrize("name", ["residual_edit", "bounded_tail_swap", "three_way_blend", "fusion_ablations", "policy_search"])
def test_no_candidate_is_shuffled(spark, name):
    """Above the candidates nothing is shuffled by survey or species; before, lists met labels or each other again."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate posexplode(concat(own")
    assert below and "hashpartitioning(survey" not in above and "hashpartitioning(species" not in above
