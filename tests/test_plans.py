"""Physical-plan guards: no cartesian products, and every nested-loop join
attaches a provably one-row side."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from plan_audit import SKIP, _nested_loop_joins  # noqa: E402

KEYS = sorted(k for k in entry.queries() if k not in SKIP and k not in {
    "train_price_model", "refit_median_trees", "score_months", "feature_contributions", "lda_global",
    "lda_per_listing", "topic_words", "density_clusters", "fit_sample_assign_all", "merge_topics", "mmr_words"})


@pytest.mark.parametrize("key", KEYS)
def test_plan_has_no_unbounded_nested_loop(spark, sf, key):
    plan = entry.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    _, unbounded = _nested_loop_joins(plan)
    assert unbounded == 0
