"""Registered queries against their SQL twins on the smallest tables.

By default one query in each family; set PANELFORGE_ALL=1 for every query with a twin.
"""

import os

import pytest

from panelforge.plans import catalog
from tests.compare import duck, mismatch

SF = "/root/testdata/sf0.001"
ALL = catalog.load()
SOME = (
    "drift_top_features w3_rolling_moments w4_w6_typed_lag_diff w19_rank_vs_train_reference f3_quantile_buckets f7_extreme_flags j2_layout_stats_type_fallback "
    "e1_winsorise e4_two_pass_impute a7_type_inference a15_outcome_class_means t4_recall_at_top_k u4_fold_overlap_jaccard x2_temporal_leak_check "
    "d3_knee_threshold d5_wasserstein d12_tp_fp_separation r1_build_metrics r9_pr_summary r18_auc_per_scenario m18_policy_benchmark "
    "m27_attack_zone_value g1_adaptive_nan_threshold g13_validation_gates e8_self_excluded_neighbours e13_layout_neighbours s8_build_submission s13_nested_registry_json s15_case_log_explode"
).split()
NAMES = [n for n, q in ALL.items() if q.sql] if os.environ.get("PANELFORGE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, con, name):
    q = ALL[name]
    problem = mismatch(q.build(spark, SF), q.sql, con)
    assert problem is None, problem


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
