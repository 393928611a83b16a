"""Registered queries against their SQL. One query of each family by default, all with TEST_ALL_QUERIES=1."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tests.oracle_check import compare, connect

SOME = ("io2_null_tokens p3_noise_predicate j1_dictionary_lookup a4_adjusted_skewness a5_quantiles_iqr_mad a7_value_frequency "
        "a12_pearson_matrix a15_duplicate_summary a16_histogram_by_group a20_hierarchy q1_noise_report q7_consistency_report q9_safe_zone_validation "
        "q10_outlier_method q15_risk_records q17_data_summary q20_issue_composition c2_canonical_casing c3_schema_types "
        "c7_noise_to_mode c11_impute c13_outlier_preview c20_outlier_dispatcher f1_log_candidates f8_encoding_plan f10_label_encoding "
        "f11_one_hot f14_robust_scaling e1_cramers_v_two_by_two e4_association_ranking e9_top_feature_breakdown e10_rate_cross_tab "
        "e17_prevalence_cross_tab e21_gender_gap e22_segments_by_occupation e25_archetype n1_insight_record").split()
NAMES = [q for q in queries() if q in oracle_sql()] if os.environ.get("TEST_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    diff, _ = compare(spark, duck, name, SF, queries(), oracle_sql())
    assert diff is None, diff


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 19
