"""Registered queries against their SQL. Set TILLFLOW_ALL=1 to compare every query instead of one per area."""
import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from oracles import catalog as sql_catalog
from tillflow.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ("load_transactions load_demographics complete_profiles export_transactions export_report demographics_report eligible_customers "
        "tie_report cohort_funnel windows_at_lengths variable_windows draw_customers prepare_splits split_leakage_check filter_counts "
        "psi_numeric ecdf_points mcc_top score_baselines markov_fit sequence_features full_features classification_metrics probability_metrics "
        "class_calibration operating_point subgroup_metrics poisson_bootstrap significance_table pair_table build_samples_full few_shot_examples "
        "chat_messages trace_numbers manifest_diff").split()
QUERIES, SQL = dict(catalog.QUERIES), dict(sql_catalog.ORACLES)
ROWS_ONLY = {"logistic_scores", "bootstrap_intervals", "primary_endpoint_exact"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL] if os.environ.get("TILLFLOW_ALL") else SOME)
def test_query_equals_sql(spark, duck, name):
    status, _, _, detail = compare(spark, duck, name, QUERIES[name], SQL[name], SF)
    assert status == "ok", detail


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["model"] for r in rows} == {"averaging", "last-category", "markov1"} and all(r["n"] > 0 for r in rows)


def test_bootstrap_intervals_hold_the_point(spark):
    for r in QUERIES["bootstrap_intervals"](spark, SF).collect():
        assert r["low"] - 1e-6 <= r["value"] + 0.05 and r["value"] - 0.05 <= r["high"] + 1e-6 and r["low"] <= r["high"]
