"""Registered queries against their SQL; ``python tests/oracle.py`` runs all of them on a larger table."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "csv_table_pair", "pair_by_key", "pair_by_position", "decimal_comma_source", "split_bundle", "parameter_store",
    "error_report_lines", "list_expansion", "exact_split", "exact_fold_assignment", "mean_imputation",
    "neighbour_imputation", "quartile_filter_inputs_outputs", "local_outliers_parts", "output_scaling",
    "array_output_scaling", "table_profile", "plane_fit", "cubic_surface_prediction", "cross_validated_line",
    "surface_grid_search", "streaming_scores", "metrics_in_both_scales", "residual_histogram", "residual_diagnostics",
)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    ok, what = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, what


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3
