"""Queries against DuckDB at the smallest scale. ANSWERLAKE_ALL=1 runs every registered query."""

import os

import pytest

from answerlake.plans import catalog
from tests.oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
CHOSEN = """ag_score sc_bonus wn_running_score fn_normalize fn_key_of fn_cast fn_split_ordered fn_join_group
fn_differs flt_views flt_result_where jn_dup_job jn_duplicates_of wn_neighbours wn_even_split ag_facets
ag_changed_sheets ag_assignment_summary ag_accuracy st_upsert dc_local_threshold dc_double_marks
dc_field_summary dc_reader_vote dc_fill_threshold dc_measure ag_page_median rl_validate rl_chain rl_absorb
rl_review_list jn_external cp_fields cp_decide cp_reconciled cp_audit_export wn_claim_next jn_grid_column
ag_metrics_values ag_metrics_sheets ag_metrics_bubbles ag_latency ag_label_corr ag_composite_split
ml_split ml_temperature prj_column_plan rv_apply rv_return src_jsonl src_result_tree src_delimited
src_label_file snk_csv snk_sql_upsert sm_counts sm_activity_windows sm_settle sm_watch rv_undo sc_regrade sc_key_checks
jn_find_sheet snk_job_csv snk_flat_csv ag_confusion""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("ANSWERLAKE_ALL") else CHOSEN)
def test_same_rows(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    expected_columns, expected = sql_rows(con, SQL[name])
    assert columns == expected_columns
    assert rows == expected


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 250
