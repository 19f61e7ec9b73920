"""What the physical plans must and must not contain."""

import pytest

from answerlake.plans import catalog
from answerlake.plans.derived import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ag_score", "jn_dup_job", "ag_facets", "ag_metrics_by_kind", "rl_chain", "cp_fields", "flt_result_where", "ag_missing_columns"])
def test_no_nested_loops_or_row_functions(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(catalog.queries()["flt_equal"](spark, SF))
    assert "PushedFilters: [" in text and "EqualTo(o_orderstatus,F)" in text.replace(" ", "") or "EqualTo(o_orderpriority" in text
    assert "o_totalprice" not in text and "o_orderdate" not in text


def test_first_rows_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.queries()["wn_history_cap"](spark, SF))
    assert "WindowGroupLimit" in plan(catalog.queries()["jn_duplicates_of"](spark, SF))


def test_answer_key_is_broadcast_by_its_known_size(spark):
    assert "BroadcastHashJoin" in plan(catalog.queries()["ag_score"](spark, SF))


def test_rule_chain_has_one_shuffle_after_the_readings(spark):
    cells, chain = plan(Tables(spark, SF).cells), plan(catalog.queries()["rl_chain"](spark, SF))
    assert chain.count("Exchange") == cells.count("Exchange") + 1


@pytest.mark.parametrize("name,scans,shuffles", [("dc_field_summary", 1, 2), ("dc_sheet_multi", 1, 2), ("dc_mark_adaptive", 1, 2), ("dc_double_marks", 1, 2), ("dc_field_value", 1, 2), ("dc_fast_accept", 2, 3)])
def test_sheet_frame_is_dealt_once(spark, name, scans, shuffles):
    """One shuffle makes the cells of the table, one deals them by sheet; the sheets' own table is a second scan."""
    frame = catalog.queries()[name](spark, SF)
    # read before adaptive execution takes exchanges out
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == scans and text.count("Exchange hashpartitioning") <= shuffles


def test_thresholds_are_not_worked_out_again_in_a_filter(spark):
    """One row per bubble adds no filter in which a field's threshold is computed for every bubble."""
    plan = catalog.queries()["dc_mark_adaptive"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter")]
    assert not [line for line in filters if "transform(" in line]


def test_pages_are_painted_after_the_templates_are_joined(spark):
    """The join moves a sheet's bubbles and not its pixels, and pages are painted many at a time."""
    lines = catalog.queries()["ag_page_median"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    painted = [i for i, line in enumerate(lines) if "MapInArrow" in line]
    joined = [i for i, line in enumerate(lines) if "Join " in line]
    assert painted and joined and max(painted) < min(joined)


@pytest.mark.parametrize("name", ["so_best_read", "dc_reader_vote"])
def test_reads_of_a_zone_are_not_taken_apart_and_sorted(spark, name):
    """The candidates of a zone are compared where they are: no shuffle or sort after the cells of the table."""
    text = plan(catalog.queries()[name](spark, SF))
    assert text.count("Exchange") == plan(Tables(spark, SF).cells).count("Exchange")
    assert "Sort" not in text and "ObjectHashAggregate" not in text


def test_grid_is_decoded_without_sorting_its_bubbles(spark):
    """A field is one character before its sheet is gathered."""
    text = plan(catalog.queries()["dc_decode_grid"](spark, SF))
    assert "Sort" not in text and "Generate" not in text


def test_bubbles_of_a_field_are_the_rows_of_bubbles(spark):
    t = Tables(spark, SF)
    rows = t.field_bubbles.selectExpr("scan_id", "pos", "name", "inline(bubbles)")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, t.bubbles.collect()))


@pytest.mark.parametrize("name", ["dc_local_threshold", "dc_double_marks", "dc_field_summary", "dc_fast_accept"])
def test_only_sheets_are_gathered(spark, name):
    """A field's bubbles come as one array, so that bubbles are not gathered row by row before their sheet is."""
    assert plan(catalog.queries()[name](spark, SF)).count("ObjectHashAggregate") == 2


def test_options_of_the_queue_are_not_gathered_from_bubbles(spark):
    """An item's options are those of its field's array: no semi join of the bubbles, no list made of them."""
    text = plan(catalog.queries()["jn_review_detail"](spark, SF))
    assert "LeftSemi" not in text and "collect_list(struct(opt_pos" not in text
