"""What a reviewer sees of the items of the queue, against rows written by hand."""

import pytest
from pyspark.sql import functions as F

from answerlake.operators import review
from answerlake.operators import rules as rl
from answerlake.plans import catalog
from tests.oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    """{(scan_id, name): row} of three sheets; sheet 3 has no readings and nothing waits on q3 of sheet 1."""
    read = [
        (1, "q1", "A", 0.5, ["low_confidence"], True), (1, "q2", "", 1.0, ["empty"], False), (1, "q3", "AB", 0.9, ["multi_marked"], True),
        (2, "q1", "B", 0.9, [], False), (2, "q2", "B", 0.4, ["low_confidence"], True), (2, "q3", "", 1.0, ["empty"], False),
    ]
    readings = spark.createDataFrame(read, "scan_id long, name string, value string, confidence double, flags array<string>, needs_review boolean")
    # places against the order of the rows and of the letters
    bubbles = spark.createDataFrame(
        [(s, q, place, opt, int(opt in value), place / 10) for s, q, value, *_ in read for place, opt in ((3, "A"), (1, "C"), (2, "B"))],
        "scan_id long, name string, opt_pos int, opt string, marked int, fill_ratio double",
    )
    rules = rl.Rules(
        [rl.Validation("q1", allowed=["B"]), rl.Validation("roll", length=1)],
        [rl.Check("pick", ["q1", "q2"], on_conflict="error"), rl.Check("none", ["q3"], normalize=("^[X]", 0))],
        {"roll": ["q1", "q2", "q3"]},
    )
    run = rl.Run(rl.sheet_maps(readings), rules, ["q1", "q2", "q3"])
    state = lambda value, flags, waits: F.when(value == "", "empty").when(waits, "issue").otherwise("ok")
    rules = run.details({"roll": run.column_states("roll", state)})
    queue = [(1, "q1", "field"), (1, "roll", "custom_label"), (1, "none", "check"), (1, "pick", "check"), (2, "q2", "zone"), (2, "pick", "check"), (3, "q1", "field"), (None, "q1", "field")]
    pending = spark.createDataFrame(queue, "scan_id long, name string, kind string")
    details = review.review_details(pending, readings, bubbles, rules)
    rows = details.collect()
    waiting = review.rule_details(rules).collect()
    assert {(r["scan_id"], r["name"]) for r in waiting} == {(1, "none"), (1, "pick"), (1, "roll"), (2, "none"), (2, "roll")}
    assert all(r in rows for r in waiting if r["scan_id"] == 1)
    assert len(rows) == len(queue)
    return {(r["scan_id"], r["name"]): r.asDict(recursive=True) for r in rows}


def test_a_reading_has_its_options_with_marks_in_template_order(found):
    row = found[1, "q1"]
    assert (row["kind"], row["value"], row["confidence"], row["flags"]) == ("field", "A", 0.5, ["low_confidence"])
    assert [(o["opt"], o["marked"], o["fill_ratio"]) for o in row["options"]] == [("C", False, 0.1), ("B", False, 0.2), ("A", True, 0.3)]
    assert row["reasons"] == ["not an allowed value"] and row["candidates"] is None and row["group"] is None and row["check_value"] is None
    assert found[2, "q2"]["reasons"] is None and [o["opt"] for o in found[2, "q2"]["options"] if o["marked"]] == ["B"]


def test_a_check_has_its_value_flags_and_the_sources_with_a_value(found):
    none, pick = found[1, "none"], found[2, "pick"]
    assert (none["check_value"], none["value"], none["flags"]) == ("", None, ["all_sources_missing"])
    assert none["candidates"] == [{"source": "q3", "value": "AB"}] and none["options"] is None
    assert pick["check_value"] == "B" and pick["candidates"] == [{"source": "q1", "value": "B"}, {"source": "q2", "value": "B"}]


def test_a_label_has_its_reasons_and_the_states_of_its_columns(found):
    row = found[1, "roll"]
    assert (row["value"], row["flags"], row["reasons"]) == ("AAB", ["validation_failed"], ["length 3 not in 1"])
    assert [(g["column"], g["state"]) for g in row["group"]] == [("q1", "issue"), ("q2", "empty"), ("q3", "issue")]
    assert row["candidates"] is None and row["check_value"] is None


def test_items_without_readings_stay(found):
    for key in ((3, "q1"), (None, "q1")):
        assert all(v is None for k, v in found[key].items() if k not in ("scan_id", "name", "kind"))


def test_the_query_shows_reasons_candidates_and_groups(spark):
    names, rows = spark_rows(catalog.queries()["jn_review_detail"](spark, SF))
    assert (names, rows) == sql_rows(connect(SF), catalog.oracle_sql()["jn_review_detail"])
    for column in ("bubbles", "reasons", "candidates", "group_states"):
        assert any(r[names.index(column)] for r in rows)
