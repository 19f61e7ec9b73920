import pytest
from pyspark.sql import functions as F

from answerlake.operators import rules as rl


def reasons(spark, rule, value, empties=None):
    row = spark.range(1)
    marks = None if empties is None else F.array(*[F.lit(e) for e in empties])
    return row.select(rl.failures(rule, F.lit(value), marks).alias("r")).first()["r"]


def test_reasons(spark):
    rule = rl.Validation("roll", length=(3, 4), allow_gaps=False, allow_empty_ends=False, leading_zeros="forbid", pattern=r"\d+", range=(100, None))
    assert reasons(spark, rule, "1234") == []
    assert reasons(spark, rule, "") == []
    assert reasons(spark, rule, "012") == ["leading zero", "012 outside [100, ]"]
    assert reasons(spark, rule, "12") == ["length 2 not in [3, 4]", "12 outside [100, ]"]
    assert reasons(spark, rule, "1 3") == ["gap at position 2", r"does not match '\\d+'", "not a number"]
    assert reasons(spark, rule, "13", [True, False, True, False, True, True]) == [
        "length 2 not in [3, 4]",
        "gap at position 3",
        "1 empty leading position(s)",
        "2 empty trailing position(s)",
        "13 outside [100, ]",
    ]
    assert reasons(spark, rl.Validation("x", required=True), " ") == ["empty"]
    assert reasons(spark, rl.Validation("x", allowed=["A"]), "B") == ["not an allowed value"]


def readings(spark, *rows):
    return spark.createDataFrame(
        [(1, n, v, f, r) for n, v, f, r in rows],
        "scan_id int, name string, value string, flags array<string>, needs_review boolean",
    )


def run(spark, rules, *rows):
    df = readings(spark, *rows)
    return rl.Run(rl.sheet_maps(df), rules, [r[0] for r in rows])


def test_conflict_and_fallback(spark):
    rows = [("a", "12", [], False), ("b", "13", [], True), ("c", "", ["empty"], False)]
    out = run(spark, rl.Rules(checks=[rl.Check("x", ["a", "b"], on_conflict="error")]), *rows).checks().first()
    assert out["value"] == "" and out["flags"] == ["cross_check_failed"] and out["needs_review"]
    out = run(spark, rl.Rules(checks=[rl.Check("x", ["c", "a"])]), *rows).checks().first()
    assert (out["value"], out["chosen_source"], out["flags"], out["needs_review"]) == ("12", "a", ["fallback_used"], False)
    out = run(spark, rl.Rules(checks=[rl.Check("x", ["b", "a"], skip_flagged=True)]), *rows).checks().first()
    assert out["value"] == "12"
    out = run(spark, rl.Rules(checks=[rl.Check("x", ["c"])]), *rows).checks().first()
    assert out["flags"] == ["all_sources_missing"] and out["needs_review"]


def test_chain_validates_and_absorbs(spark):
    rows = [("a", "7", [], True), ("b", "7", [], False), ("c", "9", [], False)]
    rules = rl.Rules(
        [rl.Validation("second", allowed=["9"], on_fail="both")],
        [rl.Check("second", ["first", "c"], review_on_conflict=False), rl.Check("first", ["a", "b"])],
    )
    result = run(spark, rules, *rows)
    checks = {r["name"]: r for r in result.checks().collect()}
    assert checks["first"]["value"] == "7"
    assert checks["second"]["value"] == "" and "validation_failed" in checks["second"]["flags"]
    assert [(r["name"], r["resolved_by"]) for r in result.absorbed().collect()] == [("a", "first")]
    assert [r["name"] for r in result.review().collect()] == ["second"]


def test_blanked_column_shows_in_its_label(spark):
    rows = [("a", "1", [], False), ("b", "x", [], False)]
    rules = rl.Rules([rl.Validation("b", pattern=r"\d", on_fail="blank"), rl.Validation("ab", length=2)], groups={"ab": ["a", "b"]})
    out = {r["name"]: r for r in run(spark, rules, *rows).validations().collect()}
    assert out["b"]["ok"] is False and out["ab"]["value"] == "1" and out["ab"]["reasons"] == ["length 1 not in 2"]


def test_wrong_rules_are_refused():
    known = ["a", "b"]
    for checks in (
        [rl.Check("x", ["y"]), rl.Check("y", ["x"])],
        [rl.Check("x", ["nope"])],
        [rl.Check("x", ["a"]), rl.Check("x", ["b"])],
        [rl.Check("x", ["a"], output="b")],
    ):
        with pytest.raises(ValueError):
            rl.Rules(checks=checks).ordered(known)
    for wrong in (dict(sources=[]), dict(sources=["a", "a"]), dict(sources=["a"], priority=["b"])):
        with pytest.raises(ValueError):
            rl.Check("x", **wrong)
