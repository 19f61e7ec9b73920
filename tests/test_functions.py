import random

import pytest
from pyspark.sql import functions as F

from answerlake import config
from answerlake.functions import text as tx
from answerlake.functions import values as vl
from answerlake.sources import labels, lines


def column(spark, values, expr, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r["out"] for r in rows.select("i", expr.alias("out")).orderBy("i").collect()]


def test_natural_order(spark):
    names = ["q10", "q2", "Sheet10", "sheet9", "q02x", "q1"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    out = [r["name"] for r in rows.orderBy(tx.natural_key(F.col("name"))).collect()]
    assert out == ["q1", "q2", "q02x", "q10", "sheet9", "Sheet10"]


def test_keys(spark):
    values = ["S000123.jpg", "000", "", "x", " 0042 ", "a/b/S7_p2.png"]
    assert column(spark, values, tx.key_of(F.col("v"), "digits", True)) == ["123", "0", "", "", "42", "7"]
    assert column(spark, ["Scan_1.JPG", "Ann", "C:\\in\\S1.tif"], tx.key_of(F.col("v"), "text")) == ["scan_1", "ann", "s1"]
    assert column(spark, ["Q001", "q-1", "Q1", "Total", "q00"], tx.name_key(F.col("v"))) == ["q1", "q1", "q1", "total", "q0"]
    stems = ["a/b.c.jpg", ".hidden", "plain", "dir/x_p3.png", "dir/x_p3.jpg"]
    assert column(spark, stems, tx.stem(F.col("v"))) == ["b.c", ".hidden", "plain", "x_p3", "x_p3"]
    assert column(spark, stems, tx.file_key(F.col("v"))) == ["b.c", ".hidden", "plain", "x", "x_p3"]


def test_ranges(spark):
    out = column(spark, ["q1..3", "q9..q10", "q5..2", "q1..r3", "name"], tx.range_names(F.col("v")))
    assert out == [["q1", "q2", "q3"], ["q9", "q10"], None, None, ["name"]]
    assert config.expand_fields(["q1..3", "x"]) == ["q1", "q2", "q3", "x"]
    for wrong in (["q3..1"], ["q1..3", "q2"], ["a.b"]):
        with pytest.raises(ValueError):
            config.expand_fields(wrong)
    assert config.names_of("q2..q4") == config.names_of("q2...4") == ["q2", "q3", "q4"]
    for wrong in ("q4..q2", "q1..r3", "q1..x"):
        with pytest.raises(ValueError):
            config.names_of(wrong)
    assert lines.parse_splits("A 1 q1..q2 width=2 # two\n\nR q3 sep=comma") == [
        lines.Split("A 1", ["q1", "q2"], None, 2),
        lines.Split("R", ["q3"], ",", 1),
    ]
    for wrong in ("ANSWERS", "A q1..q2 width=x", "A q1..q2 width=0"):
        with pytest.raises(ValueError):
            lines.parse_splits(wrong)
    for wrong in ("", "SEQ 0 4", "SEQ 1"):
        with pytest.raises(ValueError):
            lines.parse_fixed_spec(wrong)
    assert lines.unique_names(["a", "", "a", " b "]) == ["a", "C2", "a_2", "b"]
    assert lines.parse_fixed_spec("SEQ 1 6\nq1..q3 7 2 # packed") == [("SEQ", 1, 6), ("q1", 7, 2), ("q2", 9, 2), ("q3", 11, 2)]


def spell(value, options):
    """Ordered subset of options that spells the value, found by trying the earliest first."""

    def solve(start, rest):
        if not rest:
            return []
        for i in range(start, len(options)):
            if options[i] and rest.startswith(options[i]):
                tail = solve(i + 1, rest[len(options[i]) :])
                if tail is not None:
                    return [i, *tail]
        return None

    return solve(0, value.strip())


def test_split_ordered_against_backtracking(spark):
    rng = random.Random(5)
    options = ["1", "10", "11", "101", "0"]
    values = ["".join(rng.choice("01") for _ in range(rng.randint(0, 7))) for _ in range(300)] + ["10a", " 1 "]
    out = column(spark, values, vl.split_ordered(F.col("v"), options))
    assert out == [spell(v, options) for v in values]


def test_split_value_is_greedy(spark):
    values = ["AC", "", "1011", "B1", "10"]
    out = column(spark, values, vl.split_value(F.col("v"), ["A", "B", "C", "1", "10", "11"]))
    assert out == [["A", "C"], [], ["10", "11"], ["B", "1"], ["10"]]
    assert column(spark, ["AX"], vl.split_value(F.col("v"), ["A"])) == [None]


def test_toggle_and_distribute(spark):
    out = column(spark, ["AC", "B", "", "#"], vl.toggled(F.col("v"), F.lit("B"), ["A", "B", "C"], "#"))
    assert out == ["ABC", "#", "B", "B"]
    columns = [["1", "2"], ["1", "2"], ["A", "AB"]]
    out = column(spark, ["12AB", "1 A", "12", "121", "1"], vl.distribute(F.col("v"), columns, "-"))
    assert out == [["1", "2", "AB"], ["1", "-", "A"], ["1", "2", "-"], None, ["1", "-", "-"]]


def test_compare_rules(spark):
    rules = vl.CompareRules()
    exact = vl.CompareRules(multi="exact")
    theirs = vl.external_value(F.col("v"), rules, F.lit(True))
    out = column(spark, ["*", " ", "-", "a", "b a", None], theirs)
    assert [(r["kind"], r["text"]) for r in out] == [
        ("multi", ""), ("blank", ""), ("blank", ""), ("value", "A"), ("multi", "AB"), ("blank", ""),
    ]
    ours = vl.our_value(F.lit("AC"), F.lit(None), F.lit(True), F.lit(False), rules)
    assert column(spark, ["ab", "*", "ca", "A"], vl.differs(theirs, ours, exact)) == [True, False, False, True]
    assert vl.parse_bands("1: q1..q3; 2 = q4") == {"1": ["q1", "q2", "q3"], "2": ["q4"]}
    with pytest.raises(ValueError):
        vl.parse_bands("1: q3..q1")


def test_casts(spark):
    values = ["12", "012", "1.50", "abc", "", "31122001", "Y"]
    whole = column(spark, values, vl.cast_value(F.col("v"), "int"))
    assert [r["value"] for r in whole] == [12, None, None, None, None, 31122001, None]
    assert whole[1]["reason"] == "leading zero" and whole[4]["reason"] is None
    day = column(spark, values, vl.cast_value(F.col("v"), "date", format="%d%m%Y"))
    assert str(day[5]["value"]) == "2001-12-31" and day[3]["reason"] == "not a date"
    comma = column(spark, ["1.234,5"], vl.text_of(vl.cast_value(F.col("v"), "decimal", decimal_comma=True)["value"], "decimal"))
    assert comma == ["1234.5"]
    lossy = column(spark, ["012"], vl.cast_value(F.col("v"), "int", lossy=True))
    assert lossy[0]["value"] == 12


def test_labels_and_remap(spark):
    out = column(spark, ["a", "A", "<blank>", "+", "a_1"], tx.label_folder(F.col("v")))
    assert out == ["a", "A_upper", "_blank_", "u002b", "a_1"]
    rules = [("C:\\Scans", "/data"), ("/old", "D:\\new")]
    paths = ["c:\\scans\\a\\b.jpg", "/old/x/y.png", "/older/z", "C:\\Scans"]
    assert column(spark, paths, tx.remap_path(F.col("v"), rules)) == ["/data/a/b.jpg", "D:\\new\\x\\y.png", "/older/z", "/data"]
    weights = column(spark, ["A:1, AB = 3/2"], labels.parse_weights(F.col("v")))
    assert [(w["answer"], w["marks"]) for w in weights[0]] == [("A", 1.0), ("AB", 1.5)]


def test_deep_merge():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert config.deep_merge(base, {"a": {"b": 9}, "d": None}) == {"a": {"b": 9, "c": 2}}
