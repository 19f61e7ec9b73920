"""Label files, CSV tables, sheets found by a text and answer-key checks on small odd cases."""

import pytest
from pyspark.sql.types import StructType

from answerlake.operators import compare, mlprep, scoring
from answerlake.sinks import writers
from answerlake.sources import labels


def test_label_file_expands_answers_and_refuses_clashes(spark):
    images = spark.createDataFrame([("a/x1.JPG", 0), ("a/x2.jpg", 1), ("a/x3.jpg", 2)], "image string, place int")
    long = ["ABCD*ABCD ABCDA", "BBBB BBBBBBBBBB", "CC*C CCCCCCCCCC"]
    rows = [(i, f"X{i + 1}.png", " ok ", f"{7 * i}", text) for i, text in enumerate(long)]
    rows.append((3, "other.jpg", "no", "012", "D" * 15))
    table = spark.createDataFrame(rows, "place int, `File Name` string, note string, roll string, Given string")
    found = {r["image"]: r["label"].asDict() for r in labels.read_labels(table, images).collect()}
    one = found["a/x1.JPG"]
    assert set(one) == {"note", "roll", *(f"q{i}" for i in range(1, 16))}
    assert (one["note"], one["roll"], one["q1"], one["q5"], one["q10"], one["q15"]) == ("ok", "000", "A", "*", "", "A")
    assert found["a/x3.jpg"]["roll"] == "014"
    # a prefix given by hand, and two answer columns with their own
    forced = labels.read_labels(table, images, {"given": "set"}).first()["label"]
    assert "set15" in forced and "q1" not in forced
    two = table.selectExpr("*", "Given AS Second").drop("File Name").where("place < 3")
    assert {"given_q1", "second_q15"} <= set(labels.read_labels(two, images).first()["label"].asDict())
    with pytest.raises(ValueError, match="would make q3"):
        labels.read_labels(table.withColumnRenamed("note", "q3"), images)
    with pytest.raises(Exception, match="equal numbers"):
        labels.read_labels(table.drop("File Name"), images).collect()


def test_csv_tables_come_back(spark, tmp_path):
    schema = StructType.fromDDL("job int, seq int, text string, note string")
    rows = [(j, s, t, n) for j in (1, 2) for s, (t, n) in enumerate([("", None), ('say "hi", x', ""), ("a\\b", "\\N"), (" pad ", "é")])]
    df = spark.createDataFrame(rows, schema)
    writers.write_job_tables(df, str(tmp_path / "jobs"), "job", ["seq"])
    assert sorted(map(tuple, writers.read_table(spark, str(tmp_path / "jobs"), schema).collect()), key=repr) == sorted(rows, key=repr)
    heads = [p.read_text().splitlines()[0] for p in (tmp_path / "jobs").rglob("*.csv")]
    assert heads and set(heads) == {"seq,text,note"}
    writers.write_table(df, str(tmp_path / "flat"))
    assert sorted(map(tuple, writers.read_table(spark, str(tmp_path / "flat"), schema).collect()), key=repr) == sorted(rows, key=repr)


def test_find_sheet_by_place_key_and_name(spark):
    sheets = spark.createDataFrame(
        [(1, "7", "S0007.jpg", "clean"), (2, "8", "S0008.jpg", "pending"), (3, "9", "s0009.jpg", "partial"), (4, "10", "T1.jpg", "done"), (5, "", None, "not_read")],
        "scan_id long, key string, file_name string, state string",
    )

    def find(text):
        return tuple(compare.find_sheet(sheets, text).first())

    assert find("#2") == (3, "s0009.jpg", "partial", None) and find(" # 3 ") == (4, "T1.jpg", "done", None)
    assert find("#0")[3] == find("#4")[3] == "there are 3 sheets to review"
    assert find("8") == find("s0008.JPG") == (2, "S0008.jpg", "pending", None)
    assert find("7") == (None, None, None, "S0007.jpg has nothing to review: clean")
    assert find("jpg")[3] == "3 sheets match" and find("zzz")[3] == "no sheet matches"


def test_key_problems(spark):
    key = spark.createDataFrame([("q1", "A", {"A": 1.0}), ("q1", "B", {"B": 1.0}), ("q2", "A", {"AB": 1.0}), ("q3", "A", {"C": 1.0})], "question string, section string, answers map<string,double>")
    asked = spark.createDataFrame([("q1",), ("q2",), ("q4",)], "question string")
    sections = spark.createDataFrame([("A", "q1"), ("B", "q2"), ("C", "q2"), ("C", "q9")], "section string, question string")
    found = {tuple(r) for r in scoring.key_problems(asked, key, sections, True).collect()}
    assert found == {
        ("q1", "in several sections"), ("q2", "needs a multi-mark"), ("q4", "no answer"), ("q3", "not a question"),
        ("q9", "in a section but not a question"), ("q2", "in the schemes of several sections"),
    }


def test_split_falls_back_to_labels(spark):
    many = spark.createDataFrame([(i, f"s{i % 8}", "ab"[i % 2]) for i in range(80)], "id int, source string, label string")
    parts = {(r["source"], r["part"]) for r in mlprep.split(many, "source", "id", "label").collect()}
    assert len(parts) == 8 and sum(p == "validation" for _, p in parts) == 1
    few = many.withColumn("source", many["source"].substr(1, 1))
    rows = mlprep.split(few, "source", "id", "label").collect()
    assert len(rows) == 80 and {r["label"] for r in rows if r["part"] == "validation"} == {"a", "b"}
    assert sum(r["part"] == "validation" for r in rows) == 12


def test_split_reads_its_rows_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(80).selectExpr("id", "concat('s', id % 8) AS source", "'a' AS label").mapInArrow(counted, "id long, source string, label string")
    assert len(mlprep.split(rows, "source", "id", "label").collect()) == 80
    assert 0 < seen.value <= 160


def test_confusion_matrix_has_every_cell(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (2, 0)], "target int, predicted int")
    found = {(r["target"], r["predicted"]): r["n"] for r in mlprep.confusion_matrix(rows).collect()}
    assert found == {(t, p): {(0, 0): 1, (0, 1): 2, (2, 0): 1}.get((t, p), 0) for t in (0, 1, 2) for p in (0, 1, 2)}


def test_repeated_truth_keys_keep_one_row_per_sheet(spark):
    scans = spark.createDataFrame([(1, "b/S1.jpg"), (2, "b/S2.jpg"), (3, "b/S3.jpg"), (4, "b/S4.jpg")], "scan_id long, file_name string")
    rows = [("b/S1.jpg", 1, "old"), ("b/S1.jpg", 2, "new"), ("S2.jpg", 3, "x"), ("S2.jpg", 4, None), ("q/S3.tif", 5, "first"), ("S3.png", 6, "second")]
    keys = spark.createDataFrame(rows, "key string, pos int, value string")
    found = {r["scan_id"]: (r["value"], r["matched"]) for r in labels.lookup_truth(scans, keys).collect()}
    assert found == {1: ("new", "id"), 2: (None, "name"), 3: ("first", "stem"), 4: (None, None)}
