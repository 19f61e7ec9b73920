import json

import pytest

from answerlake.sources import labels, lines, results


def test_delimited_bytes(spark, tmp_path):
    path = tmp_path / "file.csv"
    path.write_bytes("﻿note\r\nSEQ|NAME|Q|Q\r\n1|Zoé| |x\r\n\r\n2|Bo\r\n3|Ann|a|b\x1a".encode())
    df = lines.read_delimited(spark, str(path), header_row=2).orderBy("row_no")
    assert df.columns == ["file", "row_no", "SEQ", "NAME", "Q", "Q_2"]
    assert [tuple(r)[1:] for r in df.collect()] == [
        (1, "1", "Zoé", " ", "x"),
        (3, "2", "Bo", "", ""),
        (4, "3", "Ann", "a", "b"),
    ]


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('"SEQ";"Q;1";Q2\n1;"a;b;c";x\n2;"say ""hi""";\n3;"";"y"\n4;z\n')
    df = lines.read_delimited(spark, str(path)).orderBy("row_no")
    assert df.columns == ["file", "row_no", "SEQ", "Q;1", "Q2"]
    assert [tuple(r)[2:] for r in df.collect()] == [("1", "a;b;c", "x"), ("2", 'say "hi"', ""), ("3", "", "y"), ("4", "z", "")]
    with pytest.raises(Exception, match="more than 3 cells"):
        path.write_text("A;B;C\n1;2;3;4\n")
        lines.read_delimited(spark, str(path), width=3, encoding="utf-8").collect()
    with pytest.raises(ValueError):
        lines.read_delimited(spark, str(path), header_row=9)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('SEQ,"two\nlines",C\n1,"a\nb,c",x\n2,d\n')
    df = lines.read_delimited(spark, str(path), breaks=True).orderBy("row_no")
    assert df.columns == ["file", "row_no", "SEQ", "two\nlines", "C"]
    assert [tuple(r)[1:] for r in df.collect()] == [(1, "1", "a\nb,c", "x"), (2, "2", "d", "")]


def test_split_layout(spark, tmp_path):
    path = tmp_path / "packed.csv"
    path.write_text("note\n\nSEQ,RESP,A\n9,B|C||D,xxyy\n")
    df = lines.read_delimited(spark, str(path), header_row=3, splits="RESP q1..q4 sep=|\nA a1..a3 width=2")
    assert tuple(df.first())[2:] == ("9", "B", "C", "", "D", "xx", "yy", "  ")
    with pytest.raises(ValueError):
        lines.read_delimited(spark, str(path), header_row=3, splits="NOPE q1..q4")


def test_labels_by_place(spark):
    images = spark.createDataFrame([("in/a.jpg", 1), ("in/b.jpg", 2)], "image string, place int")
    people = spark.createDataFrame([(1, "Ann", "x"), (2, "Bo", "y")], "place int, Name string, label string")
    named = spark.createDataFrame([(1, "b.png", "x"), (2, "a.jpg", "y")], "place int, Name string, label string")
    read = lambda rows, column="Name": {r["place"]: r["label"]["label"] for r in labels.labelled(rows, images, column).collect()}
    assert read(people) == {1: "x", 2: "y"} == read(people, None)
    assert read(named) == {1: "y", 2: "x"}
    with pytest.raises(Exception, match="by place"):
        read(people.where("place = 1"))


def test_windows_encoding(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_bytes("K;V\n1;café\n".encode("cp1252"))
    assert lines.read_delimited(spark, str(path)).select("V").first()[0] == "café"


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.read_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r["value"] == f"line {r['line_no']}" for r in rows)


def test_documents_and_listing(spark, tmp_path):
    deep = tmp_path / "ab" / "cd"
    deep.mkdir(parents=True)
    reading = {"value": "A", "confidence": 0.5, "flags": [], "needs_review": False}
    document = {"scan_id": 7, "status": "ok", "fields": {"q1": reading, "q2": reading}, "review": []}
    (deep / "result.json").write_text(json.dumps(document, indent=1))
    (deep / "empty.jpg").write_text("")
    (deep / "a.jpg").write_text("x")
    (deep / "b.jpg.part").write_text("x")
    read, review = results.shred(results.read_result_tree(spark, f"{tmp_path}/ab", multi_line=True).where("scan_id = 7"))
    assert sorted(r["name"] for r in read.collect()) == ["q1", "q2"] and review.count() == 0
    files = results.list_files(spark, str(tmp_path), ["jpg"]).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in files] == ["a.jpg"]


def test_template_is_checked(spark):
    block = {"origin": [0, 0], "fieldLabels": ["q1..2"], "fieldType": "QTYPE_MCQ4", "bubblesGap": 20, "labelsGap": 20}
    page = {"pageDimensions": [100, 100], "bubbleDimensions": [10, 10], "fieldBlocks": {"a": block}}
    rows = labels.template_bubbles(spark, page).collect()
    assert len(rows) == 8 and (rows[5]["name"], rows[5]["opt"], rows[5]["x"], rows[5]["y"]) == ("q2", "B", 20.0, 20.0)
    with pytest.raises(ValueError):
        labels.template_bubbles(spark, {**page, "fieldBlocks": {"a": block, "b": block}})
    with pytest.raises(ValueError):
        labels.template_bubbles(spark, {**page, "pageDimensions": [60, 60]})
