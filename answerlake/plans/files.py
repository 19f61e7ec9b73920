"""Source and sink queries: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlake.functions import text as tx
from answerlake.operators import export, mlprep
from answerlake.plans.decoding import pages
from answerlake.plans.derived import OPTIONS, VIEWS, Tables
from answerlake.plans.registry import query
from answerlake.plans.reviewing import GROUP, NAMES, edited, readings
from answerlake.session import hand_over, scratch
from answerlake.sinks import writers
from answerlake.sources import labels, lines, results

# ---- stored results -----------------------------------------------------------------------

VIEWS["f_pages"] = """SELECT scan_id, 'in/' || CAST(FLOOR(scan_id / 3) AS BIGINT) || '.pdf' AS source_path, scan_id % 3 AS page, status, score FROM f_scans"""


def result_pages(t: Tables):
    scan = F.col("scan_id")
    source = F.concat(F.lit("in/"), F.floor(scan / 3).cast("string"), F.lit(".pdf"))
    return t.scans.select(
        "scan_id", source.alias("source_path"), (scan % 3).cast("int").alias("page"), "status", "score"
    )


@query(
    "src_jsonl",
    """SELECT scan_id, source_path, page, status, score FROM f_pages p WHERE scan_id % 97 <> 0 AND source_path NOT IN (SELECT source_path FROM f_pages WHERE status = 'error' AND scan_id % 97 <> 0)""",
)
def _(t):
    text = F.to_json(F.struct("scan_id", "source_path", "page", "status", "score"))
    cut = F.when(F.col("scan_id") % 97 == 0, F.substring(text, 1, 30)).otherwise(text)
    path = scratch(t.spark, "results.jsonl")
    result_pages(t).select(cut.alias("value")).write.text(path)
    return results.read_result_lines(t.spark, path)


def documents(t: Tables):
    reading = F.struct("value", "confidence", "flags", "needs_review")
    item = F.when(F.col("needs_review"), F.struct("kind", "name"))
    nested = readings(t).groupBy("scan_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", reading))).alias("fields"),
        F.array_compact(F.collect_list(item)).alias("review"),
    )
    return t.scans.select("scan_id", "status").join(nested, "scan_id")


@query(
    "src_result_tree",
    """SELECT c.scan_id, s.status, c.name, c.value, c.confidence, c.flag AS flags, CASE WHEN c.needs_review = 1 THEN CASE c.pos WHEN 1 THEN 'zone' ELSE 'field' END END AS kind FROM f_cells c JOIN f_scans s ON s.scan_id = c.scan_id""",
)
def _(t):
    path = scratch(t.spark, "tree")
    writers.write_sharded(documents(t), path)
    read, review = results.shred(results.read_result_tree(t.spark, path))
    rows = read.join(review, ["scan_id", "name"], "left").withColumn("flags", F.array_join("flags", ","))
    return rows.drop("needs_review")


@query("snk_partitioned_scans", "SELECT SUBSTR(MD5(CAST(s.scan_id AS VARCHAR)), 1, 2) AS shard, COUNT(*) AS n FROM f_scans s WHERE scan_id IN (SELECT scan_id FROM f_cells) GROUP BY 1")
def _(t):
    path = scratch(t.spark, "shards")
    writers.write_sharded(documents(t), path)
    rows = t.spark.read.schema("scan_id bigint, shard string").json(path)
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


@query("snk_jsonl", "SELECT scan_id, source_path, page, status, score FROM f_pages")
def _(t):
    path = scratch(t.spark, "out.jsonl")
    writers.write_results(result_pages(t), path)
    return t.spark.read.schema("scan_id bigint, source_path string, page int, status string, score double").json(path)


@query("src_file_listing", "SELECT CAST(job_id AS VARCHAR) AS job, SUM(LENGTH(file_name) + 1) AS bytes FROM f_scans WHERE job_id <> 4 GROUP BY 1")
def _(t):
    # One folder of text files per job; the files of job 4 look unfinished
    path = scratch(t.spark, "inbox")
    folder = F.when(F.col("job_id") == 4, "job=.part").otherwise(F.concat(F.lit("j"), F.col("job_id").cast("string")))
    t.scans.select("file_name", folder.alias("folder")).write.partitionBy("folder").text(path)
    found = results.list_files(t.spark, path, ["txt"])
    job = F.regexp_extract("path", "folder=j([0-9]+)/", 1)
    return found.select(job.alias("job"), "length").where("job <> ''").groupBy("job").agg(F.sum("length").alias("bytes"))


@query("src_page_rasters", "SELECT scan_id, 50 AS width, 85 AS height, CAST(SUM(CASE WHEN mean_intensity < 255 THEN (255 - mean_intensity) * 64 ELSE 0 END) AS BIGINT) AS ink FROM f_bubbles GROUP BY 1")
def _(t):
    import numpy as np
    import pandas as pd

    stored = hand_over(pages(t), "pages")

    def ink(batches):
        for batch in batches:
            total = [int((255 - np.frombuffer(p, np.uint8).astype(np.int64)).sum()) for p in batch["pixels"]]
            yield pd.DataFrame({"scan_id": batch["scan_id"], "width": batch["width"], "height": batch["height"], "ink": total})

    return stored.mapInPandas(ink, "scan_id bigint, width int, height int, ink bigint")


# ---- delimited and fixed-width files ------------------------------------------------------

VIEWS["f_sheet_rows"] = "SELECT scan_id, STRING_AGG(CASE WHEN value = '' THEN ' ' WHEN LENGTH(value) > 1 THEN '*' ELSE value END, '' ORDER BY pos) AS ans, MAX(value) FILTER (pos = 1) AS q1, COUNT(*) AS n FROM f_cells GROUP BY 1"


def sheet_rows(t: Tables):
    char = F.when(F.col("value") == "", " ").when(F.length("value") > 1, "*").otherwise(F.col("value"))
    parts = F.array_sort(F.collect_list(F.struct("pos", char.alias("c"))))["c"]
    return t.cells.groupBy("scan_id").agg(
        F.array_join(parts, "").alias("ans"),
        F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("q1"),
        F.count("*").alias("n"),
    )


def delimited(t: Tables, header: str, *cells) -> str:
    """The sheets as a delimited file: every part starts with a note and the header, rows of even
    sheets lack their last cell, and some lines are blank or carry a DOS end mark."""
    rows = sheet_rows(t)
    even = F.col("scan_id") % 2 == 0
    text = F.when(even, F.concat_ws(";", *cells[:-1])).otherwise(F.concat_ws(";", *cells))
    text = F.when(F.col("scan_id") % 31 == 0, F.concat(text, F.lit("\x1a"))).otherwise(text)
    body = F.when(F.col("scan_id") % 41 == 0, F.array(text, F.lit("  "))).otherwise(F.array(text))
    path = scratch(t.spark, "external.csv")
    first = F.array(F.lit("# second reader"), F.lit(header))
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    top = (F.col("_id") % (2**33)) == 0
    out = F.explode(F.when(top, F.concat(first, body)).otherwise(body)).alias("value")
    numbered.select(out).write.text(path)
    return path


@query(
    "src_delimited",
    "SELECT CAST(scan_id AS VARCHAR) AS \"SEQ\", ans || CASE WHEN scan_id % 5 = 0 THEN ';\"' ELSE '' END AS \"ANSWERS\", CASE WHEN scan_id % 2 = 0 THEN '' ELSE COALESCE(q1, '') END AS \"Q1; first\" FROM f_sheet_rows",
)
def _(t):
    # Every fifth sheet has a separator and a quote inside a quoted cell
    quoted = F.concat(F.lit('"'), F.col("ans"), F.lit(';"""'))
    answers = F.when(F.col("scan_id") % 5 == 0, quoted).otherwise(F.col("ans"))
    path = delimited(t, '"SEQ";ANSWERS;"Q1; first"', F.col("scan_id").cast("string"), answers, F.coalesce("q1", F.lit("")))
    return lines.read_delimited(t.spark, path, header_row=2).select("SEQ", "ANSWERS", "Q1; first")


@query(
    "src_names_unique",
    "SELECT CAST(scan_id AS VARCHAR) AS \"KEY\", CAST(n AS VARCHAR) AS \"Q\", COALESCE(q1, '') AS \"Q_2\", CASE WHEN scan_id % 2 = 0 THEN '' ELSE 'x' END AS \"C4\" FROM f_sheet_rows",
)
def _(t):
    path = delimited(t, "SEQ;Q;Q;", F.col("scan_id").cast("string"), F.col("n").cast("string"), F.coalesce("q1", F.lit("")), F.lit("x"))
    return lines.read_delimited(t.spark, path, ";", header_row=2, names="KEY").select("KEY", "Q", "Q_2", "C4")


@query(
    "src_split_packed",
    "SELECT CAST(scan_id AS VARCHAR) AS \"SEQ\", " + ", ".join(f"CASE WHEN LENGTH(ans) >= {i} THEN SUBSTR(ans, {i}, 1) ELSE ' ' END AS a{i}" for i in range(1, 8)) + " FROM f_sheet_rows",
)
def _(t):
    answers = F.when(F.col("scan_id") % 5 == 0, F.concat(F.lit('"'), F.col("ans"), F.lit('"'))).otherwise(F.col("ans"))
    path = delimited(t, "SEQ;ANSWERS;X", F.col("scan_id").cast("string"), answers, F.lit("x"))
    layout = "ANSWERS a1..a7  # one character each"
    read = lines.read_delimited(t.spark, path, ";", header_row=2, splits=layout, width=3, encoding="utf-8")
    return read.drop("file", "row_no", "X")


@query(
    "src_fixed_width",
    "SELECT RPAD(CAST(scan_id AS VARCHAR), 9, ' ') AS \"SEQ\", " + ", ".join(f"CASE WHEN LENGTH(ans) >= {i} THEN SUBSTR(ans, {i}, 1) ELSE ' ' END AS a{i}" for i in range(1, 8)) + " FROM f_sheet_rows",
)
def _(t):
    path = scratch(t.spark, "fixed.txt")
    sheet_rows(t).select(F.concat(F.rpad(F.col("scan_id").cast("string"), 9, " "), "ans").alias("value")).write.text(path)
    return lines.read_fixed(t.spark, path, "SEQ 1 9\na1..a7 10 1  # one cell per answer").drop("file", "row_no")


@query(
    "src_row_numbers",
    "SELECT COUNT(*) AS lines, SUM(CASE WHEN scan_id % 41 = 0 THEN 1 ELSE 0 END) AS blank FROM f_sheet_rows",
)
def _(t):
    path = delimited(t, "SEQ;N", F.col("scan_id").cast("string"), F.col("n").cast("string"), F.lit(""))
    numbered = lines.read_lines(t.spark, path).where("line_no > 2")
    blank = F.trim("value") == ""
    return numbered.agg(F.count_if(~blank).alias("lines"), F.count_if(blank).alias("blank"))


# ---- truth, labels and keys ---------------------------------------------------------------


@query(
    "src_truth",
    """SELECT 'S' || scan_id || '.jpg' AS file_key, 'q' || i AS "column", CASE WHEN LENGTH(ans) >= i THEN TRIM(SUBSTR(ans, CAST(i AS INTEGER), 1)) ELSE '' END AS expected FROM f_sheet_rows CROSS JOIN RANGE(1, 8) r(i)
       UNION ALL SELECT 'S' || scan_id || '.jpg', 'n', CAST(n AS VARCHAR) FROM f_sheet_rows""",
)
def _(t):
    name = F.concat(F.lit(" S"), F.col("scan_id").cast("string"), F.lit(".jpg"))
    path = scratch(t.spark, "truth.csv")
    table = sheet_rows(t).select(name.alias("File Name"), F.col("n").cast("string").alias("n"), F.col("ans").alias("ANS"))
    table.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    read = t.spark.read.schema("`File Name` string, n string, ANS string").option("header", True).csv(path)
    return labels.truth_long(read, {"ANS": ("q", 7)})


@query(
    "src_answer_string",
    """SELECT scan_id, i AS pos, TRIM(SUBSTR(ans, CAST(i AS INTEGER), 1)) AS value FROM f_sheet_rows CROSS JOIN RANGE(1, 8) r(i) WHERE i <= LENGTH(ans)""",
)
def _(t):
    return sheet_rows(t).select("scan_id", F.inline(labels.answer_chars(F.col("ans"), F.length("ans"))))


VIEWS["f_answers"] = """SELECT c_custkey AS id, STRING_AGG(x, '') AS long, MAX(c_mktsegment) AS seg, MAX(c_name) AS name FROM (SELECT c_custkey, c_mktsegment, c_name, i, SUBSTR('ABCD *', CAST((c_custkey + i * i) % 6 + 1 AS INTEGER), 1) AS x FROM customer CROSS JOIN RANGE(0, 20) r(i) ORDER BY c_custkey, i) y GROUP BY 1"""


def answer_table(t: Tables):
    key = F.col("c_custkey")
    chars = F.transform(
        F.sequence(F.lit(0), F.lit(19)),
        lambda i: F.substring(F.lit("ABCD *"), ((key + i * i) % 6 + 1).cast("int"), F.lit(1)),
    )
    return t.raw("customer").select(
        key.alias("id"), F.array_join(chars, "").alias("long"), F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("name")
    )


@query(
    "src_detect_answer_col",
    r"""SELECT "column", middle, clean, letters, middle >= 15 AND clean AND letters BETWEEN 1 AND 8 AS is_answer FROM (SELECT "column", CAST(quantile_disc(LENGTH(v), 0.5) AS INTEGER) AS middle, BOOL_AND(regexp_full_match(v, '[A-Za-z*\s\-]+')) AS clean FROM
       (SELECT 'long' AS "column", long AS v FROM f_answers UNION ALL SELECT 'seg', seg FROM f_answers UNION ALL SELECT 'name', name FROM f_answers) x GROUP BY 1) a
       JOIN (SELECT "column", COUNT(DISTINCT ch) AS letters FROM (SELECT 'long' AS "column", UNNEST(string_split(UPPER(long), '')) AS ch FROM f_answers UNION ALL SELECT 'seg', UNNEST(string_split(UPPER(seg), '')) FROM f_answers
       UNION ALL SELECT 'name', UNNEST(string_split(UPPER(name), '')) FROM f_answers) y WHERE regexp_full_match(ch, '[A-Z]') GROUP BY 1) b USING ("column")""",
)
def _(t):
    return labels.answer_columns(answer_table(t), ["long", "seg", "name"])


@query(
    "src_pad_digits",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN RIGHT(c_name, 6) ELSE LPAD(CAST(c_custkey AS VARCHAR), 6, '0') END AS roll FROM customer",
)
def _(t):
    key = F.col("c_custkey")
    roll = F.when(key % 10 == 3, F.right("c_name", F.lit(6))).otherwise(key.cast("string"))
    return labels.pad_digits(t.raw("customer").select("c_custkey", roll.alias("roll")), "roll")


VIEWS["f_label_rows"] = """SELECT scan_id AS place, CASE scan_id % 5 WHEN 0 THEN REPLACE(split_part(file_name, '/', 2), '.jpg', '.TIF') WHEN 1 THEN 'C:\\x\\' || UPPER(split_part(file_name, '/', 2)) WHEN 2 THEN 'other' || scan_id ELSE split_part(file_name, '/', 2) END AS "Name", status AS label FROM f_scans""".replace("\\\\", "\\")


def label_rows(t: Tables):
    kind, name = F.col("scan_id") % 5, tx.base_name(F.col("file_name"))
    own = (
        F.when(kind == 0, F.replace(name, F.lit(".jpg"), F.lit(".TIF")))
        .when(kind == 1, F.concat(F.lit("C:\\x\\"), F.upper(name)))
        .when(kind == 2, F.concat(F.lit("other"), F.col("scan_id").cast("string")))
        .otherwise(name)
    )
    return t.scans.select(F.col("scan_id").alias("place"), own.alias("Name"), F.col("status").alias("label"))


_CHAR = "SUBSTR('ABCD *', CAST((scan_id + {0} * {0}) % 6 + 1 AS INTEGER), 1)"


@query(
    "src_label_file",
    f"""SELECT s.scan_id AS place, CASE WHEN s.scan_id % 5 <> 2 THEN s.status END AS label, {", ".join(f"CASE WHEN s.scan_id % 5 <> 2 THEN TRIM({_CHAR.format(i)}) END AS q{i + 1}" for i in range(20))},
       (SELECT COUNT(*) FILTER (place % 5 <> 2) >= 0.5 * COUNT(*) FROM f_label_rows) AS names_files FROM f_scans s""",
)
def _(t):
    images = t.scans.select(F.col("file_name").alias("image"), F.col("scan_id").alias("place"))
    chars = [F.expr(_CHAR.format(i).replace("scan_id", "place")) for i in range(20)]
    rows = label_rows(t).withColumn("Given", F.concat(*chars))
    named = labels.hit_rate(rows, images, "Name").select("names_files").scalar()
    return labels.read_labels(rows, images).select("place", "label.*", named.alias("names_files"))


VIEWS["f_key_cells"] = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CHR(CAST(65 + p_size % 4 AS INTEGER)) WHEN 1 THEN CHR(CAST(65 + p_size % 4 AS INTEGER)) || ', E' ELSE '[["' || CHR(CAST(65 + p_size % 4 AS INTEGER)) || '", ' || (p_size % 5) || '], ["E", "3/2"]]' END AS cell FROM part"""


@query(
    "src_answer_key_csv",
    """SELECT p_partkey AS id, CHR(CAST(65 + p_size % 4 AS INTEGER)) AS answer, CASE WHEN p_partkey % 3 = 2 THEN CAST(p_size % 5 AS DOUBLE) END AS marks FROM part
       UNION ALL SELECT p_partkey, 'E', CASE WHEN p_partkey % 3 = 2 THEN 1.5 END FROM part WHERE p_partkey % 3 > 0""",
)
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    letter = F.char(65 + size % 4)
    cell = (
        F.when(key % 3 == 0, letter)
        .when(key % 3 == 1, F.concat(letter, F.lit(", E")))
        .otherwise(F.format_string('[["%s", %d], ["E", "3/2"]]', letter, size % 5))
    )
    path = scratch(t.spark, "key.csv")
    t.raw("part").select(key.cast("string").alias("q"), cell.alias("a")).write.option("escape", '"').csv(path)
    read = t.spark.read.schema("q string, a string").option("escape", '"').csv(path)
    return read.select(F.col("q").cast("bigint").alias("id"), F.inline(labels.parse_answers(F.col("a"))))


@query(
    "src_answer_key_table",
    """SELECT p_partkey AS id, CHR(CAST(65 + p_size % 4 AS INTEGER)) AS answer, CAST(p_size % 7 AS DOUBLE) AS marks FROM part UNION ALL SELECT p_partkey, 'AB', ROUND(p_size / 4.0, 6) FROM part""",
)
def _(t):
    size = F.col("p_size")
    text = F.concat(F.char(65 + size % 4), F.lit(" : "), (size % 7).cast("string"), F.lit(", AB="), size.cast("string"), F.lit("/4 ;"))
    path = scratch(t.spark, "table.tsv")
    t.raw("part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), text).alias("value")).write.text(path)
    read = lines.read_delimited(t.spark, path, "\t", header_row=0)
    return read.select(F.col("C1").cast("bigint").alias("id"), F.inline(labels.parse_weights(F.trim("C2"))))


TEMPLATE = {
    "pageDimensions": [400, 600],
    "bubbleDimensions": [20, 20],
    "emptyValue": "",
    "fieldBlocks": {
        "left": {"origin": [10, 20], "fieldLabels": ["q1..4"], "bubbleValues": OPTIONS, "direction": "horizontal", "bubblesGap": 30, "labelsGap": 40},
        "right": {"origin": [210, 20], "fieldLabels": ["q5..7"], "bubbleValues": OPTIONS, "direction": "vertical", "bubblesGap": 30, "labelsGap": 40},
    },
    "customLabels": {"roll": ["q1..3"]},
}


@query(
    "src_template",
    """SELECT CASE WHEN pos <= 4 THEN 'left' ELSE 'right' END AS block, name, opt, CASE WHEN pos <= 4 THEN 10.0 + (opt_pos - 1) * 30 ELSE 210.0 + (pos - 5) * 40 END AS x,
       CASE WHEN pos <= 4 THEN 20.0 + (pos - 1) * 40 ELSE 20.0 + (opt_pos - 1) * 30 END AS y, CASE WHEN pos <= 3 THEN 'roll' END AS label, SUM(marked) AS marks FROM f_bubbles GROUP BY ALL""",
)
def _(t):
    grid = labels.template_bubbles(t.spark, TEMPLATE)
    groups = labels.template_groups(t.spark, TEMPLATE).select(F.col("group").alias("label"), F.col("column").alias("name"))
    marks = t.bubbles.groupBy("name", "opt").agg(F.sum("marked").alias("marks"))
    return grid.join(marks, ["name", "opt"]).join(groups, "name", "left").select("block", "name", "opt", "x", "y", "label", "marks")


# ---- sinks --------------------------------------------------------------------------------

CSV = [
    export.ExportColumn("scan_id", "meta", "scan_id"),
    export.ExportColumn("roll", "field", "roll"),
    export.ExportColumn("code", "field", "code"),
    export.ExportColumn("day", "field", "day", type="date", options={"output_format": "%d.%m.%Y"}),
]


@query(
    "snk_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) || ';' || (CASE WHEN o_custkey % 2 = 0 THEN REPLACE('@=@@0' || o_custkey || '@@@', '@', chr(34)) ELSE 'C' || o_custkey END) || ';' ||
       REPLACE(CASE WHEN o_orderkey % 5 = 0 THEN '@=@@1234567890123456@@@' ELSE '@a;b@' END, '@', chr(34)) || ';' || strftime(o_orderdate, '%d.%m.%Y') AS line FROM orders""",
)
def _(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rows = t.raw("orders").select(
        key.alias("scan_id"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("0"), cust)).otherwise(F.concat(F.lit("C"), cust)).alias("roll"),
        F.when(key % 5 == 0, "1234567890123456").otherwise("a;b").alias("code"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    path = scratch(t.spark, "export.csv")
    writers.write_csv(rows, path, CSV, ";", "formula", header=False)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "snk_routed",
    """SELECT route, COUNT(*) AS n, MIN(scan_id) AS first_scan FROM (SELECT scan_id, CASE WHEN status = 'error' THEN 'Errors' WHEN scan_id IN (SELECT scan_id FROM f_flags WHERE flag = 'multi_marked') THEN 'MultiMarked' ELSE 'Results' END AS route FROM f_scans) r GROUP BY 1
       UNION ALL SELECT 'NeedsReview', COUNT(*), MIN(scan_id) FROM f_cells WHERE needs_review = 1""",
)
def _(t):
    path = scratch(t.spark, "routes")
    writers.write_routed(export.routes(t.scans, readings(t)), path)
    waiting = scratch(t.spark, "review")
    readings(t).where("needs_review").write.parquet(waiting)
    routed = t.spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n"), F.min("scan_id").alias("first_scan"))
    items = t.spark.read.parquet(waiting).agg(F.lit("NeedsReview").alias("route"), F.count("*").alias("n"), F.min("scan_id").alias("first_scan"))
    return routed.unionByName(items)


_WIDE = ", ".join(f"COALESCE(MAX(c.value) FILTER (c.name = '{n}'), '') AS {n}" for n in NAMES)


@query("snk_job_csv", f"SELECT s.job_id, s.seq, s.file_name, s.status, {_WIDE} FROM f_scans s LEFT JOIN f_cells c ON c.scan_id = s.scan_id GROUP BY 1, 2, 3, 4")
def _(t):
    rows = t.scans_seq.select("scan_id", "job_id", "seq", "file_name", "status")
    wide = rows.join(export.wide(t.cells, NAMES), "scan_id", "left").fillna("", NAMES).drop("scan_id")
    path = scratch(t.spark, "jobs")
    writers.write_job_tables(wide, path, "job_id", ["seq"])
    return writers.read_table(t.spark, path, wide.schema)


@query(
    "snk_flat_csv",
    f"""SELECT s.file_name, s.status, s.score, COALESCE((SELECT STRING_AGG(name, '|' ORDER BY name) FROM f_review r WHERE r.scan_id = s.scan_id AND r.state = 'pending'), '') AS review, {_WIDE} FROM f_scans s LEFT JOIN f_cells c ON c.scan_id = s.scan_id GROUP BY s.scan_id, 1, 2, 3""",
)
def _(t):
    waiting = t.review.where("state = 'pending'").groupBy("scan_id").agg(
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("review")
    )
    rows = t.scans.select("scan_id", "file_name", "status", "score").join(waiting, "scan_id", "left")
    flat = rows.join(export.wide(t.cells, NAMES), "scan_id", "left").fillna("", ["review", *NAMES]).drop("scan_id")
    path = scratch(t.spark, "flat")
    writers.write_table(flat, path)
    return writers.read_table(t.spark, path, flat.schema)


@query(
    "snk_preview",
    """SELECT scan_id, q4, CASE WHEN q4 NOT IN ('A', '', 'N') THEN 'q4: not a yes/no value' ELSE '' END AS errors FROM (SELECT scan_id, MAX(value) FILTER (pos = 4) AS q4 FROM f_edited WHERE scan_id IN (SELECT scan_id FROM f_scans ORDER BY scan_id LIMIT 25) GROUP BY 1
       UNION ALL SELECT scan_id, NULL FROM (SELECT scan_id FROM f_scans ORDER BY scan_id LIMIT 25) f WHERE scan_id NOT IN (SELECT scan_id FROM f_cells)) x""",
)
def _(t):
    profile = export.Profile(("scan_id",), ({"field": "q4", "type": "bool", "true": ["A"], "false": ["", "N"]},))
    plan, _ = export.plan(profile, NAMES, GROUP)
    first = t.scans.select("scan_id").orderBy("scan_id").limit(25)
    mine = edited(t).join(first, "scan_id", "left_semi")
    items = export.items(mine, t.review, {})
    raw = items.where("output = 'q4'").select("scan_id", F.col("value").alias("raw"))
    rows = export.build(first, items, plan).join(raw, "scan_id", "left")
    return rows.select("scan_id", F.col("raw").alias("q4"), F.array_join("cast_errors", "; ").alias("errors"))


@query("snk_training", "SELECT label, predicted, COUNT(*) AS n FROM (SELECT label, predicted FROM f_manifest UNION ALL SELECT label, predicted FROM f_manifest WHERE label <> predicted) m GROUP BY 1, 2")
def _(t):
    from answerlake.plans.accuracy import labelled

    # The labelled bubbles are written once, without the texts a manifest makes of them; both appends read them
    rows = mlprep.manifest(hand_over(labelled(t), "labelled", tidy=True))
    path = scratch(t.spark, "training.jsonl")
    writers.append_samples(rows, path)
    writers.append_samples(rows.where("label <> predicted"), path)
    rows = t.spark.read.schema("label string, predicted string").json(path)
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query(
    "snk_sql_upsert",
    """SELECT scan_id, CASE WHEN status = 'error' THEN 'ok' ELSE status END AS status, CASE WHEN status = 'error' THEN 'again' END AS note FROM f_scans WHERE scan_id % 10 <> 9
       UNION ALL SELECT scan_id, 'ok', 'again' FROM f_scans WHERE scan_id % 10 = 9 AND status = 'error'""",
)
def _(t):
    # The keyed-table form of the upsert: a table, then changes with a column it did not have
    target = scratch(t.spark, "table-1")
    t.scans.where("scan_id % 10 <> 9").select("scan_id", "status").write.parquet(target)
    changes = t.scans.where("status = 'error'").select("scan_id", F.lit("ok").alias("status"), F.lit("again").alias("note"))
    return writers.upsert_table(t.spark, target, changes, ["scan_id"], scratch(t.spark, "table-2"))
