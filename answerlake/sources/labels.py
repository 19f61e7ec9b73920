"""Ground truth, label files and answer keys as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.config import expand_fields, local_frame
from answerlake.functions import text as tx

# Spellings of the file column and of answer columns, in order of preference.
FILE_COLUMNS = ("filename", "fileid", "file", "image")
AMBIGUOUS = ("name", "id")
ANSWER_CHARS = r"^[A-Za-z*\s\-]+$"


def plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def file_column(columns: Sequence[str]) -> str | None:
    by_plain = {}
    for column in columns:
        by_plain.setdefault(plain(column), column)
    return next((by_plain[c] for c in (*FILE_COLUMNS, *AMBIGUOUS) if c in by_plain), None)


def answer_chars(value: Column, count: Column | int) -> Column:
    """array<struct<pos, value>> of an answer string: a space is blank, `*` a multi-mark."""
    count = F.lit(count) if isinstance(count, int) else count
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda i: F.struct(i.alias("pos"), tx.strip(F.substring(value, i, F.lit(1))).alias("value"))
    )


def truth_long(table: DataFrame, answers: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """truth(file_key, column, expected) of a wide all-text table; answer columns are written out
    to <prefix>1..n."""
    key = file_column(table.columns)
    if key is None:
        raise ValueError("a truth table needs a file-name column")
    answers = answers or {}
    plain_columns = [c for c in table.columns if c != key and c not in answers]
    cells = [
        F.array(F.struct(F.lit(c).alias("column"), tx.strip(F.coalesce(F.col(c), F.lit(""))).alias("expected")))
        for c in plain_columns
    ]
    for column, (prefix, count) in answers.items():
        cells.append(
            F.transform(
                answer_chars(F.coalesce(F.col(column), F.lit("")), count),
                lambda a: F.struct(
                    F.concat(F.lit(prefix), a["pos"].cast("string")).alias("column"),
                    a["value"].alias("expected"),
                ),
            )
            if count
            else F.array()
        )
    return table.select(tx.strip(F.col(key)).alias("file_key"), F.inline(F.concat(*cells)))


def lookup_truth(scans: DataFrame, keys: DataFrame) -> DataFrame:
    """Truth of each sheet of scans(scan_id, file_name) from keys(key, pos, value): by the whole id, else by the bare
    file name, else by the stem. Of equal keys the last counts, of equal stems the first, so a sheet stays one row."""
    one = keys.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    whole = one.select(F.col("key").alias("file_name"), F.struct("value").alias("_whole"))
    bare = one.select(F.col("key").alias("_name"), F.struct("value").alias("_bare"))
    stems = keys.groupBy(tx.stem(F.col("key")).alias("_stem")).agg(F.min_by(F.struct("value"), "pos").alias("_first"))
    path = F.col("file_name")
    found = [F.when(F.col(c).isNotNull(), F.lit(how)) for c, how in (("_whole", "id"), ("_bare", "name"), ("_first", "stem"))]
    return (
        scans.select("scan_id", "file_name", tx.base_name(path).alias("_name"), tx.stem(path).alias("_stem"))
        .join(whole, "file_name", "left")
        .join(bare, "_name", "left")
        .join(stems, "_stem", "left")
        .select("scan_id", F.coalesce("_whole", "_bare", "_first")["value"].alias("value"), F.coalesce(*found).alias("matched"))
    )


def answer_columns(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns hold one character per question: long values of few distinct letters.

    Lengths and letters are counted per column and value before anything is gathered.
    """
    rows = table.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    ).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    own = F.filter(F.array_distinct(F.split(F.upper("value"), "")), lambda c: c.rlike(r"^\p{L}$"))
    letters = (
        rows.select("column", F.explode(own).alias("letter"))
        .distinct()
        .groupBy("column")
        .agg(F.count("*").cast("int").alias("letters"))
    )
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length(value))").cast("int")
    shape = rows.groupBy("column").agg(
        middle.alias("middle"), F.bool_and(F.col("value").rlike(ANSWER_CHARS)).alias("clean")
    )
    good = (F.col("middle") >= 15) & F.col("clean") & F.col("letters").between(1, 8)
    return shape.join(letters, "column", "left").fillna(0, ["letters"]).withColumn("is_answer", good)


def pad_digits(table: DataFrame, column: str) -> DataFrame:
    """Restore leading zeros a spreadsheet dropped: to the width a zero-led value shows, else to
    the width most values have when none is longer."""
    bare = F.trim(F.coalesce(F.col(column), F.lit("")))
    by_length = (
        table.where(bare != "")
        .groupBy(F.length(bare).alias("len"))
        .agg(
            F.count("*").alias("n"),
            F.bool_and(bare.rlike(r"^\p{Nd}+$")).alias("digits"),
            F.bool_or(bare.startswith("0") & (F.length(bare) >= 2)).alias("led"),
        )
    )
    led = F.max(F.when(F.col("led"), F.col("len")))
    common = F.max_by("len", F.struct("n", -F.col("len")))
    longest = F.max("len")
    clear = F.when((common == longest) & (common >= 2), longest)
    usable = F.bool_and("digits") & (F.sum("n") >= 2)
    width = by_length.agg(F.when(usable, F.coalesce(led, clear)).alias("w")).scalar()
    short = bare.rlike(r"^\p{Nd}+$") & (F.length(bare) < width)
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(bare), F.lit(0))), bare)
    return table.withColumn(column, F.when(short, padded).otherwise(F.col(column)))


def labelled(labels: DataFrame, images: DataFrame, name_column: str | None) -> DataFrame:
    """images(image, place) with their label row: by name where the column holds file names, else
    by place, which needs as many labels as images.

    A column whose name could mean people counts as file names when half of its values name images.
    """
    rest = F.struct(*[c for c in labels.columns if c != "place"])
    by_place = labels.select("place", rest.alias("_by_place"))
    even = labels.agg(F.count("*")).scalar() == images.agg(F.count("*")).scalar()
    refused = F.raise_error(F.lit("labels without file names match by place only in equal numbers"))
    placed = F.when(even, F.col("_by_place")).otherwise(refused)
    if name_column is None:
        return images.join(by_place, "place", "left").select("image", "place", placed.alias("label"))
    named = match_labels(labels, images, name_column)
    if plain(name_column) not in AMBIGUOUS:
        return named
    trusted = hit_rate(labels, images, name_column).select("names_files").scalar()
    label = F.when(trusted, F.col("label")).otherwise(placed)
    return named.join(by_place, "place", "left").select("image", "place", label.alias("label"))


def expand_answers(table: DataFrame, columns: Sequence[str], forced: Mapping[str, str] | None = None, prefix: str = "q") -> DataFrame:
    """The table with its answer columns written out, a column per question.

    `columns` are the data columns. Those that look like answers (`answer_columns`) and those forced to a prefix are
    written out to <prefix>1..n, n being the longest value's length; several of them get a prefix of their own,
    their name and `_q`. A name that is a column already is refused. What decides is one small aggregate per column.
    """
    forced = {plain(c): p for c, p in (forced or {}).items()}
    found = {r["column"] for r in answer_columns(table, columns).where("is_answer").select("column").collect()}
    wide = [c for c in columns if c in found or forced.get(plain(c))]
    if not wide:
        return table
    longest = table.agg(*[F.max(F.length(F.rtrim(F.col(c), F.lit("\r\n")))).alias(c) for c in wide]).first()
    taken, new = set(columns), []
    for column in wide:
        own = forced.get(plain(column)) or (f"{plain(column)}_q" if len(wide) > 1 else prefix)
        names = [f"{own}{i}" for i in range(1, (longest[column] or 0) + 1)]
        clash = next((n for n in names if n in taken), None)
        if clash:
            raise ValueError(f"answer column {column!r} would make {clash}, which is a column already")
        taken.update(names)
        chars = F.transform(answer_chars(F.coalesce(F.col(column), F.lit("")), len(names)), lambda a: a["value"])
        new += [F.get(chars, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return table.select(*[c for c in table.columns if c not in wide], *new)


def read_labels(table: DataFrame, images: DataFrame, forced: Mapping[str, str] | None = None, prefix: str = "q") -> DataFrame:
    """images(image, place) with a label row each, from an all-text table(place, ..): values trimmed, dropped zeros
    restored, answer columns written out, matched by file name or by place (`labelled`)."""
    data = [c for c in table.columns if c != "place"]
    key = file_column(data)
    if key is not None and plain(key) in AMBIGUOUS and not hit_rate(table, images, key).first()["names_files"]:
        key = None
    data = [c for c in data if c != key]
    for column in data:
        table = pad_digits(table, column)
    table = expand_answers(table, data, forced, prefix)
    kept = [c for c in table.columns if c in data]
    table = table.withColumns({c: tx.strip(F.coalesce(F.col(c), F.lit(""))) for c in kept})
    found = labelled(table, images, key)
    return found if key is None else found.withColumn("label", F.col("label").dropFields(f"`{key}`"))


def match_labels(labels: DataFrame, images: DataFrame, name_column: str) -> DataFrame:
    """images(image, place) with the label row of their name, else of their stem; labels keep
    their first row per name."""
    path = F.regexp_replace(F.trim(F.col(name_column)), r"\\", "/")
    named = labels.withColumn("_name", F.lower(tx.base_name(path))).withColumn("_stem", F.lower(tx.stem(path)))
    rest = F.struct(*[c for c in labels.columns if c != "place"])
    by_name = named.groupBy("_name").agg(F.min_by(rest, "place").alias("_by_name"))
    by_stem = named.groupBy("_stem").agg(F.min_by(rest, "place").alias("_by_stem"))
    rows = images.withColumn("_name", F.lower(tx.base_name(F.col("image")))).withColumn(
        "_stem", F.lower(tx.stem(F.col("image")))
    )
    return (
        rows.join(by_name, "_name", "left")
        .join(by_stem, "_stem", "left")
        .select("image", "place", F.coalesce("_by_name", "_by_stem").alias("label"))
    )


def hit_rate(labels: DataFrame, images: DataFrame, column: str) -> DataFrame:
    """Share of a column's values that name an image, by stem; a column with a name that could
    mean people is taken for file names from one half on."""
    stems = images.select(F.lower(tx.stem(F.col("image"))).alias("_stem")).distinct()
    mine = labels.select(F.lower(tx.stem(F.trim(F.col(column)))).alias("_stem")).where("_stem <> ''")
    hits = mine.join(stems, "_stem", "left_semi").agg(F.count("*")).scalar()
    total = stems.agg(F.count("*")).scalar()
    return mine.agg(F.count("*").alias("n"), F.max(hits).alias("hits")).select(
        "n", "hits", (F.col("hits") >= 0.5 * F.greatest(F.lit(1), F.least("n", total))).alias("names_files")
    )


# ---- answer keys --------------------------------------------------------------------------


def parse_answers(text: Column) -> Column:
    """array<struct<answer, marks>> of a key cell: one answer, `A,B`, or `[["A", 1], ["B", "3/2"]]`;
    marks are null where the section's marks count."""
    cell = F.trim(text)
    pairs = F.from_json(cell, "array<array<string>>")
    weighted = F.transform(
        pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("answer"), tx.fraction(F.get(p, F.lit(1))).alias("marks"))
    )
    several = F.transform(
        F.split(cell, ","), lambda a: F.struct(F.trim(a).alias("answer"), F.lit(None).cast("double").alias("marks"))
    )
    return F.when(cell.startswith("["), weighted).otherwise(several)


def parse_weights(text: Column) -> Column:
    """array<struct<answer, marks>> of a weight text such as `A:1, AB:1/2`."""

    def one(part: Column) -> Column:
        pieces = F.split(F.trim(part), r"\s*[:=]\s*")
        return F.struct(
            F.get(pieces, F.lit(0)).alias("answer"),
            tx.fraction(F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))).alias("marks"),
        )

    parts = F.filter(F.split(text, "[,;]"), lambda p: F.trim(p) != "")
    return F.transform(parts, one)


# ---- template -----------------------------------------------------------------------------

# The built-in field types (values, direction).
FIELD_TYPES = {
    "QTYPE_INT": (list("0123456789"), "vertical"),
    "QTYPE_INT_FROM_1": (list("1234567890"), "vertical"),
    "QTYPE_MCQ4": (list("ABCD"), "horizontal"),
    "QTYPE_MCQ5": (list("ABCDE"), "horizontal"),
}
BUBBLES = pa.schema(
    [
        ("block", pa.string()),
        ("name", pa.string()),
        ("opt_pos", pa.int32()),
        ("opt", pa.string()),
        ("x", pa.float64()),
        ("y", pa.float64()),
        ("w", pa.int32()),
        ("h", pa.int32()),
        ("empty", pa.string()),
    ]
)


def template_bubbles(spark: SparkSession, template: Mapping) -> DataFrame:
    """One row per bubble of a template document; names given twice and blocks that leave the
    page are refused."""
    page_w, page_h = template["pageDimensions"]
    rows, seen = [], set()
    for block, spec in template["fieldBlocks"].items():
        values, direction = FIELD_TYPES.get(spec.get("fieldType"), (None, None))
        values = spec.get("bubbleValues", values)
        direction = spec.get("direction", direction or "vertical")
        w, h = spec.get("bubbleDimensions", template["bubbleDimensions"])
        x0, y0 = spec["origin"]
        for i, name in enumerate(expand_fields(spec["fieldLabels"])):
            if name in seen:
                raise ValueError(f"{name} is in two blocks")
            seen.add(name)
            for j, value in enumerate(values):
                down, across = (i, j) if direction == "horizontal" else (j, i)
                if direction == "horizontal":
                    x = x0 + across * spec["bubblesGap"]
                    y = y0 + down * spec["labelsGap"]
                else:
                    x = x0 + across * spec["labelsGap"]
                    y = y0 + down * spec["bubblesGap"]
                if x + w > page_w or y + h > page_h or min(x, y) < 0:
                    raise ValueError(f"block {block} leaves the page at {name}")
                rows.append((block, name, j + 1, value, float(x), float(y), w, h, spec.get("emptyValue", template.get("emptyValue", ""))))
    return local_frame(spark, rows, BUBBLES)


def template_groups(spark: SparkSession, template: Mapping) -> DataFrame:
    """groups(group, pos, column) of a template's joined labels; unknown columns are refused."""
    names = [n for b in template["fieldBlocks"].values() for n in expand_fields(b["fieldLabels"])]
    rows = []
    for label, texts in template.get("customLabels", {}).items():
        columns = expand_fields(texts)
        unknown = [c for c in columns if c not in names]
        if unknown:
            raise ValueError(f"{label} joins {unknown[0]}, which no block has")
        rows += [(label, i, c) for i, c in enumerate(columns)]
    schema = pa.schema([("group", pa.string()), ("pos", pa.int32()), ("column", pa.string())])
    return local_frame(spark, rows, schema)
