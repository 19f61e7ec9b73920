"""Grade responses against an answer key: verdicts, marks, section totals and bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlake.config import local_frame

DEFAULT_SECTION = "DEFAULT"
# Marks per verdict of each section (correct, incorrect, unmarked).
SCHEMES = {"DEFAULT": (3.0, -1.0, 0.0), "HARD": (5.0, -2.0, 0.0)}
# Score bands, the lowest score of each.
BANDS = (("low", 0.0), ("mid", 5.0), ("high", 10.0))


@dataclass(frozen=True)
class Options:
    """Grading rules that change a verdict before the answer is looked at."""

    dropped: Sequence[str] = ()
    bonus: Sequence[str] = ()
    multi_rule: str = "default"  # default | incorrect | unmarked
    empty: str = ""
    bands: Sequence[tuple[str, float]] = field(default=BANDS)


KEY_SCHEMA = pa.schema(
    [
        ("question", pa.string()),
        ("pos", pa.int32()),
        ("section", pa.string()),
        ("answer_type", pa.string()),
        ("answers", pa.map_(pa.string(), pa.float64())),
        ("option_length", pa.int32()),
        ("best", pa.float64()),
        ("incorrect", pa.float64()),
        ("unmarked", pa.float64()),
    ]
)


def answer_key(
    spark: SparkSession,
    rows: Iterable[tuple[str, int, str, str, float]],
    schemes: Mapping[str, tuple[float, float, float]] = SCHEMES,
) -> DataFrame:
    """One row per question from (question, pos, section, answer, marks) rows.

    A section without a scheme of its own is graded by the default scheme.
    """
    questions: dict[str, dict] = {}
    for question, pos, section, answer, marks in rows:
        if not answer:
            raise ValueError(f"{question}: an answer is blank")
        entry = questions.setdefault(question, {"pos": pos, "section": section, "answers": {}})
        if entry["section"] != section:
            raise ValueError(f"{question} is in sections {entry['section']} and {section}")
        entry["answers"][answer] = float(marks)
    out = []
    for question, entry in questions.items():
        section = entry["section"] if entry["section"] in schemes else DEFAULT_SECTION
        correct, incorrect, unmarked = schemes[section]
        answers = entry["answers"]
        if any(m != correct for m in answers.values()):
            kind = "multiple-correct-weighted"
        else:
            kind = "standard" if len(answers) == 1 else "multiple-correct"
        out.append(
            (
                question,
                entry["pos"],
                section,
                kind,
                list(answers.items()),
                max(1, min(map(len, answers))),
                max(correct, *answers.values()),
                incorrect,
                unmarked,
            )
        )
    return local_frame(spark, out, KEY_SCHEMA)


def is_multi_marked(value: Column, option_length: Column, empty: str = "") -> Column:
    return (value != empty) & (F.length(value) > option_length)


def verdict(value: Column, options: Options = Options()) -> Column:
    """struct<verdict, delta> of one answer next to the columns of its key row."""

    def result(name, marks) -> Column:
        name = name if isinstance(name, Column) else F.lit(name)
        marks = marks if isinstance(marks, Column) else F.lit(marks)
        return F.struct(name.alias("verdict"), marks.cast("double").alias("delta"))

    question = F.col("question")
    weight = F.try_element_at(F.col("answers"), value)
    named = F.when(F.col("answer_type") == "standard", F.lit("correct")).otherwise(
        F.concat(F.lit("correct-"), value)
    )
    plain = (
        F.when(value == options.empty, result("unmarked", F.col("unmarked")))
        .when(weight.isNotNull(), result(named, weight))
        .otherwise(result("incorrect", F.col("incorrect")))
    )
    graded = plain
    if options.multi_rule in ("incorrect", "unmarked"):
        multi = is_multi_marked(value, F.col("option_length"), options.empty)
        ruled = result(options.multi_rule, F.col(options.multi_rule))
        graded = F.when(multi, ruled).otherwise(plain)
    if options.bonus:
        graded = F.when(question.isin(*options.bonus), result("bonus", F.col("best"))).otherwise(
            graded
        )
    if options.dropped:
        graded = F.when(question.isin(*options.dropped), result("dropped", 0.0)).otherwise(graded)
    return graded


def grade(responses: DataFrame, key: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per graded answer: responses(scan_id, name, value) joined to the key."""
    joined = responses.select("scan_id", F.col("name").alias("question"), "value").join(
        key, "question"
    )
    return joined.select(
        "scan_id",
        "question",
        "pos",
        "section",
        F.col("value").alias("marked"),
        "answers",
        "best",
        F.inline(F.array(verdict(F.col("value"), options))),
    )


def verdict_kind(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def band_of(score: Column, bands: Sequence[tuple[str, float]] = BANDS) -> Column:
    """Label of the last band whose minimum the score reaches; none below the first."""
    label = F.lit(None).cast("string")
    for name, low in sorted(bands, key=lambda b: b[1]):
        label = F.when(score >= low, F.lit(name)).otherwise(label)
    return label


def section_scores(graded: DataFrame, options: Options = Options()) -> DataFrame:
    """Marks and best possible marks per (sheet, section)."""
    return graded.groupBy("scan_id", "section").agg(
        F.sum("delta").alias("section_score"), _best(options).alias("section_max")
    )


def score_sheets(graded: DataFrame, options: Options = Options()) -> DataFrame:
    """Score, best score, verdict counts and band per sheet, in one aggregation."""
    kind = verdict_kind(F.col("verdict"))

    def count(name):
        return F.count(F.when(kind == name, 1)).alias(f"n_{name}")

    return (
        graded.groupBy("scan_id")
        .agg(
            F.sum("delta").alias("score"),
            _best(options).alias("max_score"),
            *[count(k) for k in ("correct", "incorrect", "unmarked", "bonus", "dropped")],
        )
        .withColumn("band", band_of(F.col("score"), options.bands))
    )


def _best(options: Options) -> Column:
    best = F.col("best")
    if options.dropped:
        best = F.when(F.col("question").isin(*options.dropped), 0.0).otherwise(best)
    return F.sum(best)


def explanation(graded: DataFrame) -> DataFrame:
    """Each answer with the score so far, in key order; a sheet has one row per question."""
    running = (
        Window.partitionBy("scan_id")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return graded.select(
        "scan_id",
        "question",
        "marked",
        "verdict",
        "delta",
        F.sum("delta").over(running).alias("running_score"),
    )


def missing_questions(responses: DataFrame, key: DataFrame) -> DataFrame:
    """Key questions a sheet has no response for, and q* responses without a key."""
    asked = [r["question"] for r in key.select("question").collect()]  # settings, not data
    seen = F.collect_set("name")
    per_sheet = responses.groupBy("scan_id").agg(seen.alias("seen"))
    known = F.array(*[F.lit(q) for q in asked])
    unkeyed = F.filter(F.array_except("seen", known), lambda n: n.startswith("q"))
    return per_sheet.select(
        "scan_id",
        F.array_sort(F.array_except(known, "seen")).alias("missing"),
        F.array_sort(unkeyed).alias("unkeyed"),
    )


def validate_key(key: DataFrame, filter_out_multi_marked: bool = False) -> DataFrame:
    """Problems of an answer table, one row each: repeated questions and, when sheets with
    multi-marks are filtered out, answers that need more than one mark."""
    repeated = (
        key.groupBy("question")
        .agg(F.count_distinct("section").alias("n"))
        .where("n > 1")
        .select("question", F.lit("in several sections").alias("problem"))
    )
    if not filter_out_multi_marked:
        return repeated
    wide = (
        key.select("question", F.explode(F.map_keys("answers")).alias("answer"))
        .where(F.length("answer") > 1)
        .select("question", F.lit("needs a multi-mark").alias("problem"))
        .distinct()
    )
    return repeated.unionByName(wide)


def key_problems(questions: DataFrame, key: DataFrame, sections: DataFrame, filter_out_multi_marked: bool = False) -> DataFrame:
    """Everything that is wrong with an answer table, one row (question, problem) each.

    questions(question) are those the evaluation names, key(question, section, answers) the answers given, and
    sections(section, question) the questions of the marking schemes: a question without an answer, an answer
    without a question, a scheme's question that the evaluation does not name, a question of two schemes,
    and what `validate_key` finds.
    """
    def named(rows: DataFrame, problem: str) -> DataFrame:
        return rows.select("question").distinct().withColumn("problem", F.lit(problem))

    asked, given, marked = questions.select("question"), key.select("question"), sections.select("question")
    twice = sections.groupBy("question").agg(F.count_distinct("section").alias("n")).where("n > 1")
    return (
        validate_key(key, filter_out_multi_marked)
        .unionByName(named(asked.join(given, "question", "left_anti"), "no answer"))
        .unionByName(named(given.join(asked, "question", "left_anti"), "not a question"))
        .unionByName(named(marked.join(asked, "question", "left_anti"), "in a section but not a question"))
        .unionByName(named(twice, "in the schemes of several sections"))
    )


def key_from_responses(responses: DataFrame, master_scan, key: DataFrame) -> DataFrame:
    """The responses of a master sheet as a key; blank answers leave their question out."""
    return responses.where((F.col("scan_id") == F.lit(master_scan)) & (F.col("value") != "")).select(
        F.col("name").alias("question"), F.col("value").alias("answer")
    )


def regrade_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sheets whose score changes under another key, with both scores."""
    old = before.select("scan_id", F.col("score").alias("score_before"))
    new = after.select("scan_id", F.col("score").alias("score_after"))
    return old.join(new, "scan_id", "full").where(
        ~F.col("score_before").eqNullSafe(F.col("score_after"))
    )


def merge_reads(before: DataFrame, log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old reads, corrections and new reads of every item as one row: a three-way merge in one aggregation.

    before(scan_id, name, value) are the values first read, log(scan_id, name, id, new_value) the corrections,
    of which the last of an item counts, and fresh(scan_id, name, value) the new reads. A correction that
    differs from the first value is kept where the item is read again, whatever the new read says, and dropped
    where it is gone. Result: (scan_id, name, old_value, new_value, read_value, kept, dropped), with the values that
    stand before and after, and the new read beneath a kept correction.
    """
    null = F.lit(None).cast("string")
    parts = (
        (before, {"base": F.col("value")}),
        (log, {"edit": F.struct("id", F.col("new_value").alias("value"))}),
        (fresh, {"again": F.struct(F.col("value").alias("value"))}),
    )
    rows = None
    for df, own in parts:
        part = df.select("scan_id", "name", *[c.alias(n) for n, c in own.items()])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    one = rows.groupBy("scan_id", "name").agg(
        F.max("base").alias("base"), F.max_by("edit", "edit.id")["value"].alias("mine"), F.max("again").alias("again")
    )
    edited = F.col("mine").isNotNull() & ~F.col("mine").eqNullSafe(F.col("base"))
    there = F.col("again").isNotNull()
    return one.select(
        "scan_id",
        "name",
        F.when(edited, F.col("mine")).otherwise(F.col("base")).alias("old_value"),
        F.when(there & edited, F.col("mine")).when(there, F.col("again.value")).otherwise(null).alias("new_value"),
        F.col("again.value").alias("read_value"),
        (edited & there).alias("kept"),
        (edited & ~there).alias("dropped"),
    )


def regrade(
    before: DataFrame, log: DataFrame, fresh: DataFrame, old_key: DataFrame, new_key: DataFrame, options: Options = Options()
) -> DataFrame:
    """Sheets read again under another key: scores before and after, corrections kept and dropped.

    Rows of sheets whose score changes or that had corrections; kept and dropped are sorted lists of names.
    """
    merged = merge_reads(before, log, fresh)
    old = grade(merged.select("scan_id", "name", F.col("old_value").alias("value")).where("value IS NOT NULL"), old_key, options)
    new = grade(merged.select("scan_id", "name", F.col("new_value").alias("value")).where("value IS NOT NULL"), new_key, options)
    listed = merged.groupBy("scan_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col(c), F.col("name")))).alias(c) for c in ("kept", "dropped")]
    )
    scores = [
        rows.groupBy("scan_id").agg(F.sum("delta").alias(name)) for rows, name in ((old, "score_before"), (new, "score_after"))
    ]
    changed = ~F.col("score_before").eqNullSafe(F.col("score_after")) | (F.size("kept") > 0) | (F.size("dropped") > 0)
    out = listed.join(scores[0], "scan_id", "left").join(scores[1], "scan_id", "left")
    return out.where(changed).select("scan_id", "score_before", "score_after", "kept", "dropped")
