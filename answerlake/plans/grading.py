"""Scoring queries: verdicts, marks, sections, bands and grading options."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlake.operators import scoring
from answerlake.plans.derived import KEY_ROWS, VIEWS, Tables
from answerlake.plans.registry import query

VIEWS["f_scheme"] = (
    "SELECT section, CAST(c AS DOUBLE) AS correct, CAST(i AS DOUBLE) AS incorrect, "
    "CAST(u AS DOUBLE) AS unmarked FROM (VALUES "
    + ", ".join(f"('{s}', {c}, {i}, {u})" for s, (c, i, u) in scoring.SCHEMES.items())
    + ") AS t(section, c, i, u)"
)
VIEWS["f_keyq"] = """
SELECT k.question, MIN(k.pos) AS pos, MIN(k.section) AS section, COUNT(*) AS n,
       GREATEST(MAX(k.marks), MAX(s.correct)) AS best, MIN(LENGTH(k.answer)) AS option_length,
       BOOL_AND(k.marks = s.correct) AS by_scheme, MAX(s.incorrect) AS incorrect, MAX(s.unmarked) AS unmarked
FROM f_key k JOIN f_scheme s ON s.section = k.section GROUP BY k.question"""
_GRADED = """
SELECT c.scan_id, q.question, q.pos, q.section, c.value AS marked, q.best,
       CASE {before} WHEN c.value = '' THEN 'unmarked'
            WHEN a.answer IS NULL THEN 'incorrect'
            WHEN q.n = 1 AND q.by_scheme THEN 'correct' ELSE 'correct-' || c.value END AS verdict,
       CASE {marks} WHEN c.value = '' THEN q.unmarked
            WHEN a.answer IS NULL THEN q.incorrect ELSE a.marks END AS delta
FROM f_cells c JOIN f_keyq q ON q.question = c.name
LEFT JOIN f_key a ON a.question = c.name AND a.answer = c.value"""
VIEWS["f_graded"] = _GRADED.format(before="", marks="")


def graded(t: Tables, **options):
    return scoring.grade(t.cells, t.key, scoring.Options(**options))


@query(
    "ag_score",
    """SELECT scan_id, SUM(delta) AS score, SUM(best) AS max_score,
       COUNT(*) FILTER (verdict LIKE 'correct%') AS n_correct,
       COUNT(*) FILTER (verdict = 'incorrect') AS n_incorrect,
       COUNT(*) FILTER (verdict = 'unmarked') AS n_unmarked,
       CASE WHEN SUM(delta) >= 10 THEN 'high' WHEN SUM(delta) >= 5 THEN 'mid'
            WHEN SUM(delta) >= 0 THEN 'low' END AS band
       FROM f_graded GROUP BY scan_id""",
)
def _(t):
    return scoring.score_sheets(graded(t)).drop("n_bonus", "n_dropped")


@query(
    "sc_sections",
    """SELECT scan_id, section, SUM(delta) AS section_score, SUM(best) AS section_max
       FROM f_graded GROUP BY scan_id, section""",
)
def _(t):
    return scoring.section_scores(graded(t))


@query("jn_answer_key", "SELECT scan_id, question, section, marked, verdict, delta FROM f_graded")
def _(t):
    return graded(t).select("scan_id", "question", "section", "marked", "verdict", "delta")


@query(
    "fn_verdict",
    "SELECT question, marked, verdict, COUNT(*) AS n, SUM(delta) AS marks FROM f_graded GROUP BY 1, 2, 3",
)
def _(t):
    return (
        graded(t)
        .groupBy("question", "marked", "verdict")
        .agg(F.count("*").alias("n"), F.sum("delta").alias("marks"))
    )


@query(
    "ag_verdict_kind",
    "SELECT section, split_part(verdict, '-', 1) AS kind, COUNT(*) AS n FROM f_graded GROUP BY 1, 2",
)
def _(t):
    kind = scoring.verdict_kind(F.col("verdict")).alias("kind")
    return graded(t).groupBy("section", kind).agg(F.count("*").alias("n"))


@query(
    "wn_running_score",
    """SELECT scan_id, question, marked, verdict, delta, SUM(delta) OVER
       (PARTITION BY scan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running_score FROM f_graded""",
)
def _(t):
    return scoring.explanation(graded(t))


@query(
    "jn_band_range",
    """SELECT band, COUNT(*) AS sheets, MIN(score) AS lowest, MAX(score) AS highest FROM (
       SELECT s.scan_id, s.score, arg_max(b.label, b.low) AS band
       FROM (SELECT scan_id, SUM(delta) AS score FROM f_graded GROUP BY scan_id) s
       LEFT JOIN (VALUES ('low', 0.0), ('mid', 5.0), ('high', 10.0)) b(label, low) ON b.low <= s.score
       GROUP BY s.scan_id, s.score) x GROUP BY band""",
)
def _(t):
    return (
        scoring.score_sheets(graded(t))
        .groupBy("band")
        .agg(
            F.count("*").alias("sheets"),
            F.min("score").alias("lowest"),
            F.max("score").alias("highest"),
        )
    )


def _score_sql(before: str, marks: str) -> str:
    return (
        "SELECT scan_id, SUM(delta) AS score, SUM(CASE WHEN verdict = 'dropped' THEN 0 ELSE best END)"
        f" AS max_score FROM ({_GRADED.format(before=before, marks=marks)}) g GROUP BY scan_id"
    )


def _scored(t, **options):
    opts = scoring.Options(**options)
    return scoring.score_sheets(scoring.grade(t.cells, t.key, opts), opts).select(
        "scan_id", "score", "max_score"
    )


@query(
    "sc_drop",
    _score_sql(
        "WHEN q.question IN ('q2', 'q6') THEN 'dropped'", "WHEN q.question IN ('q2', 'q6') THEN 0.0"
    ),
)
def _(t):
    return _scored(t, dropped=("q2", "q6"))


@query(
    "sc_bonus",
    _score_sql("WHEN q.question = 'q4' THEN 'bonus'", "WHEN q.question = 'q4' THEN q.best"),
)
def _(t):
    return _scored(t, bonus=("q4",))


_MULTI = "c.value <> '' AND LENGTH(c.value) > q.option_length"


@query(
    "sc_multi_rule",
    _score_sql(f"WHEN {_MULTI} THEN 'incorrect'", f"WHEN {_MULTI} THEN q.incorrect"),
)
def _(t):
    return _scored(t, multi_rule="incorrect")


@query(
    "fn_multi_marked",
    f"""SELECT q.question, COUNT(*) FILTER ({_MULTI}) AS multi, COUNT(*) AS n
       FROM f_cells c JOIN f_keyq q ON q.question = c.name GROUP BY 1""",
)
def _(t):
    multi = scoring.is_multi_marked(F.col("value"), F.col("option_length"))
    return (
        t.cells.join(t.key.select("question", "option_length"), F.col("name") == F.col("question"))
        .groupBy("question")
        .agg(F.count_if(multi).alias("multi"), F.count("*").alias("n"))
    )


@query(
    "sc_weighted",
    """SELECT question, verdict, delta, COUNT(*) AS n FROM f_graded
       WHERE question IN (SELECT question FROM f_keyq WHERE NOT by_scheme) GROUP BY 1, 2, 3""",
)
def _(t):
    weighted = t.key.where("answer_type = 'multiple-correct-weighted'")
    return (
        scoring.grade(t.cells, weighted)
        .groupBy("question", "verdict", "delta")
        .agg(F.count("*").alias("n"))
    )


@query(
    "sc_ranges",
    """SELECT scan_id, SUM(delta) AS score FROM f_graded
       WHERE question IN ('q2', 'q3', 'q4', 'q5') GROUP BY scan_id""",
)
def _(t):
    from answerlake.config import expand_fields

    listed = t.key.where(F.col("question").isin(expand_fields(["q2..5"])))
    return scoring.score_sheets(scoring.grade(t.cells, listed)).select("scan_id", "score")


@query(
    "jn_key_missing",
    """SELECT scan_id, COALESCE(STRING_AGG(question, ',' ORDER BY question), '') AS missing FROM (
       SELECT s.scan_id, q.question FROM (SELECT DISTINCT scan_id FROM f_cells) s CROSS JOIN f_keyq q
       WHERE NOT EXISTS (SELECT 1 FROM f_cells c WHERE c.scan_id = s.scan_id AND c.name = q.question)
       UNION ALL SELECT DISTINCT scan_id, NULL FROM f_cells) x GROUP BY scan_id""",
)
def _(t):
    return scoring.missing_questions(t.cells, t.key).select(
        "scan_id", F.array_join("missing", ",").alias("missing")
    )


_OTHER_KEY = [r if r[0] != "q2" else ("q2", 2, "DEFAULT", "A", 3.0) for r in KEY_ROWS]


# Sheets of a third batch are read again without their fourth item; some corrections were taken back later
_AGAIN = """SELECT scan_id, pos, name, CASE WHEN (scan_id + pos) % 6 = 0 THEN 'N' ELSE value END AS value FROM f_cells WHERE NOT (scan_id % 10 = 0 AND pos = 4)"""
_MERGED = f"""SELECT b.scan_id, b.name, b.pos, COALESCE(e.v, b.value) AS old_value, CASE WHEN n.value IS NOT NULL THEN COALESCE(e.v, n.value) END AS new_value, e.v IS NOT NULL AS edited, n.value IS NOT NULL AS there
  FROM f_cells b LEFT JOIN ({_AGAIN}) n ON n.scan_id = b.scan_id AND n.name = b.name LEFT JOIN (SELECT scan_id, name, new_value AS v FROM f_corrections WHERE scan_id % 15 <> 0 AND new_value <> original_value) e ON e.scan_id = b.scan_id AND e.name = b.name"""


def _graded_sql(column: str) -> str:
    return _GRADED.format(before="", marks="").replace("f_cells c", f"(SELECT scan_id, name, {column} AS value FROM m WHERE {column} IS NOT NULL) c")


@query(
    "sc_regrade",
    f"""WITH m AS MATERIALIZED ({_MERGED}), o AS (SELECT scan_id, SUM(delta) AS score FROM ({_graded_sql("old_value")}) g GROUP BY 1),
       n AS (SELECT scan_id, SUM(CASE WHEN question <> 'q2' THEN delta WHEN marked = '' THEN 0 WHEN marked = 'A' THEN 3 ELSE -1 END) AS score FROM ({_graded_sql("new_value")}) g GROUP BY 1),
       k AS (SELECT scan_id, COALESCE(STRING_AGG(name, ',' ORDER BY name) FILTER (edited AND there), '') AS kept, COALESCE(STRING_AGG(name, ',' ORDER BY name) FILTER (edited AND NOT there), '') AS dropped FROM m GROUP BY 1)
       SELECT k.scan_id, o.score AS score_before, n.score AS score_after, kept, dropped FROM k LEFT JOIN o ON o.scan_id = k.scan_id LEFT JOIN n ON n.scan_id = k.scan_id
       WHERE o.score IS DISTINCT FROM n.score OR kept <> '' OR dropped <> ''""",
)
def _(t):
    total = F.col("scan_id") + F.col("pos")
    fresh = t.cells.where(~((F.col("scan_id") % 10 == 0) & (F.col("pos") == 4))).select(
        "scan_id", "name", F.when(total % 6 == 0, "N").otherwise(F.col("value")).alias("value")
    )
    # The second entry of every third corrected sheet takes the correction back
    both = F.when(F.col("scan_id") % 15 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    log = t.corrections.withColumn("id", F.explode(both)).select(
        "scan_id", "name", "id", F.when(F.col("id") == 2, F.col("original_value")).otherwise(F.col("new_value")).alias("new_value")
    )
    changes = scoring.regrade(t.cells, log, fresh, t.key, scoring.answer_key(t.spark, _OTHER_KEY))
    return changes.withColumns({c: F.array_join(c, ",") for c in ("kept", "dropped")})


@query(
    "sc_preview",
    """SELECT band, COUNT(*) AS sheets, SUM(score) AS marks FROM (SELECT scan_id, score,
         CASE WHEN score >= 10 THEN 'high' WHEN score >= 5 THEN 'mid' WHEN score >= 0 THEN 'low' END AS band
         FROM (SELECT scan_id, SUM(CASE WHEN question <> 'q2' THEN delta WHEN marked = '' THEN 0
               WHEN marked = 'A' THEN 3 ELSE -1 END) AS score FROM f_graded GROUP BY 1) s) b GROUP BY band""",
)
def _(t):
    other = scoring.answer_key(t.spark, _OTHER_KEY)
    return (
        scoring.score_sheets(scoring.grade(t.cells, other))
        .groupBy("band")
        .agg(F.count("*").alias("sheets"), F.sum("score").alias("marks"))
    )


@query(
    "src_answer_key_sheet",
    """SELECT c.scan_id, COUNT(*) AS graded, SUM(CASE WHEN c.value = m.value THEN 3 WHEN c.value = '' THEN 0
       ELSE -1 END) AS score FROM f_cells c JOIN f_cells m ON m.name = c.name
       AND m.scan_id = (SELECT MIN(scan_id) FROM (SELECT scan_id, COUNT(*) FILTER (value <> '') AS n
         FROM f_cells GROUP BY 1) x WHERE n >= 5) AND m.value <> '' GROUP BY c.scan_id""",
)
def _(t):
    # The master is the first sheet with five or more answers; its key holds one sheet's rows
    full = t.cells.groupBy("scan_id").agg(F.count_if(F.col("value") != "").alias("n"))
    master = full.where("n >= 5").agg(F.min("scan_id").alias("m")).first()["m"]
    key = scoring.key_from_responses(t.cells, master, t.key)
    joined = t.cells.join(key, F.col("name") == F.col("question"))
    marks = (
        F.when(F.col("value") == F.col("answer"), 3).when(F.col("value") == "", 0).otherwise(-1)
    )
    return joined.groupBy("scan_id").agg(
        F.count("*").alias("graded"), F.sum(marks).cast("double").alias("score")
    )


@query(
    "sc_key_checks",
    """WITH a AS (SELECT DISTINCT name, pos, value FROM f_cells WHERE value <> ''), q AS (SELECT DISTINCT name FROM f_cells WHERE pos <> 6 UNION SELECT 'q99'),
       k AS (SELECT name, CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS section, value FROM a UNION ALL SELECT name, 'first', value FROM a WHERE pos = 1),
       s AS (SELECT DISTINCT CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS section, name FROM a UNION SELECT 'high', name FROM a WHERE pos > 4)
       SELECT name AS question, 'in several sections' AS problem FROM k GROUP BY 1 HAVING COUNT(DISTINCT section) > 1
       UNION ALL SELECT DISTINCT name, 'needs a multi-mark' FROM k WHERE LENGTH(value) > 1
       UNION ALL SELECT name, 'no answer' FROM q WHERE name NOT IN (SELECT name FROM k)
       UNION ALL SELECT DISTINCT name, 'not a question' FROM k WHERE name NOT IN (SELECT name FROM q)
       UNION ALL SELECT DISTINCT name, 'in a section but not a question' FROM s WHERE name NOT IN (SELECT name FROM q)
       UNION ALL SELECT name, 'in the schemes of several sections' FROM s GROUP BY 1 HAVING COUNT(DISTINCT section) > 1""",
)
def _(t):
    # Every answer given is a key candidate, the first question in two sections; the sixth is none of the questions
    given = t.cells.where("value <> ''").select("name", "pos", "value").distinct()
    parity = F.when(F.col("pos") % 2 == 0, "even").otherwise("odd")
    placed = given.withColumn("section", F.explode(F.when(F.col("pos") == 1, F.array(parity, F.lit("first"))).otherwise(F.array(parity))))
    pairs = F.map_from_entries(F.collect_set(F.struct("value", F.lit(1.0))))
    key = placed.groupBy(F.col("name").alias("question"), "section").agg(pairs.alias("answers"))
    both = F.when(F.col("pos") > 4, F.array(parity, F.lit("high"))).otherwise(F.array(parity))
    sections = given.select(F.col("name").alias("question"), F.explode(both).alias("section")).distinct()
    asked = t.cells.where("pos <> 6").select(F.col("name").alias("question")).distinct()
    asked = asked.unionByName(t.spark.createDataFrame([("q99",)], "question string"))
    return scoring.key_problems(asked, key, sections, filter_out_multi_marked=True)