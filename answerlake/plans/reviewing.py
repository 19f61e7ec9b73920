"""Review, correction, audit and export-projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlake.functions import text as tx
from answerlake.functions import values as vl
from answerlake.operators import export, listing, review, scoring
from answerlake.operators import rules as rl
from answerlake.plans.derived import OPTIONS, VIEWS, Tables
from answerlake.plans.grading import graded
from answerlake.plans.index import OPEN
from answerlake.plans.registry import query
from answerlake.plans.ruling import CHAIN, ROLL, chain, sheets
from answerlake.plans.ruling import GROUP as ROLL_GROUP
from answerlake.plans.scalars import columns, paths

NAMES = [f"q{i}" for i in range(1, 8)]
GROUP = {"roll": ["q1", "q2", "q3"]}


def readings(t: Tables):
    flags = F.filter(F.array("flag"), lambda f: f != "")
    return t.cells.select(
        "scan_id",
        "name",
        F.when(F.col("pos") == 1, "zone").otherwise("field").alias("kind"),
        "value",
        "confidence",
        flags.alias("flags"),
        (F.col("needs_review") == 1).alias("needs_review"),
    )


def edited(t: Tables):
    """Readings with their first value kept, after the derived corrections."""
    edits = t.corrections.select("scan_id", "name", "new_value")
    joined = readings(t).join(edits, ["scan_id", "name"], "left")
    changed = F.col("new_value") != F.col("value")
    return joined.withColumn("original_value", F.when(changed, F.col("value"))).withColumn(
        "value", F.coalesce("new_value", "value")
    )


VIEWS["f_edited"] = """SELECT c.scan_id, c.pos, c.name, COALESCE(k.new_value, c.value) AS value, CASE WHEN k.new_value <> c.value THEN c.value END AS original_value, c.confidence, c.flag, c.needs_review
  FROM f_cells c LEFT JOIN f_corrections k ON k.scan_id = c.scan_id AND k.name = c.name"""


# ---- projections --------------------------------------------------------------------------


@query(
    "prj_flag_rows",
    """SELECT scan_id, name, CASE WHEN flag = '' THEN 'needs_review' ELSE flag END AS flag FROM f_cells WHERE needs_review = 1 OR pos = 3
       UNION SELECT scan_id, 'final', UNNEST(string_split(flags, ',')) FROM f_final WHERE flags <> ''""",
)
def _(t):
    items = readings(t).where("needs_review OR name = 'q3'").select("scan_id", "name", "flags")
    return listing.flag_rows(items, chain(t).checks().where("name = 'final'"))


@query(
    "prj_primary_key",
    """SELECT s.scan_id, CASE WHEN s.status <> 'error' AND k.a <> '' AND k.b <> '' AND k.f = 0 THEN k.a || chr(31) || k.b END AS joined_key FROM f_scans s LEFT JOIN
       (SELECT scan_id, MAX(value) FILTER (name = 'q1') AS a, MAX(value) FILTER (name = 'q2') AS b, MAX(needs_review) AS f FROM f_cells WHERE name IN ('q1', 'q2') GROUP BY 1) k ON k.scan_id = s.scan_id""",
)
def _(t):
    return listing.primary_keys(t.cells, t.scans, ["q1", "q2"])


@query("prj_is_corrected", "SELECT scan_id, BOOL_OR(original_value IS NOT NULL) AS corrected FROM f_edited GROUP BY 1")
def _(t):
    changed = F.coalesce(F.col("original_value") != F.col("value"), F.lit(False))
    return edited(t).groupBy("scan_id").agg(F.bool_or(changed).alias("corrected"))


@query("prj_original_value", "SELECT scan_id, name, COALESCE(original_value, value) AS original FROM f_edited")
def _(t):
    return edited(t).select("scan_id", "name", F.coalesce("original_value", "value").alias("original"))


VIEWS["f_status"] = """SELECT scan_id, CASE WHEN verified = 1 THEN 'verified' WHEN status = 'error' THEN 'error' WHEN review_count > 0 THEN 'needs_review' WHEN flag_count > 0 THEN 'reviewed' ELSE 'auto' END AS review_status FROM f_scans"""


@query("prj_review_status", "SELECT scan_id, review_status FROM f_status")
def _(t):
    return export.with_review_status(t.scans).select("scan_id", "review_status")


@query(
    "prj_sheet_status",
    "SELECT scan_id, CASE WHEN status = 'error' THEN 'error' WHEN scan_id IN (SELECT scan_id FROM f_review WHERE state = 'pending') THEN 'needs_review' ELSE 'ok' END AS status FROM f_scans",
)
def _(t):
    return listing.sheet_status(t.scans, t.review)


@query(
    "prj_current_value",
    """SELECT n.scan_id, n.name, COALESCE(e.value, c.value, '') AS value FROM (SELECT scan_id, name FROM f_flags UNION ALL SELECT scan_id, 'final' FROM f_wide) n
       LEFT JOIN f_edited e ON e.scan_id = n.scan_id AND e.name = n.name LEFT JOIN (SELECT scan_id, 'final' AS name, value FROM f_final) c ON c.scan_id = n.scan_id AND c.name = n.name""",
)
def _(t):
    checks = chain(t).checks().where("name = 'final'").select("scan_id", "name", F.col("value").alias("check_value"))
    wanted = t.flags.select("scan_id", "name").unionByName(
        t.cells.select("scan_id", F.lit("final").alias("name")).distinct()
    )
    keys = ["scan_id", "name"]
    now = edited(t).select("scan_id", "name", "value")
    return wanted.join(now, keys, "left").join(checks, keys, "left").select(
        "scan_id", "name", F.coalesce("value", "check_value", F.lit("")).alias("value")
    )


PROFILE = export.Profile(
    meta=("scan_id", "status", "score"),
    fields=(
        {"field": "q2", "header": "Answer 2"},
        {"field": "roll", "header": "roll", "type": "text"},
        {"field": "q4", "header": "roll", "type": "bool", "true": ["A"], "false": ["", "N"]},
        {"field": "q9"},
    ),
    include_others=True,
    review_status=True,
    confidence=True,
)


def export_names():
    return export.output_columns(NAMES, GROUP, ["final"])


@query(
    "prj_column_plan",
    """SELECT s.scan_id, s.status, s.score, t.review_status, e.q2 AS "Answer 2", e.roll, CASE WHEN e.q4 = 'A' THEN TRUE WHEN e.q4 IN ('', 'N') THEN FALSE END AS roll_2, NULL AS q9, e.q5, e.q6, e.q7, e.c5 AS q5_confidence,
       CASE WHEN e.q4 NOT IN ('A', '', 'N') THEN 'roll_2: not a yes/no value' ELSE '' END AS cast_errors FROM f_scans s JOIN f_status t ON t.scan_id = s.scan_id LEFT JOIN
       (SELECT scan_id, NULL AS q2, STRING_AGG(value, '' ORDER BY pos) FILTER (pos <= 3) AS roll, MAX(value) FILTER (pos = 4) AS q4, MAX(value) FILTER (pos = 5) AS q5, MAX(confidence) FILTER (pos = 5) AS c5,
        MAX(value) FILTER (pos = 6) AS q6, MAX(value) FILTER (pos = 7) AS q7 FROM f_edited GROUP BY 1) e ON e.scan_id = s.scan_id""",
)
def _(t):
    plan, _ = export.plan(PROFILE, export_names(), GROUP)
    rows = export.build(export.with_review_status(t.scans), export.items(edited(t), t.review, GROUP), plan)
    return rows.select(
        "scan_id", "status", "score", "review_status", "Answer 2", "roll", "roll_2", "q9", "q5", "q6", "q7", "q5_confidence",
        F.array_join("cast_errors", "; ").alias("cast_errors"),
    )


@query(
    "prj_export_item",
    """SELECT e.scan_id, STRING_AGG(e.value, '' ORDER BY e.pos) AS value, MIN(e.confidence) AS confidence, COALESCE(STRING_AGG(DISTINCT NULLIF(e.flag, ''), ',' ORDER BY NULLIF(e.flag, '')), '') AS flags,
       BOOL_OR(r.scan_id IS NOT NULL) AS pending, BOOL_OR(e.original_value IS NOT NULL) AS corrected FROM f_edited e LEFT JOIN f_review r ON r.scan_id = e.scan_id AND r.name = e.name AND r.state = 'pending'
       WHERE e.pos <= 3 GROUP BY e.scan_id""",
)
def _(t):
    rows = export.items(edited(t), t.review, GROUP).where("output = 'roll'")
    return rows.select("scan_id", "value", "confidence", F.array_join("flags", ",").alias("flags"), "pending", "corrected")


@query(
    "prj_export_meta",
    """SELECT s.scan_id, s.scan_id % 3 + 1 AS page, CASE WHEN s.verified = 1 THEN 'u' || (s.scan_id % 6) END AS verified_by, COALESCE(CASE WHEN s.scan_id % 2 = 0 THEN s.file_name END, 'in/' || s.scan_id) AS source_path,
       x.default_score, x.band FROM f_scans s LEFT JOIN (SELECT scan_id, SUM(delta) FILTER (section = 'DEFAULT') AS default_score, CASE WHEN SUM(delta) >= 10 THEN 'high' WHEN SUM(delta) >= 5 THEN 'mid' WHEN SUM(delta) >= 0 THEN 'low' END AS band
       FROM f_graded GROUP BY 1) x ON x.scan_id = s.scan_id""",
)
def _(t):
    scan = F.col("scan_id")
    sections = graded(t).groupBy("scan_id").agg(
        F.sum(F.when(F.col("section") == "DEFAULT", F.col("delta"))).alias("default_score"),
        scoring.band_of(F.sum("delta")).alias("band"),
    )
    rows = t.scans.withColumns(
        {
            "page": scan % 3,
            "source_path": F.when(scan % 2 == 0, F.col("file_name")),
            "input_path": F.concat(F.lit("in/"), scan.cast("string")),
            "verified_by": F.when(F.col("verified") == 1, F.concat(F.lit("u"), (scan % 6).cast("string"))),
        }
    )
    return export.meta(rows).join(sections, "scan_id", "left").select(
        "scan_id", "page", "verified_by", "source_path", "default_score", "band"
    )


@query(
    "prj_output_columns",
    """SELECT name, ROW_NUMBER() OVER (ORDER BY place) AS place FROM (SELECT DISTINCT name, pos AS place FROM f_cells WHERE pos > 3 UNION ALL SELECT 'roll', 8 UNION ALL SELECT 'final', 9) x""",
)
def _(t):
    from pyspark.sql import Window

    # Distinct names only: as many rows as the template has fields
    base = t.cells.select("name").distinct().where(~F.col("name").isin(GROUP["roll"]))
    names = base.select("name", F.lit(0).alias("part")).unionByName(
        t.spark.range(1).select(F.explode(F.array(F.struct(F.lit("roll").alias("name"), F.lit(0).alias("part")), F.struct(F.lit("final").alias("name"), F.lit(1).alias("part")))).alias("r")).select("r.*")
    )
    order = Window.orderBy("part", tx.natural_key(F.col("name")))
    return names.select("name", F.row_number().over(order).alias("place"))


@query(
    "prj_field_union",
    """SELECT name, MIN(place) AS first_place FROM (SELECT c.name, CAST(SUBSTR(s.template_id, 1, 1) AS INTEGER) * 100 + c.pos AS place FROM f_cells c JOIN f_scans s ON s.scan_id = c.scan_id) x GROUP BY 1""",
)
def _(t):
    place = F.substring("template_id", 1, 1).cast("int") * 100 + F.col("pos")
    rows = t.cells.select("scan_id", "name", "pos").join(t.scans.select("scan_id", "template_id"), "scan_id")
    return rows.groupBy("name").agg(F.min(place).alias("first_place"))


@query(
    "prj_summary",
    """SELECT s.scan_id, s.status, COUNT(c.name) AS fields, COUNT(c.name) FILTER (c.flag <> '') AS flag_count, COUNT(c.name) FILTER (c.needs_review = 1) AS review_count,
       COALESCE(BOOL_OR(c.original_value IS NOT NULL), FALSE) AS corrected FROM f_scans s LEFT JOIN f_edited c ON c.scan_id = s.scan_id GROUP BY 1, 2""",
)
def _(t):
    own = edited(t).groupBy("scan_id").agg(
        F.count("*").alias("fields"),
        F.count_if(F.size("flags") > 0).alias("flag_count"),
        F.count_if("needs_review").alias("review_count"),
        F.bool_or(F.col("original_value").isNotNull()).alias("corrected"),
    )
    rows = t.scans.select("scan_id", "status").join(own, "scan_id", "left")
    return rows.fillna(0, ["fields", "flag_count", "review_count"]).fillna(False, ["corrected"])


@query(
    "prj_overlay_flags",
    """SELECT scan_id, name, STRING_AGG(DISTINCT reason, ', ' ORDER BY reason) AS reasons FROM (SELECT scan_id, name, 'all: ' || state AS reason FROM f_columns WHERE state = 'issue' OR (state = 'multi' AND needs_review = 1)
       UNION ALL SELECT f.scan_id, f.name, f.name || ': ' || f.flag FROM f_flags f JOIN f_review r ON r.scan_id = f.scan_id AND r.name = f.name AND r.state = 'pending') x
       WHERE NOT EXISTS (SELECT 1 FROM f_corrections k WHERE k.scan_id = x.scan_id AND k.name = x.name) GROUP BY 1, 2""",
)
def _(t):
    bad = (F.col("state") == "issue") | ((F.col("state") == "multi") & (F.col("needs_review") == 1))
    grouped = columns(t).where(bad).select("scan_id", "name", F.concat(F.lit("all: "), "state").alias("reason"))
    waiting = listing.pending(t.review).select("scan_id", "name")
    own = t.flags.join(waiting, ["scan_id", "name"]).select(
        "scan_id", "name", F.concat_ws(": ", "name", "flag").alias("reason")
    )
    rows = grouped.unionByName(own).join(t.corrections.select("scan_id", "name"), ["scan_id", "name"], "left_anti")
    return rows.groupBy("scan_id", "name").agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reasons"))


@query(
    "prj_remap_path",
    r"""SELECT scan_id, CASE WHEN path LIKE 'batch/%' THEN '/mnt/new/' || SUBSTR(path, 7) WHEN LOWER(path) LIKE 'c:\\in\\%' THEN '/data/in/' || SUBSTR(path, 7) WHEN path LIKE 'scans/2024/%' THEN 'D:\old\' || REPLACE(SUBSTR(path, 12), '/', '\')
       ELSE path END AS path FROM f_paths""".replace("\\\\", "\\"),
)
def _(t):
    rules = [("batch", "/mnt/new/"), ("c:\\IN\\", "/data/in"), ("scans/2024", "D:\\old"), ("scans/20", "/never")]
    return paths(t).select("scan_id", tx.remap_path(F.col("path"), rules).alias("path"))


# ---- reads compared -----------------------------------------------------------------------

VIEWS["f_fresh"] = """SELECT scan_id, pos, name, CASE WHEN (scan_id + pos) % 6 = 0 THEN 'N' ELSE value END AS value, CASE WHEN (scan_id + pos) % 10 = 0 THEN 'weak_mark' ELSE flag END AS flag FROM f_cells"""


def fresh(t: Tables):
    total = F.col("scan_id") + F.col("pos")
    flag = F.when(total % 10 == 0, "weak_mark").otherwise(F.col("flag"))
    return t.cells.select(
        "scan_id",
        "name",
        F.when(total % 6 == 0, "N").otherwise(F.col("value")).alias("value"),
        F.filter(F.array(flag), lambda f: f != "").alias("flags"),
    )


@query("jn_diff_reads", "SELECT f.scan_id, f.name, c.value AS before, f.value AS after FROM f_fresh f JOIN f_cells c ON c.scan_id = f.scan_id AND c.name = f.name WHERE c.value <> f.value OR c.flag <> f.flag")
def _(t):
    return review.diff_reads(readings(t), fresh(t))


@query("jn_drift", "SELECT f.scan_id, f.name, c.value AS first_value, f.value FROM f_fresh f JOIN f_cells c ON c.scan_id = f.scan_id AND c.name = f.name WHERE c.value <> f.value")
def _(t):
    return review.drift(readings(t), fresh(t))


@query(
    "jn_reapply_corrections",
    """SELECT f.scan_id, f.name, COALESCE(k.new_value, f.value) AS value, CASE WHEN f.value <> k.new_value THEN f.value END AS original_value, k.scan_id IS NOT NULL AS reviewed,
       (SELECT COUNT(*) FROM f_review r WHERE r.scan_id = f.scan_id AND r.name = f.name AND k.scan_id IS NULL) AS waiting FROM f_fresh f
       LEFT JOIN (SELECT * FROM f_corrections WHERE original_value <> new_value) k ON k.scan_id = f.scan_id AND k.name = f.name""",
)
def _(t):
    rows, left = review.reapply_corrections(fresh(t), t.review, t.corrections)
    waiting = left.groupBy("scan_id", "name").agg(F.count("*").alias("waiting"))
    return rows.join(waiting, ["scan_id", "name"], "left").fillna(0, ["waiting"])


@query("jn_review_states", "SELECT f.scan_id, f.name, COALESCE(r.state, 'gone') AS state FROM f_flags f LEFT JOIN f_review r ON r.scan_id = f.scan_id AND r.name = f.name")
def _(t):
    return review.review_states(t.flags.select("scan_id", "name"), t.review)


_OPTION = "opt || ':' || CASE WHEN marked = 1 THEN 'x' ELSE '' END || ':' || CAST(ROUND(fill_ratio * 100) AS INT)"


@query(
    "jn_review_detail",
    f"""SELECT r.scan_id, r.name, r.kind, c.value, c.confidence, c.flag AS flags, (SELECT STRING_AGG(opt, '' ORDER BY opt_pos) FROM f_bubbles b WHERE b.scan_id = r.scan_id AND b.name = r.name) AS options, NULL AS check_value,
       (SELECT STRING_AGG({_OPTION}, ',' ORDER BY opt_pos) FROM f_bubbles b WHERE b.scan_id = r.scan_id AND b.name = r.name) AS bubbles,
       CASE WHEN r.name = 'q1' THEN CASE WHEN c.value IN ('', 'A', 'AN', 'N') THEN '' ELSE 'not an allowed value' END END AS reasons, NULL AS candidates, NULL AS group_states
       FROM f_review r JOIN f_cells c ON c.scan_id = r.scan_id AND c.name = r.name WHERE r.state = 'pending'
       UNION ALL SELECT f.scan_id, 'final', 'check', NULL, NULL, f.flags, NULL, f.value, NULL, '', CONCAT_WS(',', CASE WHEN a.value <> '' THEN 'ans=' || a.value END, CASE WHEN w.v4 <> '' THEN 'q4=' || w.v4 END), NULL
       FROM f_final f JOIN f_ans a ON a.scan_id = f.scan_id JOIN f_wide w ON w.scan_id = f.scan_id WHERE f.needs_review
       UNION ALL SELECT a.scan_id, 'ans', 'check', NULL, NULL, 'all_sources_missing', NULL, a.value, NULL, '', COALESCE((SELECT STRING_AGG(source || '=' || raw, ',' ORDER BY place) FROM f_src s WHERE s.scan_id = a.scan_id AND raw <> ''), ''), NULL
       FROM f_ans a WHERE a.nothing
       UNION ALL SELECT l.scan_id, 'roll', 'custom_label', l.value, NULL, 'validation_failed', NULL, NULL, NULL, l.reasons, NULL, COALESCE((SELECT STRING_AGG(name || '=' || state, ',' ORDER BY pos) FROM f_columns k WHERE k.scan_id = l.scan_id AND pos <= 5), '')
       FROM f_roll l WHERE l.reasons <> ''""",
)
def _(t):
    run = rl.Run(sheets(t), rl.Rules([*CHAIN.validations, ROLL], CHAIN.checks, ROLL_GROUP), NAMES)
    states = run.column_states("roll", lambda *read: vl.column_state(*read, F.col("scan_id") % 7 == 0))
    rules = run.details({"roll": states})
    # Items of the rules wait beside those of the index
    rows = review.review_details(listing.pending(t.review), readings(t), t.bubbles, rules).unionByName(review.rule_details(rules))
    bubble = lambda b: F.concat(b["opt"], F.lit(":"), F.when(b["marked"], "x").otherwise(""), F.lit(":"), F.round(b["fill_ratio"] * 100).cast("int").cast("string"))
    return rows.select(
        "scan_id",
        "name",
        "kind",
        "value",
        "confidence",
        F.array_join("flags", ",").alias("flags"),
        F.array_join("options.opt", "").alias("options"),
        "check_value",
        F.array_join(F.transform("options", bubble), ",").alias("bubbles"),
        F.array_join("reasons", "; ").alias("reasons"),
        F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["source"], c["value"])), ",").alias("candidates"),
        F.array_join(F.transform("group", lambda g: F.concat_ws("=", g["column"], g["state"])), ",").alias("group_states"),
    )


# ---- edits --------------------------------------------------------------------------------

# Decisions of a round: wrong labels on some, acceptance of others, the derived corrections else.
VIEWS["f_decisions"] = """SELECT scan_id, name, CASE WHEN scan_id % 3 = 0 THEN NULL WHEN scan_id % 7 = 0 THEN 'Z' ELSE new_value END AS label, reviewer FROM f_corrections"""
VIEWS["f_events"] = """SELECT d.scan_id, d.name, CASE WHEN c.pos = 1 THEN 'zone' ELSE 'field' END AS kind, c.value AS predicted, COALESCE(d.label, c.value) AS label, CASE WHEN d.label = 'Z' AND c.pos <> 1 THEN 'refused'
  WHEN COALESCE(d.label, c.value) <> c.value THEN 'corrected' ELSE 'accepted' END AS action, c.value AS original, d.reviewer FROM f_decisions d JOIN f_cells c ON c.scan_id = d.scan_id AND c.name = d.name"""


def decisions(t: Tables):
    scan = F.col("scan_id")
    label = F.when(scan % 3 == 0, None).when(scan % 7 == 0, "Z").otherwise(F.col("new_value"))
    return t.corrections.select("scan_id", "name", label.alias("label"), "reviewer")


def applied(t: Tables):
    return review.apply_decisions(readings(t), decisions(t), OPTIONS)


@query(
    "rv_apply",
    """SELECT c.scan_id, c.name, CASE WHEN e.action IN ('corrected', 'accepted') THEN e.label ELSE c.value END AS value, CASE WHEN e.action = 'corrected' THEN c.value END AS original_value,
       c.needs_review = 1 AND COALESCE(e.action, 'refused') = 'refused' AS needs_review, COALESCE(e.action <> 'refused', FALSE) AS reviewed FROM f_cells c LEFT JOIN f_events e ON e.scan_id = c.scan_id AND e.name = c.name""",
)
def _(t):
    after, _ = applied(t)
    return after.select("scan_id", "name", "value", "original_value", "needs_review", "reviewed")


@query("rv_events", "SELECT scan_id, name, kind, predicted, label, action, reviewer FROM f_events")
def _(t):
    _, events = applied(t)
    return events.drop("original")


@query("rv_audit", """SELECT scan_id, name, kind, predicted AS old, label AS new, original, reviewer, 'review' AS source FROM f_events WHERE action = 'corrected'""")
def _(t):
    _, events = applied(t)
    return review.audit_rows(events)


@query(
    "rv_recompute",
    """WITH v AS (SELECT c.scan_id, c.name, CASE WHEN e.action IN ('corrected', 'accepted') THEN e.label ELSE c.value END AS value, c.needs_review = 1 AND COALESCE(e.action, 'refused') = 'refused' AS waits FROM f_cells c LEFT JOIN f_events e ON e.scan_id = c.scan_id AND e.name = c.name
         WHERE c.scan_id IN (SELECT scan_id FROM f_events))
       SELECT v.scan_id, SUM(CASE WHEN v.value = '' THEN q.unmarked WHEN a.answer IS NULL THEN q.incorrect ELSE a.marks END) AS score, CASE WHEN BOOL_OR(v.waits) THEN 'needs_review' ELSE 'ok' END AS status
       FROM v JOIN f_keyq q ON q.question = v.name LEFT JOIN f_key a ON a.question = v.name AND a.answer = v.value GROUP BY 1""",
)
def _(t):
    after, events = applied(t)
    touched = after.join(events.select("scan_id"), "scan_id", "left_semi")
    scores = scoring.score_sheets(scoring.grade(touched, t.key)).select("scan_id", "score")
    status = touched.groupBy("scan_id").agg(
        F.when(F.bool_or("needs_review"), "needs_review").otherwise("ok").alias("status")
    )
    return scores.join(status, "scan_id")


@query(
    "rv_manual_checks",
    """SELECT f.scan_id, CASE WHEN f.scan_id % 4 = 0 THEN 'T' ELSE f.value END AS value, CASE WHEN f.scan_id % 4 = 0 THEN f.value END AS original_value, f.scan_id % 4 = 0 AS manual, f.needs_review AND f.scan_id % 4 <> 0 AS needs_review FROM f_final f""",
)
def _(t):
    checks = chain(t).checks().where("name = 'final'").select("scan_id", "name", "value", "needs_review")
    typed = checks.where("scan_id % 4 = 0").select("scan_id", "name", F.lit("T").alias("typed"))
    return review.manual_checks(checks, typed).drop("name")


@query(
    "rv_honour",
    "SELECT r.scan_id, r.name, r.state FROM f_review r WHERE NOT EXISTS (SELECT 1 FROM f_corrections k JOIN f_fresh f ON f.scan_id = k.scan_id AND f.name = k.name AND f.value = k.new_value WHERE k.scan_id = r.scan_id AND k.name = r.name)",
)
def _(t):
    log = t.corrections.select("scan_id", "name", F.col("new_value").alias("label"))
    return review.honour(t.review, log, fresh(t)).select("scan_id", "name", "state")


@query(
    "rv_bulk_accept",
    "SELECT scan_id, name FROM f_review WHERE state = 'pending' AND kind = 'field' ORDER BY created_at, scan_id, name LIMIT 500",
)
def _(t):
    return review.bulk_accept(listing.pending(t.review, kind="field"), 500).select("scan_id", "name")


@query(
    "rv_verify",
    """SELECT s.scan_id, CASE WHEN s.verified = 1 OR s.job_id = 7 THEN 1 ELSE 0 END AS verified, CASE WHEN s.job_id = 7 THEN 'boss' END AS verified_by, CASE WHEN s.job_id = 7 THEN (SELECT COUNT(*) FROM f_review r WHERE r.scan_id = s.scan_id AND r.state = 'pending') ELSE 0 END AS accepted FROM f_scans s""",
)
def _(t):
    who = t.scans.where("job_id = 7").select("scan_id", F.lit("boss").alias("reviewer"))
    after, accepts = review.verify(t.scans, who, t.review)
    counts = accepts.groupBy("scan_id").agg(F.count("*").alias("accepted"))
    return after.join(counts, "scan_id", "left").fillna(0, ["accepted"]).select("scan_id", "verified", "verified_by", "accepted")


@query("rv_unverify", "SELECT scan_id, CASE WHEN job_id = 7 THEN 0 ELSE verified END AS verified, CASE WHEN job_id = 7 THEN 0 ELSE approved END AS approved FROM f_scans")
def _(t):
    back = F.col("job_id") == 7
    return t.scans.select(
        "scan_id",
        F.when(back, 0).otherwise(F.col("verified")).alias("verified"),
        F.when(back, 0).otherwise(F.col("approved")).alias("approved"),
    )


@query(
    "rv_approve",
    """SELECT scan_id, MAX(id) FILTER (action = 'approved') AS approved_id, MAX(id) FILTER (action IN ('correction', 'returned')) AS edited_id FROM f_activity GROUP BY 1
       HAVING MAX(id) FILTER (action = 'approved') > COALESCE(MAX(id) FILTER (action IN ('correction', 'returned')), -1)""",
)
def _(t):
    return review.approvals(t.activity, ("correction", "returned"))


@query(
    "rv_return",
    """WITH s AS (SELECT DISTINCT scan_id FROM f_activity WHERE action = 'returned'), m AS (SELECT scan_id, name, flag FROM f_flags WHERE scan_id IN (SELECT scan_id FROM s))
       SELECT * FROM m UNION ALL SELECT DISTINCT k.scan_id, k.name, 'sent_back' FROM (SELECT scan_id, name FROM f_fresh WHERE (scan_id + pos) % 6 = 0) k WHERE k.scan_id IN (SELECT scan_id FROM s) AND NOT EXISTS (SELECT 1 FROM m WHERE m.scan_id = k.scan_id AND m.name = k.name)""",
)
def _(t):
    back = listing.returned_scans(t.activity)
    changed = t.cells.where("(scan_id + pos) % 6 = 0").select("scan_id", "name")
    return review.send_back(back, t.flags, changed)


@query(
    "rv_manual_values",
    """SELECT 'value' AS what, COALESCE(c.scan_id, m.scan_id) AS scan_id, COALESCE(c.name, m.name) AS name, COALESCE(m.typed, c.value) AS value FROM f_cells c FULL JOIN (SELECT scan_id, 'q1' AS name, 'M' AS typed FROM f_scans WHERE status = 'error' AND scan_id % 2 = 0) m ON m.scan_id = c.scan_id AND m.name = c.name
       UNION ALL SELECT 'status', scan_id, '', CASE WHEN status = 'error' AND scan_id % 2 = 0 THEN 'ok' ELSE status END FROM f_scans""",
)
def _(t):
    typed = t.scans.where("status = 'error' AND scan_id % 2 = 0").select(
        "scan_id", F.lit("q1").alias("name"), F.lit("M").alias("typed")
    )
    responses, sheets = review.manual_values(t.cells, t.scans, typed)
    return responses.select(F.lit("value").alias("what"), "scan_id", "name", "value").unionByName(
        sheets.select(F.lit("status").alias("what"), "scan_id", F.lit("").alias("name"), F.col("status").alias("value"))
    )


@query(
    "rv_sync_queue",
    "SELECT COALESCE(r.scan_id, f.scan_id) AS scan_id, COALESCE(r.name, f.name) AS name, CASE WHEN f.scan_id IS NULL THEN 'done' ELSE 'pending' END AS state, r.state AS old_state FROM f_review r FULL JOIN (SELECT scan_id, name FROM f_fresh WHERE flag NOT IN ('', 'empty')) f ON f.scan_id = r.scan_id AND f.name = r.name",
)
def _(t):
    listed = fresh(t).where("size(array_remove(flags, 'empty')) > 0").select("scan_id", "name")
    return review.sync_queue(t.review, listed)


_STATE = f"SELECT a.*, {OPEN} AS open FROM f_assign a JOIN f_scans s ON s.scan_id = a.scan_id"


@query("rv_move", f"SELECT scan_id, CASE WHEN reviewer = 'u2' AND open THEN 'u9' ELSE reviewer END AS reviewer FROM ({_STATE}) a")
def _(t):
    return review.move(t.assign, t.scans, "u2", "u9", listing.is_open()).select("scan_id", "reviewer")


@query("rv_clear", f"SELECT scan_id, reviewer FROM ({_STATE}) a WHERE NOT (reviewer = 'u3' AND open)")
def _(t):
    return review.move(t.assign, t.scans, "u3", None, listing.is_open()).select("scan_id", "reviewer")


@query(
    "rv_assign",
    """SELECT scan_id, 'p' || NTILE(3) OVER (ORDER BY scan_id) AS reviewer FROM f_scans WHERE scan_id NOT IN (SELECT scan_id FROM f_assign)
       UNION ALL SELECT scan_id, reviewer FROM f_assign""",
)
def _(t):
    free = listing.where_results(t.scans, assignments=t.assign, assigned="unassigned").select("scan_id")
    new = listing.even_split(free, ["p1", "p2", "p3"]).select("scan_id", "reviewer")
    return listing.upsert(t.assign.select("scan_id", "reviewer"), new, ["scan_id"])


@query(
    "rv_undo",
    """WITH RECURSIVE l AS (SELECT event_id % 1500 AS scan_id, event_id AS id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'edit' END AS action,
         ROW_NUMBER() OVER (PARTITION BY event_id % 1500 ORDER BY event_id) AS i FROM events WHERE event_type IN ('click', 'signup', 'error', 'view')),
       s AS (SELECT DISTINCT scan_id, 0::BIGINT AS i, [0::BIGINT] AS v, 0 AS c FROM l
         UNION ALL SELECT l.scan_id, l.i, CASE WHEN action = 'edit' THEN list_append(v[GREATEST(c - 18, 1) : c + 1], l.id) ELSE v END,
           CASE action WHEN 'edit' THEN LEAST(c + 1, 20) WHEN 'undo' THEN GREATEST(c - 1, 0) ELSE LEAST(c + 1, len(v) - 1) END FROM s JOIN l ON l.scan_id = s.scan_id AND l.i = s.i + 1)
       SELECT scan_id, v[c + 1] AS version, CAST(c AS INTEGER) AS undo_steps, CAST(len(v) - 1 - c AS INTEGER) AS redo_steps FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY i DESC) = 1""",
)
def _(t):
    action = (
        F.when(F.col("event_type").isin("click", "signup"), "edit")
        .when(F.col("event_type") == "error", "undo")
        .when(F.col("event_type") == "view", "redo")
    )
    log = t.raw("events").select((F.col("event_id") % 1500).alias("scan_id"), F.col("event_id").alias("id"), action.alias("action"))
    return review.current_versions(log.where("action IS NOT NULL"))
