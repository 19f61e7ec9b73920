"""Listing, queue, facet, assignment and activity queries over the results index."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlake.functions import text as tx
from answerlake.operators import listing, ranking
from answerlake.plans.derived import VIEWS, Tables
from answerlake.plans.registry import query

SETTLED = "(flag_count > 0 AND review_count = 0)"
OPEN = f"(verified = 0 AND NOT {SETTLED})"
WHERE = {
    "flagged": "flag_count > 0 AND verified = 0",
    "unflagged": "flag_count = 0 OR verified = 1",
    "reviewed": f"verified = 1 OR {SETTLED}",
    "not_reviewed": OPEN,
    "approved": "approved = 1",
    "corrected": "corrected = 1",
}
VIEWS["f_dup"] = """SELECT s.* FROM f_scans s JOIN (SELECT job_id, primary_key FROM f_scans WHERE primary_key IS NOT NULL
  GROUP BY 1, 2 HAVING COUNT(*) > 1) k ON k.job_id = s.job_id AND k.primary_key = s.primary_key"""
_MICROS = "EPOCH_US({0})"


def micros(column):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def day(column):
    return F.date_format(F.col(column).cast("date"), "yyyy-MM-dd")


@query("flt_equal", "SELECT scan_id, job_id, status FROM f_scans WHERE template_id = '1-URGENT' AND status = 'ok'")
def _(t):
    return listing.equal(t.scans, template_id="1-URGENT", status="ok", job_id=None).select("scan_id", "job_id", "status")


@query(
    "flt_views",
    "SELECT view, scan_id FROM ("
    + " UNION ALL ".join(f"SELECT '{v}' AS view, scan_id FROM f_scans WHERE {w}" for v, w in WHERE.items())
    + " UNION ALL SELECT 'verified', scan_id FROM f_scans WHERE verified = 1 UNION ALL SELECT 'errors', scan_id FROM f_scans WHERE status = 'error') v",
)
def _(t):
    # One pass: each row lists the views it is in
    names = ("flagged", "unflagged", "reviewed", "not_reviewed", "approved", "corrected", "verified", "errors")
    member = F.array_compact(F.array(*[F.when(listing.view(v), v) for v in names]))
    return t.scans.select(F.explode(member).alias("view"), "scan_id")


@query(
    "flt_result_where",
    f"""SELECT scan_id, file_name, status FROM f_scans WHERE template_id = '2-HIGH' AND {OPEN} AND LOWER(file_name) LIKE '%s0%'
       AND scan_id IN (SELECT scan_id FROM f_flags WHERE flag = 'multi_marked') AND scan_id IN (SELECT scan_id FROM f_assign WHERE reviewer = 'u2')""",
)
def _(t):
    return listing.where_results(
        t.scans,
        t.flags,
        t.assign,
        view_name="not_reviewed",
        flag="multi_marked",
        file="S0",
        assigned="u2",
        template_id="2-HIGH",
    ).select("scan_id", "file_name", "status")


@query("flt_file_like", "SELECT scan_id, file_name FROM f_scans WHERE CONTAINS(LOWER(file_name), 's0001')")
def _(t):
    return t.scans.where(listing.file_contains("S0001")).select("scan_id", "file_name")


@query(
    "flt_time_window",
    """SELECT scan_id, name FROM f_review WHERE state = 'pending' AND created_at > TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-01-01'""",
)
def _(t):
    window = listing.pending(
        t.review, after=F.expr("timestamp_ntz'1996-01-01'"), before=F.expr("timestamp_ntz'1999-01-01'")
    )
    return window.select("scan_id", "name")


_PLACED = "SELECT *, ROW_NUMBER() OVER (ORDER BY scan_id) AS place FROM f_scans"


@query(
    "flt_pairs_in_range",
    f"""SELECT scan_id, place, CASE WHEN place BETWEEN 11 AND 300 THEN 'ann' ELSE 'bo' END AS reviewer
       FROM ({_PLACED}) p WHERE place BETWEEN 11 AND 300 OR place BETWEEN 301 AND 450""",
)
def _(t):
    return listing.ranges(t.scans, [("bo", 301, 450), ("ann", 11, 300)]).select("scan_id", "place", "reviewer")


# ---- semi, anti and duplicate joins -------------------------------------------------------


@query("jn_flag_semi", "SELECT scan_id, status FROM f_scans WHERE scan_id IN (SELECT scan_id FROM f_flags WHERE flag = 'low_confidence' AND name = 'q3')")
def _(t):
    return listing.where_results(t.scans, t.flags, name="q3", flag="low_confidence").select("scan_id", "status")


@query(
    "jn_unassigned_anti",
    """SELECT scan_id, 'nobody' AS held FROM f_scans WHERE scan_id NOT IN (SELECT scan_id FROM f_assign)
       UNION ALL SELECT scan_id, 'u3' FROM f_scans WHERE scan_id IN (SELECT scan_id FROM f_assign WHERE reviewer = 'u3')""",
)
def _(t):
    free = listing.where_results(t.scans, assignments=t.assign, assigned="unassigned")
    held = listing.where_results(t.scans, assignments=t.assign, assigned="u3")
    return free.select("scan_id", F.lit("nobody").alias("held")).unionByName(held.select("scan_id", F.lit("u3").alias("held")))


@query("jn_dup_job", "SELECT scan_id, job_id, primary_key FROM f_dup")
def _(t):
    return listing.duplicates(t.scans).select("scan_id", "job_id", "primary_key")


@query(
    "jn_dup_template",
    """SELECT s.scan_id, s.template_id, s.primary_key FROM f_scans s JOIN (SELECT template_id, primary_key FROM f_scans WHERE primary_key IS NOT NULL
       GROUP BY 1, 2 HAVING COUNT(*) > 1) k ON k.template_id = s.template_id AND k.primary_key = s.primary_key""",
)
def _(t):
    return listing.duplicates(t.scans, "template_id").select("scan_id", "template_id", "primary_key")


@query(
    "jn_duplicates_of",
    """SELECT a.scan_id, COUNT(*) AS others, MIN(b.scan_id) AS first_other FROM f_dup a JOIN f_dup b
       ON b.job_id = a.job_id AND b.primary_key = a.primary_key AND b.scan_id <> a.scan_id GROUP BY a.scan_id""",
)
def _(t):
    return listing.duplicate_summary(t.scans)


@query(
    "jn_review_flag_exists",
    """SELECT r.scan_id, r.name, r.kind FROM f_review r WHERE state = 'pending' AND EXISTS
       (SELECT 1 FROM f_flags f WHERE f.scan_id = r.scan_id AND f.name = r.name AND f.flag = 'multi_marked')""",
)
def _(t):
    return listing.pending(t.review, t.flags, "multi_marked").select("scan_id", "name", "kind")


@query(
    "jn_review_flags",
    "SELECT f.flag, COUNT(*) AS n FROM f_review r JOIN f_flags f ON f.scan_id = r.scan_id AND f.name = r.name WHERE r.state = 'pending' GROUP BY 1",
)
def _(t):
    return listing.counts_by(listing.pending(t.review).join(t.flags, ["scan_id", "name"]), "flag")


_MINE = f"""SELECT a.reviewer, s.*, ROW_NUMBER() OVER (PARTITION BY a.reviewer ORDER BY s.seq, s.scan_id) AS place
  FROM f_assign a JOIN f_scans s ON s.scan_id = a.scan_id"""


@query("jn_assign_scans", f"SELECT reviewer, place, scan_id FROM ({_MINE}) m WHERE place BETWEEN 5 AND 120 AND {OPEN}")
def _(t):
    return listing.assigned_sheets(t.assign, t.scans_seq, 5, 120, only_open=True)


@query(
    "wn_sheet_number",
    f"""SELECT p.scan_id, p.place, m.place AS own_place FROM ({_PLACED}) p LEFT JOIN ({_MINE}) m ON m.scan_id = p.scan_id""",
)
def _(t):
    placed = ranking.numbered(t.scans.select("scan_id"), [F.col("scan_id")], F.col("scan_id"), name="place")
    own = listing.assigned_sheets(t.assign, t.scans_seq).select("scan_id", F.col("place").alias("own_place"))
    return placed.join(own, "scan_id", "left")


_ACT = """SELECT scan_id, MAX(happened) FILTER (action IN ('correction', 'verified')) AS changed_at, COUNT(*) FILTER (action IN ('correction', 'verified')) AS changes,
  STRING_AGG(DISTINCT reviewer, ',' ORDER BY reviewer) FILTER (action IN ('correction', 'verified')) AS users,
  STRING_AGG(DISTINCT action, ',' ORDER BY action) FILTER (action IN ('correction', 'verified')) AS actions,
  MAX(id) FILTER (action IN ('correction', 'verified')) AS last_change, MAX(happened) FILTER (action = 'verified') AS verified_at,
  MAX(id) FILTER (action = 'approved') AS approved_id, MAX(happened) FILTER (action = 'approved') AS approved_at FROM f_activity GROUP BY scan_id"""


def _changed(t, checked):
    return listing.changed_sheets(t.activity, t.scans, ("correction", "verified"), checked)


@query(
    "jn_activity_scans",
    f"""SELECT a.scan_id, s.file_name, EPOCH_US(a.verified_at) AS verified_us, a.approved_id, EPOCH_US(a.approved_at) AS approved_us, a.last_change
       FROM ({_ACT}) a JOIN f_scans s ON s.scan_id = a.scan_id WHERE a.changes > 0""",
)
def _(t):
    return _changed(t, True).select(
        "scan_id",
        "file_name",
        micros("verified_at").alias("verified_us"),
        "approved_id",
        micros("approved_at").alias("approved_us"),
        "last_change",
    )


@query(
    "ag_changed_sheets",
    f"""SELECT a.scan_id, EPOCH_US(a.changed_at) AS changed_us, a.changes, a.users, a.actions FROM ({_ACT}) a JOIN f_scans s ON s.scan_id = a.scan_id
       WHERE a.changes > 0 AND (a.approved_id IS NULL OR a.last_change > a.approved_id)""",
)
def _(t):
    return _changed(t, False).select("scan_id", micros("changed_at").alias("changed_us"), "changes", "users", "actions")


@query("jn_last_active", "SELECT reviewer, EPOCH_US(MAX(happened)) AS last_us FROM f_activity WHERE action NOT IN ('assigned', 'scanned') GROUP BY 1")
def _(t):
    return listing.last_active(t.activity).select("reviewer", micros("last_active").alias("last_us"))


@query("jn_sent_back_exists", "SELECT scan_id, status FROM f_scans s WHERE EXISTS (SELECT 1 FROM f_activity a WHERE a.scan_id = s.scan_id AND a.action = 'returned')")
def _(t):
    return t.scans.join(listing.returned_scans(t.activity), "scan_id", "left_semi").select("scan_id", "status")


@query(
    "ag_assignment_summary",
    f"""SELECT a.reviewer, COUNT(*) AS assigned, COUNT(*) FILTER ({OPEN}) AS to_review, COUNT(*) FILTER (verified = 0 AND NOT {OPEN}) AS reviewed,
       COUNT(*) FILTER (verified = 1) AS verified, COUNT(*) FILTER (approved = 1) AS approved, COUNT(r.scan_id) AS sent_back,
       (SELECT EPOCH_US(MAX(happened)) FROM f_activity v WHERE v.reviewer = a.reviewer AND action NOT IN ('assigned', 'scanned')) AS last_us
       FROM f_assign a JOIN f_scans s ON s.scan_id = a.scan_id LEFT JOIN (SELECT DISTINCT scan_id FROM f_activity WHERE action = 'returned') r ON r.scan_id = s.scan_id
       GROUP BY a.reviewer""",
)
def _(t):
    out = listing.assignment_summary(t.assign, t.scans, t.activity)
    return out.withColumn("last_us", micros("last_active")).drop("last_active")


# ---- counts -------------------------------------------------------------------------------


@query("ag_status_counts", "SELECT status, COUNT(*) AS n FROM f_scans GROUP BY 1")
def _(t):
    return listing.counts_by(t.scans, "status")


@query(
    "ag_read_pass",
    """SELECT read_pass, COUNT(*) AS n FROM (SELECT CASE WHEN status = 'error' THEN NULL WHEN flag_count = 0 THEN 'fast' ELSE 'full' END AS read_pass FROM f_scans) s
       WHERE read_pass IS NOT NULL GROUP BY 1""",
)
def _(t):
    passed = F.when(F.col("status") != "error", F.when(F.col("flag_count") == 0, "fast").otherwise("full"))
    return listing.counts_by(t.scans.select(passed.alias("read_pass")).where("read_pass IS NOT NULL"), "read_pass")


@query("ag_error_seqs", "SELECT job_id, seq FROM f_scans GROUP BY 1, 2 HAVING BOOL_OR(status = 'error') AND NOT BOOL_OR(verified = 1)")
def _(t):
    return listing.error_files(t.scans_seq)


@query(
    "ag_facets",
    """SELECT 'name' AS facet, name AS value, COUNT(DISTINCT scan_id) AS n FROM f_flags GROUP BY name
       UNION ALL SELECT 'flag', flag, COUNT(DISTINCT scan_id) FROM f_flags GROUP BY flag
       UNION ALL SELECT 'view', 'all', COUNT(*) FROM f_scans UNION ALL SELECT 'view', 'duplicates', COUNT(*) FROM f_dup """
    + " ".join(f"UNION ALL SELECT 'view', '{v}', COUNT(*) FROM f_scans WHERE {w}" for v, w in WHERE.items()),
)
def _(t):
    return listing.facets(t.scans, t.flags)


@query("so_topk_facets", "SELECT flag, COUNT(DISTINCT scan_id) AS n FROM f_flags GROUP BY flag ORDER BY n DESC, flag LIMIT 2")
def _(t):
    return (
        t.flags.groupBy("flag").agg(F.count_distinct("scan_id").alias("n")).orderBy(F.desc("n"), "flag").limit(2)
    )


@query("ag_pending_names", "SELECT name, kind, COUNT(*) AS n FROM f_review WHERE state = 'pending' GROUP BY 1, 2")
def _(t):
    return listing.counts_by(listing.pending(t.review), "name", "kind")


@query("ag_pending_jobs", "SELECT job_id, COUNT(*) AS n FROM f_review WHERE state = 'pending' GROUP BY 1")
def _(t):
    return listing.counts_by(listing.pending(t.review), "job_id")


@query(
    "ag_review_counts",
    """SELECT r.name, f.flag, COUNT(*) AS n, COUNT(*) FILTER (r.created_at > TIMESTAMP '1999-01-01') AS new_items FROM f_review r
       JOIN f_flags f ON f.scan_id = r.scan_id AND f.name = r.name WHERE r.state = 'pending' GROUP BY GROUPING SETS ((), (r.name), (f.flag))""",
)
def _(t):
    items = listing.pending(t.review).join(t.flags, ["scan_id", "name"])
    fresh = F.count_if(F.col("created_at") > F.expr("timestamp_ntz'1999-01-01'"))
    sets = [[], [F.col("name")], [F.col("flag")]]
    return items.groupingSets(sets, "name", "flag").agg(F.count("*").alias("n"), fresh.alias("new_items"))


VIEWS["f_outcomes"] = """SELECT c.scan_id, c.name, CASE WHEN f.scan_id IS NULL THEN 0 ELSE 1 END AS flagged,
  CASE WHEN k.original_value <> k.new_value THEN 1 ELSE 0 END AS corrected FROM f_cells c
  JOIN f_scans s ON s.scan_id = c.scan_id AND s.verified = 1 LEFT JOIN f_flags f ON f.scan_id = c.scan_id AND f.name = c.name
  LEFT JOIN f_corrections k ON k.scan_id = c.scan_id AND k.name = c.name"""


def outcomes(t: Tables):
    return listing.outcomes(t.cells, t.scans, t.flags, t.corrections)


@query("ag_outcomes", "SELECT scan_id, name, flagged, corrected FROM f_outcomes")
def _(t):
    return outcomes(t).select("scan_id", "name", "flagged", "corrected")


@query(
    "ag_accuracy",
    """SELECT name, COUNT(*) FILTER (flagged = 0) AS auto, COUNT(*) FILTER (flagged = 0 AND corrected = 0) AS auto_ok, COUNT(*) FILTER (flagged = 1) AS flagged,
       COUNT(*) FILTER (flagged = 1 AND corrected = 1) AS flagged_corrected, COUNT(*) AS total, COUNT(*) FILTER (corrected = 1) AS corrected,
       CASE WHEN COUNT(*) FILTER (flagged = 0) > 0 THEN ROUND(100.0 * COUNT(*) FILTER (flagged = 0 AND corrected = 0) / COUNT(*) FILTER (flagged = 0), 2) END AS auto_accuracy,
       CASE WHEN COUNT(*) FILTER (flagged = 1) > 0 THEN ROUND(100.0 * COUNT(*) FILTER (flagged = 1 AND corrected = 1) / COUNT(*) FILTER (flagged = 1), 2) END AS flag_precision
       FROM f_outcomes GROUP BY ROLLUP (name)""",
)
def _(t):
    return listing.accuracy(outcomes(t))


@query(
    "so_worst_fields",
    """SELECT name, ROW_NUMBER() OVER (ORDER BY acc NULLS LAST, LENGTH(name), name) AS place, acc AS auto_accuracy FROM (SELECT name,
       ROUND(100.0 * COUNT(*) FILTER (flagged = 0 AND corrected = 0) / NULLIF(COUNT(*) FILTER (flagged = 0), 0), 2) AS acc FROM f_outcomes GROUP BY name) x""",
)
def _(t):
    from pyspark.sql import Window

    # One row per template field by now, so the order over all of them is small
    fields = listing.accuracy(outcomes(t)).where("name IS NOT NULL")
    order = Window.orderBy(F.asc_nulls_last("auto_accuracy"), tx.natural_key(F.col("name")))
    return fields.select("name", F.row_number().over(order).alias("place"), "auto_accuracy")


# ---- order, pages, neighbours -------------------------------------------------------------


@query(
    "wn_neighbours",
    f"""SELECT scan_id, LAG(scan_id) OVER (ORDER BY scan_id DESC) AS previous_id, LEAD(scan_id) OVER (ORDER BY scan_id DESC) AS next_id,
       LAG(scan_id) OVER (PARTITION BY job_id ORDER BY scan_id) AS previous_in_job, LEAD(scan_id) OVER (PARTITION BY job_id ORDER BY scan_id) AS next_in_job
       FROM f_scans WHERE {WHERE['flagged']}""",
)
def _(t):
    rows = listing.where_results(t.scans, view_name="flagged").select("scan_id", "job_id")
    scan = F.col("scan_id")
    whole = ranking.neighbours(rows, "scan_id", [F.desc("scan_id")], -scan)
    in_job = ranking.neighbours(rows, "scan_id", [scan], scan, within=["job_id"]).select(
        "scan_id", F.col("previous_id").alias("previous_in_job"), F.col("next_id").alias("next_in_job")
    )
    return whole.drop("job_id").join(in_job, "scan_id")


@query(
    "so_risk",
    """SELECT kind, name, scan_id FROM f_review WHERE state = 'pending' ORDER BY CASE kind WHEN 'sheet' THEN 0 WHEN 'check' THEN 1
       WHEN 'custom_label' THEN 2 WHEN 'zone' THEN 3 ELSE 4 END, created_at, scan_id, name LIMIT 200""",
)
def _(t):
    order = [listing.risk_rank(F.col("kind")), "created_at", "scan_id", "name"]
    return listing.pending(t.review).orderBy(*order).limit(200).select("kind", "name", "scan_id")


@query("so_listing", "SELECT scan_id, job_id, seq FROM f_scans")
def _(t):
    return t.scans_seq.select("scan_id", "job_id", "seq").orderBy("job_id", "seq", "scan_id")


@query(
    "so_page",
    "SELECT scan_id, status, (SELECT COUNT(*) FROM f_scans WHERE status = 'ok') AS total FROM f_scans WHERE status = 'ok' ORDER BY scan_id DESC LIMIT 50 OFFSET 100",
)
def _(t):
    rows = listing.equal(t.scans, status="ok").select("scan_id", "status")
    return listing.page(rows, [F.desc("scan_id")], 50, 100)


@query("so_keyset", "SELECT job_id, seq, scan_id, status FROM f_scans WHERE status <> 'error'")
def _(t):
    # A full sorted frame takes the place of keyset batches
    return t.scans_seq.where("status <> 'error'").select("job_id", "seq", "scan_id", "status").orderBy("job_id", "seq", "scan_id")


@query("so_tables_desc", "SELECT id, scan_id, action FROM f_activity WHERE reviewer = 'u1' ORDER BY id DESC LIMIT 100")
def _(t):
    rows = listing.equal(t.activity, reviewer="u1").orderBy(F.desc("id")).limit(100)
    return rows.select("id", "scan_id", "action")


@query(
    "wn_even_split",
    "SELECT scan_id, ROW_NUMBER() OVER (ORDER BY scan_id) AS place, CONCAT('p', NTILE(7) OVER (ORDER BY scan_id)) AS reviewer FROM f_scans WHERE status <> 'error'",
)
def _(t):
    rows = t.scans.where("status <> 'error'").select("scan_id")
    return listing.even_split(rows, [f"p{i}" for i in range(1, 8)])


@query(
    "wn_history_cap",
    "SELECT scan_id, id, action FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY id DESC) AS rn FROM f_activity) a WHERE rn <= 3",
)
def _(t):
    return listing.last_n(t.activity, "scan_id", [F.desc("id")], 3).select("scan_id", "id", "action")


@query("rv_activity", "SELECT reviewer, action, COUNT(*) AS n, EPOCH_US(MIN(happened)) AS first_us, EPOCH_US(MAX(happened)) AS last_us FROM f_activity GROUP BY 1, 2")
def _(t):
    return (
        t.activity.groupBy("reviewer", "action")
        .agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
        .select("reviewer", "action", "n", micros("a").alias("first_us"), micros("b").alias("last_us"))
    )


# ---- sets ---------------------------------------------------------------------------------


@query("st_resume_anti", "SELECT scan_id, file_name FROM f_scans WHERE scan_id NOT IN (SELECT scan_id FROM f_cells)")
def _(t):
    # Files listed but not yet read: no answers of theirs are stored
    return t.scans.join(t.cells.select("scan_id"), "scan_id", "left_anti").select("scan_id", "file_name")


@query("st_distinct_templates", "SELECT DISTINCT template_id FROM f_scans WHERE status = 'error' AND template_id IS NOT NULL")
def _(t):
    return listing.equal(t.scans, status="error").where("template_id IS NOT NULL").select("template_id").distinct()


@query(
    "st_upsert",
    """SELECT scan_id, status, template_id FROM (SELECT scan_id, 'ok' AS status, template_id FROM f_scans WHERE status = 'error'
       UNION ALL SELECT scan_id, status, template_id FROM f_scans WHERE status <> 'error') u
       UNION ALL SELECT scan_id + 100000000, 'ok', NULL FROM f_scans WHERE status = 'error'""",
)
def _(t):
    target = t.scans.select("scan_id", "status", "template_id")
    again = target.where("status = 'error'").withColumn("status", F.lit("ok"))
    new = again.select((F.col("scan_id") + 100000000).alias("scan_id"), "status")
    return listing.upsert(target, again.unionByName(new, allowMissingColumns=True), ["scan_id"])


@query(
    "st_delete_cascade",
    """SELECT 'scans' AS tbl, COUNT(*) AS n FROM f_scans WHERE status <> 'error' UNION ALL SELECT 'cells', COUNT(*) FROM f_cells WHERE scan_id NOT IN (SELECT scan_id FROM f_scans WHERE status = 'error')
       UNION ALL SELECT 'flags', COUNT(*) FROM f_flags WHERE scan_id NOT IN (SELECT scan_id FROM f_scans WHERE status = 'error')
       UNION ALL SELECT 'assign', COUNT(*) FROM f_assign WHERE scan_id NOT IN (SELECT scan_id FROM f_scans WHERE status = 'error')""",
)
def _(t):
    gone = t.scans.where("status = 'error'").select("scan_id")
    kept = listing.delete_scans({"scans": t.scans, "cells": t.cells, "flags": t.flags, "assign": t.assign}, gone)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in kept.items()]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "st_delete_audit",
    """SELECT job_id, 'admin' AS reviewer, 'job_deleted' AS action, COUNT(*) AS sheets FROM f_scans WHERE status = 'error' GROUP BY job_id""",
)
def _(t):
    gone = t.scans.where("status = 'error'")
    return gone.groupBy("job_id").agg(
        F.lit("admin").alias("reviewer"), F.lit("job_deleted").alias("action"), F.count("*").alias("sheets")
    )


@query(
    "st_missing_names",
    """SELECT 'not in key' AS problem, name FROM (SELECT DISTINCT name FROM f_cells WHERE name NOT IN (SELECT question FROM f_key WHERE section = 'HARD')) a
       UNION ALL SELECT 'not read', question FROM (SELECT DISTINCT question FROM f_key WHERE question NOT IN (SELECT name FROM f_cells WHERE flag = 'empty' AND pos < 6)) b""",
)
def _(t):
    hard = t.key.where("section = 'HARD'").select(F.col("question").alias("name"))
    read = t.cells.where("flag = 'empty' AND pos < 6").select("name")
    one = t.cells.select("name").distinct().join(hard, "name", "left_anti")
    two = t.key.select(F.col("question").alias("name")).join(read, "name", "left_anti")
    return one.select(F.lit("not in key").alias("problem"), "name").unionByName(
        two.select(F.lit("not read").alias("problem"), "name")
    )


@query(
    "st_overlap",
    """SELECT part_id, lo, hi FROM (SELECT l_orderkey AS part_id, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi, MIN(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_suppkey) x
       QUALIFY lo <= MAX(hi) OVER (PARTITION BY part_id ORDER BY lo, hi, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(t):
    from pyspark.sql import Window

    # Ranges of one sheet that start before an earlier one ends (a sheet has few of them)
    spans = (
        t.raw("lineitem")
        .groupBy(F.col("l_orderkey").alias("part_id"), F.col("l_suppkey").alias("s"))
        .agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    )
    before = Window.partitionBy("part_id").orderBy("lo", "hi", "s").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_end", F.max("hi").over(before)).where("lo <= _end").select("part_id", "lo", "hi")
