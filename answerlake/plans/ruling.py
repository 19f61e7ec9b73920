"""Rule queries: validation reasons, cross-field checks, absorbed flags and review lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlake.operators import rules as rl
from answerlake.plans.derived import VIEWS, Tables
from answerlake.plans.registry import query
from answerlake.plans.scalars import columns, texts

NAMES = [f"q{i}" for i in range(1, 8)]
GROUP = {"roll": NAMES[:5]}

VIEWS["f_wide"] = "SELECT scan_id, " + ", ".join(
    f"COALESCE(MAX(value) FILTER (pos = {i}), '') AS v{i}, COALESCE(MAX(needs_review) FILTER (pos = {i}), 0) = 1 AS r{i}"
    for i in range(1, 8)
) + " FROM f_cells GROUP BY scan_id"


def readings(t: Tables):
    flags = F.filter(F.array("flag"), lambda f: f != "")
    return t.cells.select(
        "scan_id",
        "name",
        "value",
        flags.alias("flags"),
        (F.col("needs_review") == 1).alias("needs_review"),
        F.when(F.col("pos") == 1, "zone").otherwise("field").alias("kind"),
    )


def sheets(t: Tables):
    return rl.sheet_maps(readings(t))


_E = "||".join(f"CASE WHEN v{i} = '' THEN '1' ELSE '0' END" for i in range(1, 6))
_JOINED = "||".join(f"v{i}" for i in range(1, 6))
_REASONS = """CASE WHEN INSTR(e, '0') = 0 THEN 'empty' ELSE CONCAT_WS('; ', CASE WHEN LENGTH(v) NOT BETWEEN 2 AND 4 THEN 'length ' || LENGTH(v) || ' not in [2, 4]' END,
  CASE WHEN INSTR(RTRIM(LTRIM(e, '1'), '1'), '1') > 0 THEN 'gap at position ' || ARRAY_TO_STRING([i FOR i IN RANGE(INSTR(e, '0'), 6 - INSTR(REVERSE(e), '0') + 1) IF SUBSTR(e, CAST(i AS INTEGER), 1) = '1'], ', ') END,
  CASE WHEN INSTR(e, '0') > 1 THEN (INSTR(e, '0') - 1) || ' empty leading position(s)' END, CASE WHEN INSTR(REVERSE(e), '0') > 1 THEN (INSTR(REVERSE(e), '0') - 1) || ' empty trailing position(s)' END,
  CASE WHEN NOT regexp_full_match(v, '[AN]+') THEN 'does not match ''[AN]+''' END) END"""
VIEWS["f_roll"] = f"SELECT scan_id, v AS value, {_REASONS} AS reasons FROM (SELECT scan_id, {_JOINED} AS v, {_E} AS e FROM f_wide) w"

ROLL = rl.Validation(
    "roll", length=(2, 4), allow_gaps=False, allow_empty_ends=False, pattern="[AN]+", required=True
)


@query("rl_validate", "SELECT scan_id, value, reasons, reasons = '' AS ok FROM f_roll")
def _(t):
    run = rl.Run(sheets(t), rl.Rules([ROLL], groups=GROUP), NAMES)
    return run.validations().select("scan_id", "value", F.array_join("reasons", "; ").alias("reasons"), "ok")


@query(
    "rl_validate_range",
    r"""SELECT id, CASE WHEN TRIM(text) = '' THEN '' ELSE CONCAT_WS('; ', CASE WHEN LENGTH(text) > 1 AND text LIKE '0%' THEN 'leading zero' END, CASE WHEN text NOT IN ('Y', '7', '12', '30', '045', '44') AND NOT regexp_full_match(text, '[0-9]+') THEN 'not an allowed value' END,
       CASE WHEN TRY_CAST(text AS DOUBLE) IS NULL THEN 'not a number' WHEN CAST(text AS DOUBLE) > 40 THEN text || ' outside [, 40]' END) END AS reasons FROM f_texts""",
)
def _(t):
    rule = rl.Validation("text", leading_zeros="forbid", range=(None, 40))
    allowed = F.when(
        ~F.col("text").isin("Y", "7", "12", "30", "045", "44") & ~F.col("text").rlike("^[0-9]+$"),
        "not an allowed value",
    )
    reasons = rl.failures(rule, F.col("text"))
    blank = F.trim("text") == ""
    # The allowed-value reason stands between the other two, as in one rule
    merged = F.array_compact(
        F.array(
            F.when(F.array_contains(reasons, "leading zero"), "leading zero"),
            allowed,
            F.get(F.filter(reasons, lambda r: r != "leading zero"), F.lit(0)),
        )
    )
    return texts(t).select("id", F.when(blank, "").otherwise(F.array_join(merged, "; ")).alias("reasons"))


@query(
    "rl_on_fail",
    """SELECT scan_id, name, value, ok, action, CASE WHEN NOT ok AND action IN ('blank', 'both') THEN '' ELSE value END AS kept, NOT ok AND action IN ('review', 'both') AS to_review FROM (
       SELECT scan_id, UNNEST([{'name': 'q1', 'value': v1, 'ok': v1 IN ('', 'A'), 'action': CASE WHEN v1 NOT IN ('', 'A') THEN 'review' END}, {'name': 'q2', 'value': v2, 'ok': v2 IN ('', 'A'), 'action': CASE WHEN v2 NOT IN ('', 'A') THEN 'blank' END},
       {'name': 'q3', 'value': v3, 'ok': v3 IN ('', 'A'), 'action': CASE WHEN v3 NOT IN ('', 'A') THEN 'both' END}, {'name': 'q4', 'value': v4, 'ok': v4 IN ('', 'A'), 'action': CASE WHEN v4 NOT IN ('', 'A') THEN 'flag' END}], recursive := TRUE) FROM f_wide) x""",
)
def _(t):
    specs = [
        rl.Validation(n, allowed=["A"], on_fail=a) for n, a in zip(NAMES, ("review", "blank", "both", "flag"))
    ]
    rows = rl.Run(sheets(t), rl.Rules(specs), NAMES).validations()
    failed = ~F.col("ok")
    return rows.select(
        "scan_id",
        "name",
        "value",
        "ok",
        "action",
        F.when(failed & F.col("action").isin("blank", "both"), "").otherwise(F.col("value")).alias("kept"),
        (failed & F.coalesce(F.col("action").isin("review", "both"), F.lit(False))).alias("to_review"),
    )


@query(
    "rl_positions",
    f"SELECT scan_id, value, e AS empties FROM (SELECT scan_id, {_JOINED} AS value, {_E} AS e FROM f_wide) w",
)
def _(t):
    run = rl.Run(sheets(t), rl.Rules(groups=GROUP), NAMES)
    marks = F.transform(run.empties("roll"), lambda e: F.when(e, "1").otherwise("0"))
    return run.df.select("scan_id", run.base("roll").alias("value"), F.array_join(marks, "").alias("empties"))


@query("rl_missing", "SELECT scan_id, v1 = '' AS q1_missing, v1 = '' AND v2 = '' AND v3 = '' AND v4 = '' AND v5 = '' AS roll_missing FROM f_wide")
def _(t):
    run = rl.Run(sheets(t), rl.Rules(groups=GROUP), NAMES)
    return run.df.select(
        "scan_id",
        run.missing("q1", run.base("q1")).alias("q1_missing"),
        run.missing("roll", run.base("roll")).alias("roll_missing"),
    )


# Two checks in a chain: `ans` from three fields, `final` from ans and q4.
ANS = rl.Check("ans", ["q1", "q2", "q3"], normalize=("^[A-Z]", 0), priority=["q2", "q1", "q3"], on_conflict="prefer", review_on_conflict=False)
FINAL = rl.Check("final", ["ans", "q4"], on_conflict="error", on_missing="review", skip_flagged=True)
CHAIN = rl.Rules([rl.Validation("q1", allowed=["A", "AN", "N"])], [FINAL, ANS])

VIEWS["f_src"] = """SELECT scan_id, 'ans' AS name, place, source, raw, SUBSTR(raw, 1, 1) AS norm, CASE WHEN raw = '' THEN 'missing' WHEN source = 'q1' AND raw NOT IN ('A', 'AN', 'N') THEN 'invalid' END AS note, r FROM (
  SELECT scan_id, 0 AS place, 'q2' AS source, v2 AS raw, r2 AS r FROM f_wide UNION ALL SELECT scan_id, 1, 'q1', v1, r1 FROM f_wide UNION ALL SELECT scan_id, 2, 'q3', v3, r3 FROM f_wide) s"""
VIEWS["f_ans"] = """SELECT scan_id, COALESCE(arg_min(norm, place) FILTER (note IS NULL), '') AS value, arg_min(source, place) FILTER (note IS NULL) AS chosen_source,
  COUNT(DISTINCT norm) FILTER (note IS NULL) > 1 AS conflict, COUNT(*) FILTER (note IS NULL) = 0 AS nothing, COALESCE(MIN(place) FILTER (note IS NULL), 0) > 0 AS fell FROM f_src GROUP BY 1"""
VIEWS["f_final"] = """SELECT scan_id, CASE WHEN p1 AND p2 AND a <> v4 THEN '' WHEN p1 THEN a WHEN p2 THEN v4 ELSE '' END AS value, CASE WHEN p1 AND p2 AND a <> v4 THEN NULL WHEN p1 THEN 'ans' WHEN p2 THEN 'q4' END AS chosen_source,
  CONCAT_WS(',', CASE WHEN NOT p1 AND NOT p2 THEN 'all_sources_missing' END, CASE WHEN p1 AND p2 AND a <> v4 THEN 'cross_check_failed' END, CASE WHEN NOT p1 AND p2 THEN 'fallback_used' END) AS flags,
  (NOT p1) OR (p1 AND p2 AND a <> v4) AS needs_review FROM (SELECT w.scan_id, a.value AS a, a.value <> '' AS p1, v4, v4 <> '' AND NOT r4 AS p2 FROM f_wide w JOIN f_ans a ON a.scan_id = w.scan_id) x"""


def chain(t: Tables) -> rl.Run:
    return rl.Run(sheets(t), CHAIN, NAMES)


@query("rl_source", "SELECT scan_id, source, raw, norm, note FROM f_src")
def _(t):
    return chain(t).sources().where("name = 'ans'").select("scan_id", "source", "raw", "norm", "note")


@query(
    "rl_resolve",
    """SELECT scan_id, value, chosen_source, CONCAT_WS(',', CASE WHEN nothing THEN 'all_sources_missing' END, CASE WHEN conflict THEN 'cross_check_failed' END, CASE WHEN fell AND NOT nothing THEN 'fallback_used' END) AS flags, nothing AS needs_review FROM f_ans""",
)
def _(t):
    rows = chain(t).checks().where("name = 'ans'")
    return rows.select("scan_id", "value", "chosen_source", F.array_join("flags", ",").alias("flags"), "needs_review")


@query("rl_chain", "SELECT scan_id, value, chosen_source, flags, needs_review FROM f_final")
def _(t):
    rows = chain(t).checks().where("name = 'final'")
    return rows.select("scan_id", "value", "chosen_source", F.array_join("flags", ",").alias("flags"), "needs_review")


_ABSORBED = """SELECT s.scan_id, s.source AS name, 'ans' AS resolved_by FROM f_src s JOIN f_ans a ON a.scan_id = s.scan_id WHERE NOT a.nothing AND s.r AND NOT (s.source = 'q1' AND s.raw NOT IN ('', 'A', 'AN', 'N'))
   AND (s.note IS NOT NULL OR EXISTS (SELECT 1 FROM f_src o WHERE o.scan_id = s.scan_id AND o.source <> s.source AND o.note IS NULL AND o.norm = s.norm))
   UNION ALL SELECT f.scan_id, 'q4', 'final' FROM f_final f JOIN f_wide w ON w.scan_id = f.scan_id WHERE NOT f.needs_review AND f.chosen_source IS NOT NULL AND w.r4"""
VIEWS["f_absorbed"] = _ABSORBED


@query("rl_absorb", "SELECT scan_id, name, resolved_by FROM f_absorbed")
def _(t):
    return chain(t).absorbed()


@query(
    "rl_fallback_zone",
    """SELECT scan_id, CASE WHEN v1 <> '' THEN v1 ELSE v6 END AS value, CASE WHEN v1 <> '' THEN 'q1' WHEN v6 <> '' THEN 'q6' END AS chosen_source, v1 = '' AND v6 = '' OR (v1 <> '' AND v6 <> '' AND v1 <> v6) AS needs_review FROM f_wide""",
)
def _(t):
    run = rl.Run(sheets(t), rl.Rules(checks=rl.fallback_checks({"q1": "q6"})), NAMES)
    return run.checks().select("scan_id", "value", "chosen_source", "needs_review")


@query(
    "rl_name_checks",
    """SELECT name, CASE WHEN name IN ('ans', 'final') THEN 'output' ELSE 'unknown source' END AS kind FROM (VALUES ('ans'), ('final'), ('q9'), ('q1')) s(name) WHERE name NOT IN (SELECT name FROM f_cells)""",
)
def _(t):
    import pyarrow as pa

    from answerlake.config import local_frame

    # Names the rules use that no sheet was read with
    used = local_frame(t.spark, [("ans",), ("final",), ("q9",), ("q1",)], pa.schema([("name", pa.string())]))
    unknown = used.join(t.cells.select("name").distinct(), "name", "left_anti")
    outputs = [c.output for c in CHAIN.checks]
    return unknown.select("name", F.when(F.col("name").isin(outputs), "output").otherwise("unknown source").alias("kind"))


VIEWS["f_wide2"] = "SELECT scan_id, " + ", ".join(
    f"COALESCE(MAX(value) FILTER (pos = {i}), '') AS v{i}, COALESCE(MAX(needs_review) FILTER (pos = {i}), 0) = 1 AS r{i}" for i in (1, 2, 3)
) + " FROM (SELECT c.scan_id, c.pos, COALESCE(k.new_value, c.value) AS value, CASE WHEN k.scan_id IS NULL THEN c.needs_review ELSE 0 END AS needs_review FROM f_cells c LEFT JOIN f_corrections k ON k.scan_id = c.scan_id AND k.name = c.name) e GROUP BY scan_id"


@query(
    "rl_reapply",
    """SELECT scan_id, CASE WHEN v2 <> '' THEN SUBSTR(v2, 1, 1) WHEN v1 IN ('A', 'AN', 'N') THEN SUBSTR(v1, 1, 1) WHEN v3 <> '' THEN SUBSTR(v3, 1, 1) ELSE '' END AS value FROM f_wide2""",
)
def _(t):
    # Rules start from the readings as corrected, so running them again changes nothing
    edits = t.corrections.select("scan_id", "name", "new_value")
    edited = readings(t).join(edits, ["scan_id", "name"], "left")
    done = F.col("new_value").isNotNull()
    now = edited.select(
        "scan_id",
        "name",
        F.coalesce("new_value", "value").alias("value"),
        F.when(done, F.array_remove("flags", "empty")).otherwise(F.col("flags")).alias("flags"),
        (F.col("needs_review") & ~done).alias("needs_review"),
    )
    run = rl.Run(rl.sheet_maps(now), CHAIN, NAMES)
    return run.checks().where("name = 'ans'").select("scan_id", "value")


@query(
    "rl_review_list",
    """WITH f AS (SELECT c.scan_id, CASE c.pos WHEN 1 THEN 'zone' ELSE 'field' END AS kind, c.name FROM f_cells c WHERE c.needs_review = 1 AND NOT EXISTS (SELECT 1 FROM f_absorbed a WHERE a.scan_id = c.scan_id AND a.name = c.name)),
       l AS (SELECT * FROM f UNION ALL SELECT scan_id, 'check', 'ans' FROM f_ans WHERE nothing UNION ALL SELECT scan_id, 'check', 'final' FROM f_final WHERE needs_review),
       g AS (SELECT scan_id FROM f_columns WHERE pos <= 5 GROUP BY scan_id HAVING BOOL_OR(state = 'issue' OR (state = 'multi' AND needs_review = 1)))
       SELECT * FROM l UNION ALL SELECT g.scan_id, 'custom_label', 'roll' FROM g WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.scan_id = g.scan_id AND l.name IN ('q1', 'q2', 'q3', 'q4', 'q5', 'roll'))""",
)
def _(t):
    run = chain(t)
    flagged = (F.col("state") == "issue") | ((F.col("state") == "multi") & (F.col("needs_review") == 1))
    groups = (
        columns(t)
        .where("pos <= 5")
        .groupBy("scan_id")
        .agg(F.bool_or(flagged).alias("flagged"), F.collect_set(F.when(flagged, F.col("state"))).alias("flags"))
        .where("flagged")
        .select("scan_id", F.lit("roll").alias("name"), "flags", F.array(*map(F.lit, GROUP["roll"])).alias("columns"))
    )
    return rl.review_list(readings(t), run.review(), groups, run.absorbed()).select("scan_id", "kind", "name")
