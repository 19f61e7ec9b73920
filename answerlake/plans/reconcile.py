"""Reconciliation queries: keys, states, mismatches, decisions, locks and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.functions import values as vl
from answerlake.operators import compare, listing, ranking
from answerlake.plans.accuracy import labels
from answerlake.plans.derived import VIEWS, Tables
from answerlake.plans.index import micros
from answerlake.plans.registry import query
from answerlake.plans.scalars import BANDS
from answerlake.session import hand_over

NAMES = [f"q{i}" for i in range(1, 8)]

VIEWS["f_ext"] = "SELECT *, seq_key || '#' || copy AS row_id FROM f_external"
VIEWS["f_ext_rows"] = r"""SELECT row_id, key, CASE WHEN key = '' THEN 'no key' WHEN COUNT(*) OVER (PARTITION BY key) > 1 THEN 'duplicate key' END AS reason FROM
  (SELECT row_id, CASE WHEN d <> '' AND LTRIM(d, '0') = '' THEN '0' ELSE LTRIM(d, '0') END AS key FROM (SELECT DISTINCT row_id, regexp_replace(seq_key, '\D', '', 'g') AS d FROM f_ext) e) k"""
VIEWS["f_ours"] = r"""SELECT s.*, CASE WHEN LTRIM(d, '0') = '' THEN '0' ELSE LTRIM(d, '0') END AS key FROM (SELECT *, regexp_replace(file_name, '\D', '', 'g') AS d FROM f_scans) s"""
VIEWS["f_states"] = """SELECT s.scan_id, r.row_id, s.key, CASE WHEN s.status = 'error' THEN 'not_read' WHEN r.row_id IS NULL THEN 'no_record' ELSE 'matched' END AS state
  FROM f_ours s LEFT JOIN (SELECT * FROM f_ext_rows WHERE reason IS NULL) r ON r.key = s.key"""
VIEWS["f_all_states"] = """SELECT * FROM f_states UNION ALL SELECT NULL, row_id, key, COALESCE(reason, 'no sheet') FROM f_ext_rows
  WHERE row_id NOT IN (SELECT row_id FROM f_states WHERE state = 'matched')"""
VIEWS["f_fields"] = """SELECT m.scan_id, e.name, e.pos, CASE WHEN TRIM(e.cell) IN ('', '-') THEN '' ELSE TRIM(e.cell) END AS external, COALESCE(c.value, '') AS ours,
  CASE WHEN TRIM(e.cell) = '*' AND LENGTH(c.value) > 1 THEN 'match' WHEN TRIM(e.cell) = '*' OR LENGTH(c.value) > 1 THEN 'mismatch'
       WHEN UPPER(TRIM(e.cell)) = COALESCE(c.value, '') THEN 'match' ELSE 'mismatch' END AS state
  FROM f_states m JOIN f_ext e ON e.row_id = m.row_id LEFT JOIN f_cells c ON c.scan_id = m.scan_id AND c.name = e.name WHERE m.state = 'matched'"""
VIEWS["f_cmp"] = "SELECT scan_id, name, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY pos, name) - 1 AS place, external, ours FROM f_fields WHERE state = 'mismatch'"
VIEWS["f_sheets"] = """SELECT s.scan_id, s.key, CASE WHEN s.state <> 'matched' THEN s.state WHEN COUNT(i.name) > 0 THEN 'pending' ELSE 'clean' END AS state, COUNT(i.name) AS mismatches
  FROM f_states s LEFT JOIN f_cmp i ON i.scan_id = s.scan_id GROUP BY s.scan_id, s.key, s.state"""


def external(t: Tables):
    return t.external.withColumn("row_id", F.concat_ws("#", "seq_key", F.col("copy").cast("string")))


def ext_rows(t: Tables):
    """The other file's rows, written once: they are read for the join and for both leftovers."""
    return t.once("ext_rows", lambda: hand_over(compare.external_rows(external(t)), "ext-rows"))


def our_keys(t: Tables):
    """Our sheets' keys, written once: the choice per key and the join both read them."""
    wanted = ("scan_id", "key", "status", "created_at")
    return t.once("our_keys", lambda: hand_over(compare.our_keys(t.scans).select(*wanted), "our-keys"))


def states(t: Tables):
    return t.once("states", lambda: compare.sheet_states(our_keys(t), ext_rows(t)))


def fields(t: Tables, rules=vl.CompareRules(), **options):
    return compare.side_by_side(states(t), external(t), t.cells, rules, **options)


def stored_states(t: Tables):
    """States written once for the builds that read them several times."""
    return t.once("stored_states", lambda: hand_over(states(t), "states"))


def stored_items(t: Tables):
    """Mismatch items, written once: decisions, audit and summaries all read them."""

    def build():
        fields_of = compare.side_by_side(stored_states(t), external(t), t.cells)
        return hand_over(compare.mismatches(fields_of), "items")

    return t.once("items", build)


def sheets_and_items(t: Tables):
    items = stored_items(t)
    return compare.sheet_summary(stored_states(t), items), items


@query("jn_external", "SELECT scan_id, row_id, key, state FROM f_all_states")
def _(t):
    return states(t)


@query("jn_ext_unique", "SELECT row_id, key, reason FROM f_ext_rows WHERE reason IS NOT NULL")
def _(t):
    return compare.external_rows(external(t)).where("reason IS NOT NULL")


_BEST = "SELECT scan_id, primary_key, ROW_NUMBER() OVER (PARTITION BY primary_key ORDER BY status = 'error', created_at DESC, scan_id) AS rk, COUNT(*) OVER (PARTITION BY primary_key) AS n FROM f_scans WHERE primary_key IS NOT NULL"


def _by_primary(t):
    return t.scans.select("scan_id", F.coalesce(F.col("primary_key").cast("string"), F.lit("")).alias("key"), "status", "created_at")


@query("jn_key_newest", f"SELECT CAST(primary_key AS VARCHAR) AS key, MAX(scan_id) FILTER (rk = 1) AS chosen, MAX(n) AS sheets FROM ({_BEST}) b GROUP BY 1")
def _(t):
    return compare.chosen_per_key(_by_primary(t)).drop("readable")


@query(
    "wn_newest_per_key",
    f"SELECT b.scan_id, CASE WHEN rk = 1 THEN 'chosen' ELSE 'replaced' END AS state, n > 1 AS shared FROM ({_BEST}) b",
)
def _(t):
    rows = _by_primary(t).where("key <> ''")
    best = compare.chosen_per_key(rows)
    state = F.when(F.col("chosen") == F.col("scan_id"), "chosen").otherwise("replaced")
    return rows.join(best, "key").select("scan_id", state.alias("state"), (F.col("sheets") > 1).alias("shared"))


@query(
    "jn_by_order",
    """SELECT s.scan_id, e.row_id FROM (SELECT scan_id, ROW_NUMBER() OVER (ORDER BY scan_id) AS i FROM f_scans) s
       JOIN (SELECT row_id, ROW_NUMBER() OVER (ORDER BY n, row_id) AS i FROM (SELECT DISTINCT row_id, CAST(SUBSTR(seq_key, 2) AS BIGINT) AS n FROM f_ext) x) e ON e.i = s.i""",
)
def _(t):
    rows = external(t).select("row_id", F.substring("seq_key", 2, 20).cast("bigint").alias("n")).distinct()
    theirs = ranking.numbered(rows, [F.col("n"), F.col("row_id")], F.col("n"), name="i")
    ours = ranking.numbered(t.scans.select("scan_id"), [F.col("scan_id")], F.col("scan_id"), name="i")
    return ours.join(theirs, "i").select("scan_id", "row_id")


@query("cp_fields", "SELECT scan_id, name, external, ours, state FROM f_fields")
def _(t):
    return fields(t).drop("pos")


@query("cp_items", "SELECT scan_id, name, place, external, ours FROM f_cmp")
def _(t):
    return compare.mismatches(fields(t))


@query(
    "cp_pairs",
    """SELECT f.name, f.state, COUNT(*) AS n FROM f_fields f WHERE f.name IN ('q2', 'q3', 'q4', 'q7') GROUP BY 1, 2""",
)
def _(t):
    names = [n for names in vl.parse_bands("x: q2..4, q7").values() for n in names]
    return listing.counts_by(fields(t, names=names), "name", "state")


@query(
    "jn_members_excluded",
    """WITH m(label, member) AS (VALUES ('left', 'q1'), ('left', 'q2'), ('right', 'q8'), ('right', 'q9')), mapped AS (SELECT DISTINCT name FROM f_external UNION SELECT label FROM m)
       SELECT name FROM mapped WHERE name NOT IN (SELECT label FROM m JOIN mapped p ON p.name = m.member)""",
)
def _(t):
    import pyarrow as pa

    from answerlake.config import local_frame

    members = local_frame(
        t.spark,
        [("left", "q1"), ("left", "q2"), ("right", "q8"), ("right", "q9")],
        pa.schema([("label", pa.string()), ("member", pa.string())]),
    )
    mapped = t.external.select("name").union(members.select("label")).distinct()
    twice = members.join(mapped, F.col("member") == F.col("name"), "left_semi").select(F.col("label").alias("name"))
    return mapped.join(twice, "name", "left_anti")


@query("cp_state", "SELECT scan_id, key, state, mismatches FROM f_sheets")
def _(t):
    sheets, _ = sheets_and_items(t)
    return sheets


@query("ag_cmp_summary", "SELECT state, COUNT(*) AS sheets, CAST(SUM(mismatches) AS BIGINT) AS mismatches FROM f_sheets GROUP BY 1")
def _(t):
    sheets, _ = sheets_and_items(t)
    return sheets.groupBy("state").agg(F.count("*").alias("sheets"), F.sum("mismatches").alias("mismatches"))


@query(
    "st_unmatched_union",
    """SELECT 'external' AS side, row_id, NULL AS file_name, key, state AS reason FROM f_all_states WHERE scan_id IS NULL
       UNION ALL SELECT 'ours', NULL, s.file_name, f.key, f.state FROM f_sheets f JOIN f_scans s ON s.scan_id = f.scan_id WHERE f.state IN ('no_record', 'duplicate', 'not_read')""",
)
def _(t):
    joined = stored_states(t)
    theirs = joined.where("scan_id IS NULL").select(
        F.lit("external").alias("side"), "row_id", F.lit(None).cast("string").alias("file_name"), "key", F.col("state").alias("reason")
    )
    ours = joined.where("scan_id IS NOT NULL AND state IN ('no_record', 'duplicate', 'not_read')").join(
        t.scans.select("scan_id", "file_name"), "scan_id"
    )
    return theirs.unionByName(
        ours.select(F.lit("ours").alias("side"), F.lit(None).cast("string").alias("row_id"), "file_name", "key", F.col("state").alias("reason"))
    )


_BAND = "CASE WHEN l.n IS NOT NULL AND NOT CONTAINS(l.n, f.name) THEN 'outside' ELSE f.state END"


@query(
    "fn_band_fields",
    f"""SELECT state, COUNT(*) AS n FROM (SELECT {_BAND} AS state FROM f_fields f LEFT JOIN (SELECT p.scan_id, COALESCE(t.names, o.names) AS n FROM
         (SELECT scan_id, MAX(external) FILTER (name = 'q1') AS theirs, MAX(ours) FILTER (name = 'q1') AS ours FROM f_fields GROUP BY 1) p
         LEFT JOIN (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) t(level, names) ON t.level = UPPER(theirs)
         LEFT JOIN (VALUES ('A', 'q1,q2,q3,q4'), ('N', 'q5,q6,q7'), ('R', 'q2,q6')) o(level, names) ON o.level = ours) l ON l.scan_id = f.scan_id) x GROUP BY 1""",
)
def _(t):
    return listing.counts_by(fields(t, bands=vl.parse_bands(BANDS), band_field="q1"), "state")


# ---- decisions ----------------------------------------------------------------------------

VIEWS["f_log"] = """SELECT (scan_id * 10 + place) * 3 + k AS id, scan_id, name, 'u' || (scan_id % 6) AS "user", CASE WHEN k = 0 THEN 'external' WHEN (scan_id + place) % 4 = 0 THEN NULL
  WHEN (scan_id + place) % 4 = 1 THEN 'ours' WHEN (scan_id + place) % 4 = 2 THEN 'external' ELSE 'manual' END AS source, CASE WHEN k = 1 AND (scan_id + place) % 4 = 3 THEN 'AR' END AS value
  FROM f_cmp CROSS JOIN RANGE(0, 2) r(k) WHERE (scan_id + place) % 5 <> 0"""
VIEWS["f_decided"] = """SELECT i.*, CASE d.source WHEN 'external' THEN i.external WHEN 'ours' THEN i.ours WHEN 'manual' THEN d.value END AS chosen, d.source,
  CASE WHEN d.source IS NOT NULL THEN d."user" END AS decided_by FROM f_cmp i LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id, name ORDER BY id DESC) AS rk FROM f_log) d
  ON d.scan_id = i.scan_id AND d.name = i.name AND d.rk = 1"""


def decision_log(items):
    """Two decisions per item for four of five items: first theirs, then one of four."""
    total = F.col("scan_id") + F.col("place")
    case = total % 4
    later = F.when(case == 1, "ours").when(case == 2, "external").when(case == 3, "manual")
    k = F.col("k")
    return items.where(total % 5 != 0).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        ((F.col("scan_id") * 10 + F.col("place")) * 3 + k).alias("id"),
        "scan_id",
        "name",
        F.concat(F.lit("u"), (F.col("scan_id") % 6).cast("string")).alias("user"),
        F.when(k == 0, "external").otherwise(later).alias("source"),
        F.when((k == 1) & (case == 3), "AR").alias("value"),
    )


def decided(t: Tables):
    items = stored_items(t)
    return compare.decide(items, decision_log(items))


_START, _LOCK = 1704067200000000, 3 * 86400


# Four events on every sheet, and decisions some minutes to hours after one of them; the same text in both dialects
_EVENT_US = f"{_START} + (scan_id * 104729 + j * 7000) % 2592000 * CAST(1000000 AS BIGINT)"
_DECIDED_US = f"{_START} + ((scan_id * 104729 + id % 3 * 7000) % 2592000 + CAST(SUBSTR(name, 2) AS BIGINT) * 997 + scan_id % 3600) * CAST(1000000 AS BIGINT)"
_EVENT_USER = "CASE WHEN j = 0 THEN CONCAT('u', CAST(scan_id % 6 AS STRING)) ELSE CONCAT('v', CAST(scan_id % 211 AS STRING)) END"


@query(
    "cp_decide",
    f"""WITH c AS (SELECT scan_id * 4 + j AS id, scan_id, {_EVENT_USER} AS "user", CASE WHEN j = 2 THEN 'release' ELSE 'claim' END AS action, {_EVENT_US} AS us FROM (SELECT DISTINCT scan_id FROM f_cmp) x, RANGE(0, 4) r(j)),
       s AS (SELECT *, LEAD(us) OVER (PARTITION BY scan_id ORDER BY us, id) AS sheet_next FROM c), u AS (SELECT *, LEAD(us) OVER (PARTITION BY "user" ORDER BY us, id) AS user_next FROM s WHERE action = 'claim'),
       h AS (SELECT scan_id, "user", us, LEAST(us + {_LOCK * 1000000 + 1}, COALESCE(sheet_next, us + {_LOCK * 1000000 + 1}), COALESCE(user_next, us + {_LOCK * 1000000 + 1})) AS until FROM u),
       d AS (SELECT l.*, {_DECIDED_US} AS us FROM f_log l),
       g AS (SELECT d.*, (SELECT MAX(h."user") FROM h WHERE h.scan_id = d.scan_id AND h.us <= d.us AND d.us < h.until AND h."user" <> d."user") AS holder FROM d),
       z AS (SELECT scan_id, name, arg_max({{'source': source, 'value': value, 'who': "user"}}, id) FILTER (holder IS NULL) AS e, COUNT(holder) AS refused, arg_max(holder, id) FILTER (holder IS NOT NULL) AS held_by FROM g GROUP BY ALL)
       SELECT i.scan_id, i.name, i.external, i.ours, CASE e.source WHEN 'external' THEN i.external WHEN 'ours' THEN i.ours WHEN 'manual' THEN e.value END AS chosen, e.source AS source,
         CASE WHEN e.source IS NOT NULL THEN e.who END AS decided_by, COALESCE(refused, 0) AS refused, held_by FROM f_cmp i LEFT JOIN z ON z.scan_id = i.scan_id AND z.name = i.name""",
)
def _(t):
    items = stored_items(t)
    log = decision_log(items).withColumn("us", F.expr(_DECIDED_US))
    events = items.select("scan_id").distinct().withColumn("j", F.explode(F.array(*map(F.lit, range(4)))))
    action = F.when(F.col("j") == 2, "release").otherwise("claim")
    events = events.select((F.col("scan_id") * 4 + F.col("j")).alias("id"), "scan_id", F.expr(_EVENT_USER).alias("user"), action.alias("action"), F.expr(_EVENT_US).alias("us"))
    return compare.decide(items, log, events, _LOCK).drop("place")


@query("wn_last_decision", "SELECT scan_id, name, source, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id, name ORDER BY id DESC) AS rk FROM f_log) l WHERE rk = 1")
def _(t):
    log = decision_log(stored_items(t))
    return listing.newest(log.select("scan_id", "name", "id", "source", "value"), ["scan_id", "name"], F.col("id")).drop("id")


VIEWS["f_audit"] = """SELECT l.id, l.scan_id, l.name, l."user", i.external, i.ours, CASE l.source WHEN 'external' THEN i.external WHEN 'ours' THEN i.ours WHEN 'manual' THEN l.value END AS chosen, l.source,
  CASE WHEN l.source IS NULL THEN 'undo' ELSE 'decide' END AS action FROM (SELECT *, LAG(source) OVER w AS before, ROW_NUMBER() OVER w AS i FROM f_log WINDOW w AS (PARTITION BY scan_id, name ORDER BY id)) l
  JOIN f_cmp i ON i.scan_id = l.scan_id AND i.name = l.name WHERE CASE WHEN l.i = 1 THEN l.source IS NOT NULL ELSE l.source IS DISTINCT FROM l.before END"""


@query("cp_audit_export", "SELECT a.*, s.file_name FROM f_audit a LEFT JOIN f_scans s ON s.scan_id = a.scan_id")
def _(t):
    items = stored_items(t)
    audit = compare.decision_audit(items, decision_log(items))
    return audit.join(t.scans.select("scan_id", "file_name"), "scan_id", "left")


@query(
    "ag_cmp_progress",
    """SELECT (SELECT COUNT(*) FROM f_decided) AS mismatches, (SELECT COUNT(*) FROM f_decided WHERE source IS NOT NULL) AS decided, (SELECT COUNT(*) FROM f_decided WHERE source = 'external') AS chose_external,
       (SELECT COUNT(*) FROM f_all_states WHERE scan_id IS NULL) AS unmatched_external, (SELECT COUNT(*) FROM f_sheets WHERE state = 'pending') AS to_review""",
)
def _(t):
    joined, items = stored_states(t), stored_items(t)
    chosen = compare.decide(items, decision_log(items))
    unmatched = joined.where("scan_id IS NULL").agg(F.count("*")).scalar()
    return chosen.agg(
        F.count("*").alias("mismatches"),
        F.count("source").alias("decided"),
        F.count_if(F.col("source") == "external").alias("chose_external"),
        F.max(unmatched).alias("unmatched_external"),
        F.count_distinct("scan_id").alias("to_review"),
    )


_OLD = "SELECT scan_id, name, external, CASE WHEN scan_id % 7 = 0 THEN ours || 'x' ELSE ours END AS ours, chosen, source, decided_by FROM f_decided"


@query(
    "jn_decision_carry",
    f"""SELECT i.scan_id, i.name, o.chosen, o.source, o.decided_by FROM f_cmp i LEFT JOIN ({_OLD}) o ON o.scan_id = i.scan_id AND o.name = i.name AND o.external = i.external AND o.ours = i.ours""",
)
def _(t):
    items = stored_items(t)
    changed = F.when(F.col("scan_id") % 7 == 0, F.concat("ours", F.lit("x"))).otherwise(F.col("ours"))
    old = compare.decide(items, decision_log(items)).withColumn("ours", changed)
    return compare.carry_decisions(items, old).select("scan_id", "name", "chosen", "source", "decided_by")


@query(
    "cp_review_state",
    """SELECT s.scan_id, COUNT(d.source) AS decided, CASE WHEN s.state <> 'pending' THEN s.state WHEN COUNT(d.source) >= s.mismatches THEN 'done' WHEN COUNT(d.source) > 0 THEN 'partial' ELSE 'pending' END AS state
       FROM f_sheets s LEFT JOIN f_decided d ON d.scan_id = s.scan_id GROUP BY s.scan_id, s.state, s.mismatches""",
)
def _(t):
    sheets, items = sheets_and_items(t)
    chosen = compare.decide(items, decision_log(items))
    return compare.review_state(sheets, chosen).select("scan_id", "decided", "state")


@query(
    "jn_out_of_scope",
    "SELECT 'sheets' AS tbl, COUNT(*) AS n FROM f_sheets WHERE scan_id IN (SELECT scan_id FROM f_scans WHERE job_id < 10) UNION ALL SELECT 'items', COUNT(*) FROM f_cmp WHERE scan_id IN (SELECT scan_id FROM f_scans WHERE job_id < 10)",
)
def _(t):
    sheets, items = sheets_and_items(t)
    gone = sheets.select("scan_id").join(t.scans.where("job_id < 10"), "scan_id", "left_anti")
    kept = listing.delete_scans({"sheets": sheets, "items": items}, gone)
    one, two = (df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n, df in kept.items())
    return one.unionByName(two)


_CHOSEN = "COALESCE(CASE WHEN d.source IS NOT NULL THEN d.chosen END, c.value)"


@query(
    "cp_reconciled",
    f"""SELECT s.scan_id, s.key, s.state, s.mismatches, x.external_kept, x.unresolved, {', '.join(f"COALESCE(x.{n}, '') AS {n}" for n in NAMES)} FROM f_sheets s LEFT JOIN
       (SELECT COALESCE(c.scan_id, d.scan_id) AS scan_id, COUNT(*) FILTER (d.source = 'external') AS external_kept, COALESCE(STRING_AGG(COALESCE(c.name, d.name), ' ' ORDER BY COALESCE(c.name, d.name)) FILTER (d.scan_id IS NOT NULL AND d.source IS NULL), '') AS unresolved,
       {', '.join(f"MAX({_CHOSEN}) FILTER (COALESCE(c.name, d.name) = '{n}') AS {n}" for n in NAMES)} FROM f_cells c FULL JOIN f_decided d ON d.scan_id = c.scan_id AND d.name = c.name GROUP BY 1) x ON x.scan_id = s.scan_id""",
)
def _(t):
    sheets, items = sheets_and_items(t)
    return compare.reconciled(sheets, t.cells, compare.decide(items, decision_log(items)), NAMES)


@query(
    "cp_to_results",
    "SELECT scan_id, name, CASE WHEN chosen <> '*' THEN chosen END AS new_value, CASE WHEN chosen = '*' THEN 'multi-mark without options' END AS refused FROM f_decided WHERE source IS NOT NULL AND (chosen = '*' OR chosen <> ours)",
)
def _(t):
    return compare.to_corrections(decided(t))


@query(
    "cp_recompare",
    "SELECT f.scan_id, f.name, f.state FROM f_fields f JOIN f_scans s ON s.scan_id = f.scan_id WHERE s.corrected = 1",
)
def _(t):
    changed = t.scans.where("corrected = 1").select("scan_id")
    again = states(t).join(changed, "scan_id", "left_semi")
    return compare.side_by_side(again, external(t), t.cells).select("scan_id", "name", "state")


# ---- locks --------------------------------------------------------------------------------

NOW = 1706655600000000  # 2024-01-30 23:00 UTC in microseconds
_CLAIMS = """SELECT id, scan_id, reviewer AS "user", CASE action WHEN 'assigned' THEN 'claim' ELSE 'release' END AS action, EPOCH_US(happened) AS us FROM f_activity WHERE action IN ('assigned', 'scanned')"""
VIEWS["f_held"] = f"""WITH c AS ({_CLAIMS}), p AS (SELECT * FROM c WHERE us <= {NOW}), l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY id DESC) AS rk FROM p) x WHERE rk = 1)
  SELECT l.scan_id, l."user" FROM l WHERE l.action = 'claim' AND l.us >= {NOW} - 86400000000 AND l.id = (SELECT MAX(p.id) FROM p WHERE p.action = 'claim' AND p."user" = l."user")"""


def claims(t: Tables):
    action = F.when(F.col("action") == "assigned", "claim").otherwise("release")
    return t.activity.where("action IN ('assigned', 'scanned')").select(
        "id", "scan_id", F.col("reviewer").alias("user"), action.alias("action"), micros("at").alias("us")
    )


def held(t: Tables):
    # A day instead of ten minutes: the table's events are minutes apart
    return compare.holders(claims(t), NOW, lock_seconds=86400)


@query("cp_lock", 'SELECT scan_id, "user" FROM f_held')
def _(t):
    return held(t)


_REQUESTS = [("u0", -1), ("u1", 100), ("u2", 700), ("u3", 10**12), ("u9", 1234)]


@query(
    "wn_claim_next",
    f"""WITH s AS (SELECT f.scan_id, h."user" FROM f_sheets f LEFT JOIN f_held h ON h.scan_id = f.scan_id WHERE f.state = 'pending')
       SELECT r.reviewer, COALESCE(MIN(s.scan_id) FILTER (s.scan_id > r.after), MIN(s.scan_id)) AS next_scan, MAX(s.scan_id) FILTER (s.scan_id < r.after) AS previous_scan
       FROM (VALUES {', '.join(f"('{u}', {a})" for u, a in _REQUESTS)}) r(reviewer, after) JOIN s ON s."user" IS NULL OR s."user" = r.reviewer GROUP BY r.reviewer""",
)
def _(t):
    sheets, _ = sheets_and_items(t)
    return compare.claim_next(sheets, held(t), _REQUESTS)


# ---- set-up -------------------------------------------------------------------------------


@query(
    "jn_match_check",
    """WITH m AS (SELECT DISTINCT key FROM f_ours WHERE job_id = 3), t AS (SELECT key FROM f_ext_rows WHERE reason IS NULL), j AS (SELECT t.key AS t, m.key AS m FROM t FULL JOIN m ON m.key = t.key)
       SELECT COUNT(*) FILTER (t IS NOT NULL AND m IS NOT NULL) AS matched, COUNT(*) FILTER (m IS NULL) + (SELECT COUNT(*) FROM f_ext_rows WHERE reason IS NOT NULL) AS their_unmatched, COUNT(*) FILTER (t IS NULL) AS our_unmatched,
       MIN(CAST(t AS BIGINT)) AS their_first, MAX(CAST(t AS BIGINT)) AS their_last, MIN(CAST(m AS BIGINT)) AS our_first, MAX(CAST(m AS BIGINT)) AS our_last FROM j""",
)
def _(t):
    return compare.match_check(t.scans, ext_rows(t), 3)


@query(
    "jn_other_jobs",
    """SELECT job_id, COUNT(DISTINCT key) AS rows FROM f_ours WHERE job_id <> 3 AND key IN (SELECT key FROM f_ext_rows WHERE reason IS NULL) AND key NOT IN (SELECT key FROM f_ours WHERE job_id = 3)
       GROUP BY 1 ORDER BY rows DESC, job_id LIMIT 3""",
)
def _(t):
    return compare.other_jobs(t.scans, ext_rows(t), 3)


_ASKED = ["S00042", "S0000", "42", "#3", "#999999999", "nowhere", "33"]


def _found_sql(text: str) -> str:
    if text.startswith("#"):
        n = f"(SELECT scan_id, file_name, state FROM z WHERE state = 'pending' QUALIFY ROW_NUMBER() OVER (ORDER BY scan_id) = {text[1:]})"
        return f"""SELECT '{text}' AS asked, r.scan_id, r.file_name, r.state, CASE WHEN r.scan_id IS NULL THEN 'there are ' || (SELECT COUNT(*) FROM z WHERE state = 'pending') || ' sheets to review' END AS problem FROM (SELECT 1) o LEFT JOIN {n} r ON TRUE"""
    digits = "".join(c for c in text if c.isdigit())
    low, key = text.lower(), digits.lstrip("0") or digits[:1]
    hits = f"SELECT *, CASE WHEN '{key}' <> '' AND key = '{key}' THEN 1 WHEN LOWER(file_name) = '{low}' THEN 2 WHEN CONTAINS(LOWER(file_name), '{low}') THEN 3 END AS rank FROM z"
    best = f"SELECT * FROM ({hits}) h WHERE rank IS NOT NULL QUALIFY rank = MIN(rank) OVER ()"
    return f"""SELECT '{text}' AS asked, CASE WHEN ready = 1 THEN one.scan_id END AS scan_id, CASE WHEN ready = 1 THEN one.file_name END AS file_name, CASE WHEN ready = 1 THEN one.state END AS state,
         CASE WHEN n = 0 THEN 'no sheet matches' WHEN ready = 0 THEN other.file_name || ' has nothing to review: ' || other.state WHEN ready > 1 THEN ready || ' sheets match' END AS problem
       FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (state = 'pending') AS ready, arg_min({{'scan_id': scan_id, 'file_name': file_name, 'state': state}}, scan_id) FILTER (state = 'pending') AS one,
         arg_min({{'scan_id': scan_id, 'file_name': file_name, 'state': state}}, scan_id) AS other FROM ({best}) b) c"""


@query(
    "jn_find_sheet",
    "WITH z AS (SELECT s.scan_id, s.key, o.file_name, s.state FROM f_sheets s JOIN f_ours o ON o.scan_id = s.scan_id) " + " UNION ALL ".join(map(_found_sql, _ASKED)),
)
def _(t):
    sheets, _ = sheets_and_items(t)
    named = hand_over(sheets.join(t.scans.select("scan_id", "file_name"), "scan_id").select("scan_id", "key", "file_name", "state"), "named")
    parts = [compare.find_sheet(named, text).withColumn("asked", F.lit(text)) for text in _ASKED]
    return reduce(DataFrame.unionByName, parts)


_COLS = """SELECT DISTINCT CASE pos % 3 WHEN 0 THEN 'Q-0' || pos WHEN 1 THEN CAST(pos AS VARCHAR) ELSE 'q' || LPAD(CAST(pos AS VARCHAR), 3, '0') END AS "column" FROM f_cells UNION SELECT 'Extra 9'"""


@query("jn_name_mapping", f"""SELECT c."column", n.name FROM ({_COLS}) c JOIN (SELECT DISTINCT name, pos FROM f_cells) n ON n.pos = CAST(regexp_replace(c."column", '[^0-9]', '', 'g') AS INTEGER) WHERE c."column" <> 'Extra 9'""")
def _(t):
    pos = F.col("pos").cast("string")
    column = (
        F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Q-0"), pos))
        .when(F.col("pos") % 3 == 1, pos)
        .otherwise(F.concat(F.lit("q"), F.lpad(pos, 3, "0")))
    )
    columns = t.cells.select(column.alias("column")).distinct().union(t.spark.range(1).select(F.lit("Extra 9")))
    return compare.suggest_mapping(columns, t.cells.select("name").distinct())


@query("jn_key_suggest", """SELECT 'Roll' AS "column", 'digits' AS normalize FROM (SELECT 1 FROM f_labels WHERE "column" = 'Roll' LIMIT 1) x""")
def _(t):
    found = labels(t).groupBy("column").agg(F.min("sheet").alias("place"))
    return compare.suggest_key(found)


VIEWS["f_decoded"] = """SELECT c_custkey AS sheet, CASE WHEN c_custkey % 13 = 0 THEN '*' ELSE RIGHT(c_name, 6) END AS g1, CAST(c_nationkey AS VARCHAR) AS g2, CAST((c_nationkey + c_custkey) % 25 AS VARCHAR) AS g3, ' ' || LPAD(CAST(c_nationkey AS VARCHAR), 2, '0') AS g4 FROM customer"""


@query(
    "jn_grid_column",
    """WITH l AS (SELECT c_custkey AS sheet, RIGHT(c_name, 6) AS roll, CAST(c_nationkey AS VARCHAR) AS score, '' AS void FROM customer),
       p AS (SELECT 'g1' AS grid, g1 AS d, sheet FROM f_decoded UNION ALL SELECT 'g2', g2, sheet FROM f_decoded UNION ALL SELECT 'g3', g3, sheet FROM f_decoded UNION ALL SELECT 'g4', g4, sheet FROM f_decoded),
       k AS (SELECT 'roll' AS "column", roll AS v, sheet FROM l UNION ALL SELECT 'score', score, sheet FROM l),
       s AS (SELECT grid, "column", COUNT(*) AS checked, ROUND(COUNT(*) FILTER (d = v OR TRIM(d) = v OR (NOT CONTAINS(d, '*') AND LTRIM(TRIM(d), '0') = LTRIM(v, '0') AND LENGTH(TRIM(d)) <= LENGTH(v) + 1)) / COUNT(*), 6) AS score FROM p JOIN k USING (sheet) GROUP BY 1, 2)
       SELECT grid, "column", checked, score FROM s WHERE score >= 0.8 QUALIFY ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY score DESC, grid) = 1""",
)
def _(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    roll = F.right("c_name", F.lit(6))
    decoded = t.raw("customer").select(
        key.alias("sheet"),
        F.when(key % 13 == 0, "*").otherwise(roll).alias("g1"),
        nation.cast("string").alias("g2"),
        ((nation + key) % 25).cast("string").alias("g3"),
        F.concat(F.lit(" "), F.lpad(nation.cast("string"), 2, "0")).alias("g4"),
    )
    label = t.raw("customer").select(
        key.alias("sheet"), roll.alias("roll"), nation.cast("string").alias("score"), F.lit("").alias("void")
    )
    return compare.match_grids(decoded, label, ["g1", "g2", "g3", "g4"], ["roll", "score", "void"])
