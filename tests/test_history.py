"""Undo folds, settling files and reconciliation states against plain loops."""

import random

from pyspark.sql import functions as F

from answerlake.operators import compare, export, review, scoring
from answerlake.streaming import intake


def test_undo_fold(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 2, 3]), i, rng.choice(["edit", "edit", "undo", "redo"])) for i in range(1, 600)]
    want = {}
    for scan in (1, 2, 3):
        now, undo, redo = 0, [], []
        for s, i, action in rows:
            if s != scan:
                continue
            if action == "edit":
                undo, now, redo = (undo + [now])[-20:], i, []
            elif action == "undo" and undo:
                redo.append(now)
                now = undo.pop()
            elif action == "redo" and redo:
                undo.append(now)
                now = redo.pop()
        want[scan] = (now, len(undo), len(redo))
    df = spark.createDataFrame(rows, "scan_id bigint, id bigint, action string").orderBy(F.rand(1))
    out = {r["scan_id"]: (r["version"], r["undo_steps"], r["redo_steps"]) for r in review.current_versions(df).collect()}
    assert out == want


def looks(*rows):
    return rows


def settled(rows, settle=3, give_up=120):
    """(at, size, gave up) of rows (size, complete, at) of one path whose changes lie long back."""
    patience, known, out = intake.Patience(settle, give_up, 10**6), dict.fromkeys(part.split()[0] for part in intake.KNOWN.split(", ")), []
    for size, whole, at in rows:
        known, early = patience.until(known, at)
        known, now = patience.look(known, size, -(10**6), whole, at)
        out += [(o[2], o[0], o[3]) for o in (early, now) if o]
    return out


def test_settle_rules():
    assert settled(looks((5, True, 0), (5, True, 2), (5, True, 3), (5, True, 9))) == [(3, 5, False)]
    assert settled(looks((5, True, 0), (6, True, 2), (6, True, 4), (6, True, 5))) == [(5, 6, False)]
    assert settled(looks((5, False, 0), (5, False, 60), (5, False, 120))) == [(120, 5, True)]
    assert settled(looks((0, True, 0), (0, True, 9))) == []
    # Replaced after it was handed over
    assert settled(looks((5, True, 0), (5, True, 3), (7, True, 5), (7, True, 8))) == [(3, 5, False), (8, 7, False)]


def test_states(spark):
    sheets = spark.createDataFrame(
        [(1, "5", "ok", 1), (2, "5", "ok", 2), (3, "6", "error", 1), (4, "", "ok", 1), (5, "9", "ok", 1), (6, "7", "ok", 1)],
        "scan_id bigint, key string, status string, created_at int",
    )
    rows = spark.createDataFrame(
        [("r5", "5", None), ("r6", "6", None), ("r7a", "7", "duplicate key"), ("r8", "8", None), ("r0", "", "no key")],
        "row_id string, key string, reason string",
    )
    out = {(r["scan_id"], r["row_id"]): r["state"] for r in compare.sheet_states(sheets, rows).collect()}
    assert out == {
        (1, "r5"): "replaced",
        (2, "r5"): "matched",
        (3, "r6"): "not_read",
        (4, None): "no_record",
        (5, None): "no_record",
        (6, None): "no_record",
        (None, "r6"): "no sheet",
        (None, "r8"): "no sheet",
        (None, "r7a"): "duplicate key",
        (None, "r0"): "no key",
    }
    skipped = {r["scan_id"]: r["state"] for r in compare.sheet_states(sheets, rows, "skip").collect() if r["scan_id"]}
    assert skipped[1] == skipped[2] == "duplicate"


def test_export_plan():
    profile = export.Profile(("scan_id", "score"), ({"field": "q2", "header": "q1"}, {"field": "zz"}, {"field": "roll", "type": "int"}), include_others=True, flags=True)
    columns, warnings = export.plan(profile, ["roll", "q1", "q2"], {"roll": ["r1", "r2"]}, sections=["S"], bands=True)
    assert [c.key for c in columns] == ["scan_id", "score", "score_S", "score_band", "q1", "q1_flags", "zz", "zz_flags", "roll", "roll_flags", "q1_2", "q1_flags_2"]
    assert len(warnings) == 2
    assert export.output_columns(["q10", "q2", "r1", "r2"], {"roll": ["r1", "r2"]}, ["final"]) == ["q2", "q10", "roll", "final"]


def test_a_sheet_someone_else_holds_is_refused(spark):
    second = 1_000_000
    claims = spark.createDataFrame(
        [(1, 7, "asha", "claim", 0), (2, 8, "ravi", "claim", 0), (3, 7, "asha", "release", 300 * second), (4, 8, "asha", "claim", 5000 * second), (5, 9, "asha", "claim", 5010 * second), (6, 9, "ravi", "claim", 5010 * second)],
        "id long, scan_id long, user string, action string, us long",
    )
    spans = {(r["scan_id"], r["user"], r["us"] // second): r["until"] for r in compare.hold_intervals(claims).collect()}
    assert spans == {
        (7, "asha", 0): 300 * second, (8, "ravi", 0): 600 * second + 1, (8, "asha", 5000): 5010 * second, (9, "asha", 5010): 5010 * second, (9, "ravi", 5010): 5610 * second + 1,
    }
    items = spark.createDataFrame([(s, n, "E", "O") for s in (7, 8, 9) for n in ("q1", "q2")], "scan_id long, name string, external string, ours string")
    log = spark.createDataFrame(
        [
            (1, 7, "q1", "ravi", "ours", None, 100),  # asha holds it
            (2, 7, "q1", "asha", "external", None, 120),
            (3, 7, "q2", "ravi", "ours", None, 300),  # released
            (4, 8, "q1", "asha", "ours", None, 600),  # ravi's claim is just fresh
            (5, 8, "q2", "asha", "manual", "M", 601),  # stale now
            (6, 8, "q2", "ravi", "ours", None, 5005),
            (7, 9, "q1", "asha", None, None, 5011),  # an undo counts as a decision
        ],
        "id long, scan_id long, name string, user string, source string, value string, us long",
    ).withColumn("us", F.col("us") * second)
    out = {(r["scan_id"], r["name"]): (r["chosen"], r["decided_by"], r["refused"], r["held_by"]) for r in compare.decide(items, log, claims).collect()}
    assert out == {
        (7, "q1"): ("E", "asha", 1, "asha"), (7, "q2"): ("O", "ravi", 0, None), (8, "q1"): (None, None, 1, "ravi"),
        (8, "q2"): ("M", "asha", 1, "asha"), (9, "q1"): (None, None, 1, "ravi"), (9, "q2"): (None, None, 0, None),
    }


def test_regrade_keeps_and_drops_corrections(spark):
    before = spark.createDataFrame([(1, "q1", "A"), (1, "q2", "B"), (1, "q3", ""), (2, "q1", "A"), (3, "q1", "B")], "scan_id long, name string, value string")
    log = spark.createDataFrame(
        [(1, "q1", 1, "B"), (1, "q1", 2, "C"), (1, "q2", 3, "A"), (1, "q2", 4, "B"), (1, "q3", 5, "D"), (2, "q9", 6, "X")],
        "scan_id long, name string, id long, new_value string",
    )
    fresh = spark.createDataFrame([(1, "q1", "C"), (1, "q2", "D"), (2, "q1", "B"), (3, "q1", "B")], "scan_id long, name string, value string")
    key = scoring.answer_key(spark, [("q1", 1, "DEFAULT", "A", 1.0), ("q3", 3, "DEFAULT", "D", 1.0)])
    new = scoring.answer_key(spark, [("q1", 1, "DEFAULT", "C", 1.0), ("q2", 2, "DEFAULT", "D", 2.0)])
    rows = {(r["scan_id"], r["name"]): (r["old_value"], r["new_value"], r["kept"], r["dropped"]) for r in scoring.merge_reads(before, log, fresh).collect()}
    assert rows == {
        (1, "q1"): ("C", "C", True, False), (1, "q2"): ("B", "D", False, False), (1, "q3"): ("D", None, False, True),
        (2, "q1"): ("A", "B", False, False), (2, "q9"): ("X", None, False, True), (3, "q1"): ("B", "B", False, False),
    }
    wrong = scoring.SCHEMES["DEFAULT"][1]
    out = {r["scan_id"]: (r["score_before"], r["score_after"], r["kept"], r["dropped"]) for r in scoring.regrade(before, log, fresh, key, new).collect()}
    assert out == {1: (wrong + 1, 3.0, ["q1"], ["q3"]), 2: (1.0, wrong, [], ["q9"])}
