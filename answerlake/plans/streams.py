"""Streaming queries: the given tables replayed as streams of files."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from answerlake.functions import text as tx
from answerlake.operators import measure
from answerlake.plans.decoding import pages
from answerlake.plans.derived import Tables
from answerlake.plans.registry import query
from answerlake.session import scratch
from answerlake.streaming import intake


def events(t: Tables):
    """The events table as a stream of files."""
    schema = t.raw("events").schema
    stream = intake.watch(t.spark, t.sf_dir, schema, glob="events*.parquet")
    return stream.withColumn("time", intake.utc("ts")).withColumn("job", F.col("user_id") % 20)


def stored(t: Tables, stream, name: str):
    out = intake.run_to_files(stream, name)
    return t.spark.read.schema(stream.schema).parquet(out)


@query("sm_counts", "SELECT user_id % 20 AS job, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return intake.live_counts(events(t).select("job", "event_type"), ["job", "event_type"])


@query("sm_incremental", "SELECT user_id % 20 AS job, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id FROM events GROUP BY 1")
def _(t):
    rows = stored(t, events(t).select("job", "event_id"), "incremental")
    return rows.groupBy("job").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    "sm_dedupe",
    """SELECT SUBSTR(SHA1(CAST(user_id % 20 AS VARCHAR) || ':' || CAST(event_id % 400 AS VARCHAR) || ':0'), 1, 32) AS id, MAX(event_id) AS event_id, ARG_MAX(event_type, event_id) AS event_type FROM events GROUP BY 1""",
)
def _(t):
    ident = tx.stable_id(F.col("job"), F.col("event_id") % 400, F.lit(0))
    reads = events(t).select(ident.alias("id"), "event_id", "event_type")
    return intake.newest_of_each(reads, "id", "event_id")


_MARK = "(SELECT MAX(EPOCH_US(ts)) // 1000 * 1000 - 3600000000 FROM events)"


def _window_sql(hours: int, slide: int, kind: str) -> str:
    h, s = hours * 3600000000, slide * 3600000000
    return f"""SELECT '{kind}' AS kind, start AS start_us, start + {h} AS end_us, event_type AS who, COUNT(*) AS n FROM (SELECT event_type, UNNEST([EPOCH_US(ts) // {s} * {s} - k * {s} FOR k IN RANGE(0, {hours // slide})]) AS start FROM events) w
      WHERE start + {h} <= {_MARK} GROUP BY ALL"""


@query(
    "sm_activity_windows",
    f"""{_window_sql(6, 6, 'tumbling')} UNION ALL {_window_sql(6, 2, 'sliding')} UNION ALL
      SELECT 'session', MIN(us), MAX(us) + 7200000000, event_type, COUNT(*) FROM (SELECT event_type, us, SUM(CASE WHEN us - before < 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS spell FROM
      (SELECT event_type, EPOCH_US(ts) AS us, LAG(EPOCH_US(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events) a) b GROUP BY event_type, spell HAVING MAX(us) + 7200000000 <= {_MARK}""",
)
def _(t):
    stream = events(t).select("time", F.col("event_type").alias("who"))
    parts = {
        "tumbling": intake.windows(stream, "time", "6 hours", None, "1 hour", "who"),
        "sliding": intake.windows(stream, "time", "6 hours", "2 hours", "1 hour", "who"),
        "session": intake.sessions(stream, "time", "2 hours", "1 hour", "who"),
    }
    out = None
    for kind, part in parts.items():
        rows = stored(t, part, kind).select(
            F.lit(kind).alias("kind"),
            F.unix_micros("start").alias("start_us"),
            F.unix_micros("end").alias("end_us"),
            "who",
            "n",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sm_watch", "SELECT job_id, COUNT(*) AS files, MIN(file_name) AS first_file FROM f_scans GROUP BY 1")
def _(t):
    folder, root = scratch(t.spark, "inbox"), scratch(t.spark, "watched")
    inbox = intake.Inbox(t.spark, folder, "file_name string, job_id bigint", root, "json", most=40)
    # Sheets of half the jobs arrive after the first look
    for half in (0, 1):
        t.scans.where(F.col("job_id") % 2 == half).select("job_id", "file_name").repartition("job_id").write.mode("append").json(folder)
        inbox.look_until_empty()
    rows = inbox.rows()
    return rows.groupBy("job_id").agg(F.count("*").alias("files"), F.min("file_name").alias("first_file"))


def settle_sql(settle: int, give_up: int, forget: int) -> str:
    """The rules of `intake.settle` as a recursion over the looks of each path, in microseconds."""
    due = f"GREATEST(waiting + {give_up}, still + {settle}, changed + {settle})"
    return f"""WITH RECURSIVE l AS (SELECT CONCAT('in/', user_id) AS path, CAST(FLOOR(value / 100) AS BIGINT) AS size, EPOCH_US(ts) // {_CHANGE} * {_CHANGE} AS changed, event_type <> 'error' AS complete, EPOCH_US(ts) AS us FROM events),
      n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY path ORDER BY us, changed, size, complete) AS i FROM l),
      s AS (SELECT DISTINCT path, 0::BIGINT AS i, NULL::BIGINT AS size, NULL::BIGINT AS changed, NULL::BIGINT AS still, NULL::BIGINT AS waiting, NULL::BOOLEAN AS whole, NULL::BIGINT AS done_size, NULL::BIGINT AS done_changed, NULL::BIGINT AS looked,
          NULL::STRUCT(size BIGINT, changed BIGINT, us BIGINT, gave_up BOOLEAN) AS o1, NULL::STRUCT(size BIGINT, changed BIGINT, us BIGINT, gave_up BOOLEAN) AS o2 FROM n
        UNION ALL SELECT path, i, CASE WHEN kind = 'new' OR kind = 'same' THEN nsize END, nchanged, CASE WHEN kind = 'new' THEN us ELSE still END, CASE WHEN kind = 'new' AND size IS NULL THEN us ELSE waiting END, complete,
          CASE WHEN kind = 'ready' THEN nsize ELSE done_size END, CASE WHEN kind = 'ready' THEN nchanged ELSE done_changed END, us, o1,
          CASE WHEN kind = 'ready' THEN {{'size': nsize, 'changed': nchanged, 'us': us, 'gave_up': NOT complete}} END
        FROM (SELECT *, CASE WHEN nsize = done_size AND nchanged = done_changed THEN 'known' WHEN size IS NULL OR nsize <> size OR nchanged <> changed THEN 'new'
            WHEN nsize > 0 AND us - GREATEST(still, changed) >= {settle} AND (complete OR us - waiting >= {give_up}) THEN 'ready' ELSE 'same' END AS kind
          FROM (SELECT path, i, us, nsize, nchanged, complete, o1, CASE WHEN gone THEN NULL ELSE size END AS size, changed, still, waiting, CASE WHEN gone THEN NULL ELSE done_size END AS done_size, CASE WHEN gone THEN NULL ELSE done_changed END AS done_changed
            FROM (SELECT *, COALESCE(NOT COALESCE(size > 0, FALSE) AND looked + {forget} < us, FALSE) AS gone
              FROM (SELECT path, i, us, nsize, nchanged, complete, CASE WHEN fired THEN NULL ELSE size END AS size, changed, still, waiting, CASE WHEN fired THEN size ELSE done_size END AS done_size, CASE WHEN fired THEN changed ELSE done_changed END AS done_changed,
                  CASE WHEN fired THEN due ELSE looked END AS looked, CASE WHEN fired THEN {{'size': size, 'changed': changed, 'us': due, 'gave_up': NOT whole}} END AS o1
                FROM (SELECT s.path, n.i, n.us, n.size AS nsize, n.changed AS nchanged, n.complete, s.size, s.changed, s.still, s.waiting, s.whole, s.done_size, s.done_changed, s.looked, {due.replace("waiting", "s.waiting").replace("still", "s.still").replace("changed", "s.changed")} AS due,
                    COALESCE(s.size > 0 AND due < n.us, FALSE) AS fired FROM s JOIN n ON n.path = s.path AND n.i = s.i + 1) a) b) c) d) e),
      last AS (SELECT path, size, changed, {due} AS us, NOT whole AS gave_up FROM s WHERE size > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY path ORDER BY i DESC) = 1 AND i = (SELECT MAX(i) FROM n WHERE n.path = s.path))
      SELECT path, o.size, o.changed, o.us AS "at", o.gave_up FROM (SELECT path, o1 AS o FROM s UNION ALL SELECT path, o2 FROM s) WHERE o IS NOT NULL
      UNION ALL SELECT path, size, changed, us AS "at", gave_up FROM last WHERE (us + 999) // 1000 < (SELECT MAX(us) FROM l) // 1000"""


_CHANGE = 6 * 3600 * 1_000_000


@query("sm_settle", settle_sql(3600 * 1_000_000, 86400 * 1_000_000, 3 * 86400 * 1_000_000))
def _(t):
    # A user stands for a path; what is written to it changes every six hours
    at = F.unix_micros("time")
    looks = events(t).select(
        F.concat(F.lit("in/"), F.col("user_id").cast("string")).alias("path"),
        F.floor(F.col("value") / 100).cast("bigint").alias("size"),
        F.timestamp_micros(at - at % _CHANGE).alias("changed"),
        (F.col("event_type") != "error").alias("complete"),
        F.col("time").alias("at"),
    )
    return stored(t, intake.settle(looks, 3600, 86400, 3 * 86400), "settled")


@query("sm_rescan", "SELECT job_id, seq, file_name FROM f_scans GROUP BY ALL HAVING BOOL_OR(status = 'error') AND NOT BOOL_OR(verified = 1)")
def _(t):
    files = t.scans_seq.select("job_id", "seq", "file_name")
    return intake.requeue(files, t.scans_seq)


def patient(item: dict):
    """A raster whose missing pixels are waited for, as a codec waits for the rest of a file."""
    while len(item["pixels"]) < item["height"] * item["width"]:
        time.sleep(0.05)
    return np.frombuffer(item["pixels"], np.uint8).reshape(item["height"], item["width"])


@query("sm_timeout", "SELECT DISTINCT scan_id, CASE WHEN scan_id % 2900 = 0 THEN 'not read within 3 s' ELSE 'no pixels' END AS error, 'error' AS status FROM f_cells WHERE scan_id % 29 = 0")
def _(t):
    # A sheet cut short keeps its reader waiting, an empty one is refused at once
    broken, hangs = F.col("scan_id") % 29 == 0, F.col("scan_id") % 2900 == 0
    rows = pages(t).withColumn("pixels", F.when(hangs, F.substring("pixels", 1, 100)).when(broken, F.lit(b"")).otherwise(F.col("pixels")))

    def raster(item: dict):
        if not item["pixels"]:
            raise ValueError("no pixels")
        return patient(item)

    return intake.error_rows(measure.quality_in_time(rows, 3, raster))
