"""The results index: views, facets, duplicates, queues, assignments and activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlake.operators import ranking

# Fixed value: order of review kinds by risk.
RISK = ("sheet", "check", "custom_label", "zone")
NAME_FACETS, FLAG_FACETS = 500, 200  # the facet lists are top-k reports
SEP = "\x1f"


def equal(df: DataFrame, **filters) -> DataFrame:
    """Keep rows equal on every given column; None or '' sets no condition."""
    for name, value in filters.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == F.lit(value))
    return df


def _settled() -> Column:
    return (F.col("flag_count") > 0) & (F.col("review_count") == 0)


def is_open() -> Column:
    """An assigned sheet its person has not finished."""
    return (F.col("verified") == 0) & ~_settled()


def view(name: str) -> Column:
    """Row predicate of a named view (the two duplicate views are joins, see duplicates)."""
    verified = F.col("verified") == 1
    return {
        "all": lambda: F.lit(True),
        "flagged": lambda: (F.col("flag_count") > 0) & ~verified,
        "unflagged": lambda: (F.col("flag_count") == 0) | verified,
        "reviewed": lambda: verified | _settled(),
        "not_reviewed": is_open,
        "verified": lambda: verified,
        "approved": lambda: F.col("approved") == 1,
        "corrected": lambda: F.col("corrected") == 1,
        "errors": lambda: F.col("status") == "error",
    }[name]()


COUNTED_VIEWS = ("flagged", "unflagged", "reviewed", "not_reviewed", "approved", "corrected")


def file_contains(part: str) -> Column:
    """Case-insensitive substring match without wildcards."""
    return F.lower("file_name").contains(part.lower())


def duplicates(scans: DataFrame, scope: str = "job_id") -> DataFrame:
    """Scans sharing their primary key within a job (no job counts as one) or a template.

    Keys are counted before anything is joined, so a hot key is one pre-aggregated row.
    """
    keyed = scans.where(F.col("primary_key").isNotNull())
    if scope != "job_id":
        keyed = keyed.where(F.col(scope).isNotNull())
    shared = keyed.groupBy(F.col(scope).alias("_scope"), F.col("primary_key").alias("_key")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    on = keyed[scope].eqNullSafe(F.col("_scope")) & (keyed["primary_key"] == F.col("_key"))
    return keyed.join(shared.where("_n > 1"), on, "left_semi")


def duplicate_summary(scans: DataFrame, scope: str = "job_id") -> DataFrame:
    """For each duplicated scan: how many others share its key and the lowest of them.

    The two lowest ids per key come from a ranked filter, which Spark limits before shuffling.
    """
    keyed = scans.where(F.col("primary_key").isNotNull()).select("scan_id", scope, "primary_key")
    group = [scope, "primary_key"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("scan_id"))
    lowest = (
        keyed.withColumn("_rn", rank)
        .where("_rn <= 2")
        .groupBy(*group)
        .agg(
            F.max(F.when(F.col("_rn") == 1, F.col("scan_id"))).alias("_one"),
            F.max(F.when(F.col("_rn") == 2, F.col("scan_id"))).alias("_two"),
        )
    )
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    per_key = counts.where("_n > 1").join(lowest, group)
    other = F.when(F.col("scan_id") == F.col("_one"), F.col("_two")).otherwise(F.col("_one"))
    return keyed.join(per_key, group).select(
        "scan_id", (F.col("_n") - 1).alias("others"), other.alias("first_other")
    )


def duplicates_of(scans: DataFrame, scan_id, scope: str = "job_id", most: int | None = None) -> DataFrame:
    """The other scans with one scan's primary key: all of them, or the first `most`."""
    one = scans.where(F.col("scan_id") == scan_id).select(
        F.col(scope).alias("_scope"), F.col("primary_key").alias("_key")
    )
    on = scans[scope].eqNullSafe(F.col("_scope")) & (scans["primary_key"] == F.col("_key"))
    others = scans.join(one, on, "left_semi").where(F.col("scan_id") != scan_id).orderBy("scan_id")
    return others if most is None else others.limit(most)


def where_results(
    scans: DataFrame,
    flags: DataFrame | None = None,
    assignments: DataFrame | None = None,
    view_name: str = "all",
    name: str | None = None,
    flag: str | None = None,
    file: str | None = None,
    assigned: str | None = None,
    ids: DataFrame | None = None,
    **equals,
) -> DataFrame:
    """The results screen's filter: equality, view, flag, file part, ids and assignee."""
    out = equal(scans, **equals)
    if view_name in ("duplicates", "duplicates_template"):
        scope = "job_id" if view_name == "duplicates" else "template_id"
        ids_in_view = duplicates(scans, scope).select("scan_id")
        out = out.join(ids_in_view, "scan_id", "left_semi")
    else:
        out = out.where(view(view_name))
    if name or flag:
        out = out.join(equal(flags, name=name, flag=flag), "scan_id", "left_semi")
    if file:
        out = out.where(file_contains(file))
    if ids is not None:
        out = out.join(ids, "scan_id", "left_semi")
    if assigned == "unassigned":
        out = out.join(assignments, "scan_id", "left_anti")
    elif assigned:
        out = out.join(equal(assignments, reviewer=assigned), "scan_id", "left_semi")
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing with the total number of rows beside it."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def risk_rank(kind: Column) -> Column:
    rank = F.lit(len(RISK))
    for i, name in reversed(list(enumerate(RISK))):
        rank = F.when(kind == name, i).otherwise(rank)
    return rank


def pending(review: DataFrame, flags: DataFrame | None = None, flag: str | None = None, **filters):
    """Pending review items, optionally read with a flag or queued in a time window."""
    after, before = filters.pop("after", None), filters.pop("before", None)
    out = equal(review, state="pending", **filters)
    if flag:
        out = out.join(equal(flags, flag=flag), ["scan_id", "name"], "left_semi")
    if after is not None:
        out = out.where(F.col("created_at") > after)
    if before is not None:
        out = out.where(F.col("created_at") <= before)
    return out


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def error_files(scans: DataFrame) -> DataFrame:
    """Files of a job with a failed page that nobody has reviewed."""
    return (
        scans.groupBy("job_id", "seq")
        .agg(
            F.bool_or(F.col("status") == "error").alias("failed"),
            F.bool_or(F.col("verified") == 1).alias("seen"),
        )
        .where("failed AND NOT seen")
        .select("job_id", "seq")
    )


def facets(scans: DataFrame, flags: DataFrame) -> DataFrame:
    """Sheets per flagged name, per flag, and per view (all views in one pass)."""

    def top(column: str, k: int) -> DataFrame:
        return (
            flags.groupBy(F.col(column).alias("value"))
            .agg(F.count_distinct("scan_id").alias("n"))
            .orderBy(F.desc("n"), "value")
            .limit(k)
            .select(F.lit(column).alias("facet"), "value", "n")
        )

    sums = [F.count_if(view(v)).alias(v) for v in COUNTED_VIEWS]
    one_pass = scans.agg(F.count(F.lit(1)).alias("all"), *sums).select(
        F.lit("view").alias("facet"),
        F.stack(F.lit(7), *[x for v in ("all", *COUNTED_VIEWS) for x in (F.lit(v), F.col(v))]).alias(
            "value", "n"
        ),
    )
    shared = duplicates(scans).agg(
        F.lit("view").alias("facet"), F.lit("duplicates").alias("value"), F.count("*").alias("n")
    )
    return (
        top("name", NAME_FACETS)
        .unionByName(top("flag", FLAG_FACETS))
        .unionByName(one_pass)
        .unionByName(shared)
    )


def outcomes(cells: DataFrame, scans: DataFrame, flags: DataFrame, corrections: DataFrame):
    """Per field of verified sheets: flagged when read, corrected since."""
    flagged = flags.select("scan_id", "name", F.lit(1).alias("flagged")).distinct()
    changed = corrections.where("original_value <> new_value").select(
        "scan_id", "name", F.lit(1).alias("corrected")
    )
    verified = scans.where("verified = 1").select("scan_id", "template_id", "job_id")
    return (
        cells.select("scan_id", "name")
        .join(verified, "scan_id")
        .join(flagged, ["scan_id", "name"], "left")
        .join(changed, ["scan_id", "name"], "left")
        .fillna(0, ["flagged", "corrected"])
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(100.0 * part / whole, 2))


def accuracy(outcome: DataFrame) -> DataFrame:
    """Field accuracy with an overall row (name null), worst fields first."""
    flagged, changed = F.col("flagged") == 1, F.col("corrected") == 1
    return (
        outcome.rollup("name")
        .agg(
            F.count_if(~flagged).alias("auto"),
            F.count_if(~flagged & ~changed).alias("auto_ok"),
            F.count_if(flagged).alias("flagged"),
            F.count_if(flagged & changed).alias("flagged_corrected"),
            F.count("*").alias("total"),
            F.count_if(changed).alias("corrected"),
        )
        .withColumn("auto_accuracy", percent(F.col("auto_ok"), F.col("auto")))
        .withColumn("flag_precision", percent(F.col("flagged_corrected"), F.col("flagged")))
    )


def last_active(activity: DataFrame) -> DataFrame:
    """When each reviewer last did anything but read or hand out sheets."""
    return (
        activity.where(~F.col("action").isin("assigned", "scanned"))
        .groupBy("reviewer")
        .agg(F.max("at").alias("last_active"))
    )


def returned_scans(activity: DataFrame) -> DataFrame:
    return activity.where("action = 'returned'").select("scan_id").distinct()


def assignment_summary(assign: DataFrame, scans: DataFrame, activity: DataFrame) -> DataFrame:
    """Per reviewer: sheets by state, sent back, and last activity."""
    sent = returned_scans(activity).withColumn("sent", F.lit(1))
    verified = F.col("verified") == 1
    state = scans.select("scan_id", "verified", "approved", "flag_count", "review_count")
    per_user = (
        assign.select("scan_id", "reviewer")
        .join(state, "scan_id")
        .join(sent, "scan_id", "left")
        .groupBy("reviewer")
        .agg(
            F.count("*").alias("assigned"),
            F.count_if(is_open()).alias("to_review"),
            F.count_if(~verified & ~is_open()).alias("reviewed"),
            F.count_if(verified).alias("verified"),
            F.count_if(F.col("approved") == 1).alias("approved"),
            F.count("sent").alias("sent_back"),
        )
    )
    return per_user.join(last_active(activity), "reviewer", "left")


def unassigned_flagged(scans: DataFrame, assign: DataFrame) -> DataFrame:
    return scans.where(view("flagged")).join(assign, "scan_id", "left_anti")


def changed_sheets(activity: DataFrame, scans: DataFrame, actions: Sequence[str], checked=False):
    """Sheets people changed; unless `checked`, only those not approved since their last change.

    Activity is aggregated per sheet in one pass before the join, hot sheets included.
    """
    act = F.col("action")
    mine = act.isin(*actions)

    def latest(column, action):
        return F.max(F.when(act == action, F.col(column)))

    per_scan = (
        activity.groupBy("scan_id")
        .agg(
            F.max(F.when(mine, F.col("at"))).alias("changed_at"),
            F.count_if(mine).alias("changes"),
            F.array_join(F.array_sort(F.collect_set(F.when(mine, F.col("reviewer")))), ",").alias("users"),
            F.array_join(F.array_sort(F.collect_set(F.when(mine, act))), ",").alias("actions"),
            F.max(F.when(mine, F.col("id"))).alias("last_change"),
            latest("at", "verified").alias("verified_at"),
            latest("id", "approved").alias("approved_id"),
            latest("at", "approved").alias("approved_at"),
        )
        .where("changes > 0")
    )
    if not checked:
        per_scan = per_scan.where("approved_id IS NULL OR last_change > approved_id")
    return per_scan.join(scans.select("scan_id", "file_name", "status", "verified"), "scan_id")


def flag_rows(items: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Distinct (scan, name, flag) of review items and checks; an item without flags needs review."""
    flags = F.when(F.size("flags") == 0, F.array(F.lit("needs_review"))).otherwise(F.col("flags"))
    rows = items.select("scan_id", "name", F.explode(flags).alias("flag"))
    if checks is not None:
        rows = rows.unionByName(checks.select("scan_id", "name", F.explode("flags").alias("flag")))
    return rows.distinct()


def primary_keys(cells: DataFrame, scans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The joined key of each sheet; null when a part is blank or flagged, or the sheet failed."""
    mine = cells.where(F.col("name").isin(*columns))
    parts = [F.max(F.when(F.col("name") == c, F.trim("value"))).alias(c) for c in columns]
    per_scan = mine.groupBy("scan_id").agg(
        *parts, F.max("needs_review").alias("_flagged")
    )
    filled = F.lit(True)
    for column in columns:
        filled = filled & (F.coalesce(F.col(column), F.lit("")) != "")
    good = filled & (F.col("_flagged") == 0) & (F.col("status") != "error")
    return (
        scans.select("scan_id", "status")
        .join(per_scan, "scan_id", "left")
        .select("scan_id", F.when(good, F.concat_ws(SEP, *columns)).alias("joined_key"))
    )


def review_status(review: Column, reviewed: Column) -> Column:
    """verified, then error, needs_review, reviewed, auto."""
    return (
        F.when(F.col("verified") == 1, "verified")
        .when(F.col("status") == "error", "error")
        .when(review, "needs_review")
        .when(reviewed, "reviewed")
        .otherwise("auto")
    )


def sheet_status(scans: DataFrame, review: DataFrame) -> DataFrame:
    """needs_review exactly when items wait; sheets that could not be read stay errors."""
    waiting = review.where("state = 'pending'").select("scan_id").distinct().withColumn("_w", F.lit(1))
    status = (
        F.when(F.col("status") == "error", "error")
        .when(F.col("_w").isNotNull(), "needs_review")
        .otherwise("ok")
    )
    return scans.select("scan_id", "status").join(waiting, "scan_id", "left").select("scan_id", status.alias("status"))


def assigned_sheets(assign: DataFrame, scans_seq: DataFrame, first=None, last=None, only_open=False):
    """Each reviewer's sheets with their place in the person's list (job order)."""
    state = scans_seq.select("scan_id", "seq", "verified", "flag_count", "review_count")
    rows = assign.select("scan_id", "reviewer").join(state, "scan_id")
    out = ranking.numbered(
        rows, [F.col("seq"), F.col("scan_id")], F.col("seq"), within=["reviewer"], name="place"
    )
    if first is not None:
        out = out.where(F.col("place") >= first)
    if last is not None:
        out = out.where(F.col("place") <= last)
    if only_open:
        out = out.where(is_open())
    return out.select("reviewer", "place", "scan_id")


def even_split(scans: DataFrame, people: Sequence[str]) -> DataFrame:
    """Consecutive, equal runs of sheets for each person; the first ones take the remainder."""
    rows = ranking.numbered(scans, [F.col("scan_id")], F.col("scan_id"), name="place")
    total = scans.agg(F.count(F.lit(1))).scalar()
    person = F.element_at(F.array(*map(F.lit, people)), F.col("part"))
    return (
        rows.withColumn("part", ranking.tile(F.col("place"), total, len(people)))
        .select("scan_id", "place", person.alias("reviewer"))
    )


def ranges(scans: DataFrame, people: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Sheets first..last of the listing for each person; overlapping ranges are refused."""
    ordered = sorted(people, key=lambda p: p[1])
    for (_, _, end), (name, start, _) in zip(ordered, ordered[1:]):
        if start <= end:
            raise ValueError(f"the range of {name} overlaps another one")
    rows = ranking.numbered(scans, [F.col("scan_id")], F.col("scan_id"), name="place")
    who = F.lit(None).cast("string")
    for name, start, end in people:
        who = F.when(F.col("place").between(start, end), F.lit(name)).otherwise(who)
    return rows.withColumn("reviewer", who).where(F.col("reviewer").isNotNull())


def newest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keep the row with the greatest order per key (an aggregation, so hot keys combine early)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, the changes replacing the target's rows of the same key; new columns join in."""
    both = target.withColumn("_new", F.lit(0)).unionByName(
        changes.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return newest(both, keys, F.col("_new")).drop("_new")


def delete_scans(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every dependent table without the deleted scans."""
    return {name: df.join(gone, "scan_id", "left_anti") for name, df in tables.items()}


def last_n(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The newest n rows per key; the rank filter is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
