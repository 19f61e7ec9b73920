"""Bubble measurements to marks, field readings and sheet decisions.

A sheet's bubbles are gathered once per sheet (a template bounds how many there are), sorted
as arrays, and every threshold is an expression over those arrays: one shuffle by sheet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page-type thresholds and the flags that send a reading to review.
PAGE_DEFAULT = {"white": 200.0, "black": 100.0}
NO_JUMP = 255.0
FIELD_REVIEW_FLAGS = (
    "multi_marked",
    "ambiguous_threshold",
    "low_confidence",
    "weak_mark",
    "possible_missed_mark",
    "kept_darker_mark",
    "faint_second_mark",
    "model_disagrees",
    "border_slide",
)
ZONE_REVIEW_FLAGS = (
    "not_found",
    "multiple_symbols",
    "low_confidence",
    "pattern_mismatch",
    "engine_unavailable",
    "no_icr_model",
    "read_error",
    "engine_disagree",
    "low_char_confidence",
    "unread_box",
    "icr_alignment",
    "no_imprint_model",
    "file_name_mismatch",
)


@dataclass(frozen=True)
class Thresholds:
    min_jump: float = 25.0
    min_gap: float = 30.0
    confident_surplus: float = 5.0
    page: str = "white"
    margin: float = 20.0
    otsu_separation: float = 30.0


@dataclass(frozen=True)
class FieldRules:
    min_confidence: float = 0.35
    min_marked_fill: float = 0.25
    max_unmarked_fill: float = 0.6
    keep_darker_gap: float = 0.0
    strict_double_mark: float = 0.0
    review_flags: Sequence[str] = FIELD_REVIEW_FLAGS


def _ascending(values: Column) -> Column:
    """Sorted values, nulls last. `array_sort` alone interprets its comparison for every pair of values."""
    return F.when(F.exists(values, lambda v: v.isNull()), F.array_sort(values)).otherwise(F.sort_array(values))


def add_gap(df: DataFrame, values: str, stride: int, min_jump: float, default: float, out: str):
    """Add `out`, a struct<jump, threshold> of the first largest rise over `stride` sorted places.

    Each step is a column of its own, so nothing is evaluated twice.
    """
    v = F.col(values)
    starts = F.when(
        F.size(v) > stride, F.sequence(F.lit(0), F.size(v) - stride - 1)
    ).otherwise(F.array().cast("array<int>"))

    def rise(i: Column) -> Column:
        low, jump = F.get(v, i), F.get(v, i + stride) - F.get(v, i)
        return F.struct(
            jump.alias("jump"), (-i).alias("first"), (low + jump / 2).alias("threshold")
        )

    best = F.col("_best")
    clear = best["jump"] > min_jump
    return (
        df.withColumn("_best", F.array_max(F.transform(starts, rise)))
        .withColumn(
            out,
            F.struct(
                F.when(clear, best["jump"]).otherwise(F.lit(min_jump)).alias("jump"),
                F.when(clear, best["threshold"]).otherwise(F.lit(default)).alias("threshold"),
            ),
        )
        .drop("_best")
    )


def add_otsu(df: DataFrame, values: str, separation: float, out: str) -> DataFrame:
    """Add `out`, the two-class split of sorted values; null when the means are too close."""
    v, total = F.col(values), F.col("_total")
    n = F.size(v).cast("double")
    none = F.struct(F.lit(-1.0).alias("score"), F.lit(0.0).alias("back"), F.lit(0.0).alias("left"))
    start = F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("s"), none.alias("best"))

    def step(acc: Column, value: Column) -> Column:
        i, s = acc["i"], acc["s"]
        weight = (i / n) * ((n - i) / n)
        gap = F.try_divide(s, i) - (total - s) / (n - i)
        # Rounded so that float noise cannot break a tie: the first split wins
        score = F.coalesce(F.round(weight * gap * gap, 6), F.lit(-1.0))
        split = F.struct(score.alias("score"), (-i).alias("back"), s.alias("left"))
        return F.struct(
            (i + 1).alias("i"), (s + value).alias("s"), F.greatest(acc["best"], split).alias("best")
        )

    at, left = -F.col("_split.back"), F.col("_split.left")
    apart = (total - left) / (n - at) - F.try_divide(left, at)
    middle = (F.get(v, at.cast("int") - 1) + F.get(v, at.cast("int"))) / 2
    return (
        df.withColumn("_total", F.aggregate(v, F.lit(0.0), lambda s, x: s + x))
        .withColumn("_split", F.aggregate(v, start, step)["best"])
        .withColumn(out, F.when((at > 0) & (apart >= separation), middle))
        .drop("_total", "_split")
    )


def add_global_threshold(
    df: DataFrame, values: str, looseness: int, out: str, p: Thresholds = Thresholds()
) -> DataFrame:
    """Add the sheet-wide threshold of sorted values: largest gap, else a clear two-class
    split, else the page type's default."""
    stride = 2 * ((looseness + 1) // 2)
    df = add_gap(df, values, stride, p.min_jump, PAGE_DEFAULT[p.page], "_gap")
    # Most sheets have a gap: only the others are split, which takes far longer
    clear = F.col("_gap.jump") > p.min_jump
    df = df.withColumn("_unclear", F.when(~F.coalesce(clear, F.lit(False)) & (F.size(values) >= 4), F.col(values)))
    df = add_otsu(df, "_unclear", p.otsu_separation, "_otsu")
    found = F.when(clear, F.col("_gap.threshold"))
    return df.withColumn(out, F.coalesce(found, "_otsu", "_gap.threshold")).drop("_gap", "_otsu", "_unclear")


def add_local_threshold(
    df: DataFrame, values: str, page: str, no_outliers: Column, p: Thresholds = Thresholds()
) -> DataFrame:
    """Add threshold and low_confidence of one field's sorted intensities."""
    df = add_gap(df, values, 2, p.min_jump, NO_JUMP, "_gap").withColumn("_flat", no_outliers)
    v = F.col(values)
    unsure = F.col("_gap.jump") < p.min_jump + p.confident_surplus
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v))
    few = F.size(v) < 3
    threshold = (
        F.when(few & (F.array_max(v) - F.array_min(v) < p.min_gap), F.col(page))
        .when(few, mean)
        .when(unsure & F.col("_flat"), F.col(page))
        .otherwise(F.col("_gap.threshold"))
    )
    low = ~few & unsure & ~F.col("_flat")
    return df.withColumns({"threshold": threshold, "low_confidence": low}).drop("_gap", "_flat")


def _spread(levels: Column) -> Column:
    """What `stddev_pop` gives for the values of an array, step by step the same, nulls left out; two places."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, value: Column) -> Column:
        n, off = acc["n"] + 1, value - acc["mean"]
        return F.struct(n.alias("n"), (acc["mean"] + off / n).alias("mean"), (acc["m2"] + off * (off - off / n)).alias("m2"))

    return F.aggregate(F.array_compact(levels), start, step, lambda acc: F.round(F.sqrt(F.try_divide(acc["m2"], acc["n"])), 2))


def gathered(bubbles: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Bubbles, one row each, as one array per field, in the order of `keep`; dealt by sheet."""
    array = F.sort_array(F.collect_list(F.struct(*keep))).alias("bubbles")
    return bubbles.repartition("scan_id").groupBy("scan_id", "name").agg(array)


def sheet_thresholds(bubbles: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """`field_thresholds` of bubbles(scan_id, name, mean_intensity), one row each."""
    return field_thresholds(gathered(bubbles, ["mean_intensity"]), p)


def field_thresholds(fields: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """One row per field with its std, both sheet thresholds and its own threshold.

    fields(scan_id, name, bubbles): a field's bubbles as one array, see `gathered`. One shuffle by sheet.
    """
    strips = fields.select("scan_id", "name", F.array_compact(F.col("bubbles.mean_intensity")).alias("strip"))
    strips = strips.repartition("scan_id").select("scan_id", "name", F.sort_array("strip").alias("strip"), _spread(F.col("strip")).alias("std"))
    sheets = strips.groupBy("scan_id").agg(
        F.collect_list(F.struct("name", "strip", "std")).alias("fields")
    )
    sheets = sheets.withColumn("_all", F.sort_array(F.flatten(F.col("fields.strip"))))
    sheets = add_global_threshold(sheets, "_all", 4, "page_threshold", p)
    sheets = sheets.withColumn("_std", _ascending(F.col("fields.std")))
    sheets = add_global_threshold(sheets, "_std", 1, "std_threshold", p)
    fields = sheets.select("scan_id", "page_threshold", "std_threshold", F.inline("fields"))
    flat = F.col("std") < F.col("std_threshold")
    return add_local_threshold(fields, "strip", "page_threshold", flat, p).drop("strip")


def _clip(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def marked_fields(bubbles: DataFrame, p: Thresholds = Thresholds(), extra: Sequence[str] = ()) -> DataFrame:
    """`mark_fields` of bubbles(scan_id, name, opt_pos, opt, mean_intensity, fill_ratio, *extra), one row each."""
    return mark_fields(gathered(bubbles, ["opt_pos", "opt", "mean_intensity", "fill_ratio", *extra]), p)


def mark_fields(fields: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """Every field of every sheet with its marked bubbles: (scan_id, name, bubbles, low_confidence, ..).

    The sheet frame: fields(scan_id, name, bubbles) are dealt by sheet once, bubbles being an array of
    struct<opt_pos, opt, mean_intensity, fill_ratio, ..>. A field's bubbles stay one array, in template order, from the
    thresholds to the summary, a bubble is marked when it is darker than its field's threshold, and its confidence is the
    distance to it. Rows stay dealt by sheet, so decisions per sheet that follow need no further shuffle.
    """
    strips = fields.select("scan_id", "name", "bubbles").repartition("scan_id")
    strips = strips.withColumn("std", _spread(F.col("bubbles.mean_intensity")))
    sheets = strips.groupBy("scan_id").agg(F.collect_list(F.struct("name", "std", "bubbles")).alias("fields"))
    every = F.flatten(F.col("fields.bubbles"))["mean_intensity"]
    sheets = sheets.withColumn("_levels", every).withColumn("_all", _ascending(F.col("_levels"))).drop("_levels")
    sheets = add_global_threshold(sheets, "_all", 4, "page_threshold", p)
    sheets = sheets.withColumn("_std", _ascending(F.col("fields.std")))
    sheets = add_global_threshold(sheets, "_std", 1, "std_threshold", p)
    rows = sheets.select("scan_id", "page_threshold", "std_threshold", F.inline("fields"))
    rows = rows.withColumn("_strip", _ascending(F.col("bubbles.mean_intensity")))
    rows = add_local_threshold(rows, "_strip", "page_threshold", F.col("std") < F.col("std_threshold"), p)

    def mark(b: Column) -> Column:
        away = F.abs(F.col("threshold") - b["mean_intensity"]) / p.margin
        marked = b.withField("marked", F.col("threshold") > b["mean_intensity"])
        return marked.withField("confidence", F.round(_clip(away), 3))

    return rows.withColumn("bubbles", F.transform("bubbles", mark)).drop("_strip")


def mark_adaptive(bubbles: DataFrame, p: Thresholds = Thresholds(), extra: Sequence[str] = ()) -> DataFrame:
    """Bubbles, one row each, marked when darker than their field's threshold; see `marked_fields`."""
    return marked_bubbles(marked_fields(bubbles, p, extra))


def marked_bubbles(fields: DataFrame) -> DataFrame:
    """The bubbles of the sheet frame, one row each."""
    # A field has a bubble at least. A plain inline adds a filter on the array's size, which is pushed below
    # the thresholds and works out all of them again for every bubble
    return fields.select("scan_id", "name", "threshold", "low_confidence", F.inline_outer("bubbles"))


def mark_fixed(bubbles: DataFrame, min_fill: float = 0.12) -> DataFrame:
    """Marked when enough of the bubble is filled."""
    margin = max(min(min_fill, 1.0 - min_fill), 0.05)
    away = F.abs(F.col("fill_ratio") - min_fill) / margin
    return (
        bubbles.drop("marked")
        .withColumn("marked", F.col("fill_ratio") >= min_fill)
        .withColumn("confidence", F.round(_clip(away), 3))
    )


def model_opinion(bubbles: DataFrame, decides: bool = False) -> DataFrame:
    """A classifier's probabilities beside the threshold's mark: agreement may raise the
    confidence, disagreement (or a likely erased mark) is flagged, or the model decides."""
    says = F.col("model_marked_prob") >= 0.5
    sure = F.abs(F.col("model_marked_prob") - 0.5) * 2
    erased = F.coalesce(F.col("model_erased_prob") >= 0.5, F.lit(False))
    out = bubbles.withColumn("model_disagrees", (says != F.col("marked")) | erased)
    if decides:
        return out.withColumn("marked", says).withColumn("confidence", F.round(sure, 3))
    raised = F.round(F.greatest("confidence", sure), 3)
    return out.withColumn(
        "confidence", F.when(F.col("model_disagrees"), F.col("confidence")).otherwise(raised)
    )


def fields(bubbles: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Bubbles of each field as one array in template order."""
    keep = ["opt_pos", "opt", "marked", "fill_ratio", "confidence", *extra]
    return bubbles.groupBy("scan_id", "name").agg(
        F.array_sort(F.collect_list(F.struct(*keep))).alias("bubbles"),
        *([F.bool_or("low_confidence").alias("low_confidence")] if "low_confidence" in bubbles.columns else []),
    )


def double_marks(field: DataFrame, rules: FieldRules) -> DataFrame:
    """Optional double-mark rules: keep only a clearly darker mark, or count a faint second one."""
    marks = F.filter("bubbles", lambda b: b["marked"])
    fills = F.sort_array(F.transform(marks, lambda b: b["fill_ratio"]), asc=False)
    # The darkest mark; the first one in template order on equal fills
    top = F.array_max(F.transform(marks, lambda b: F.struct(b["fill_ratio"], -b["opt_pos"])))
    top_pos = -top["col2"]
    darker = F.lit(False)
    if rules.keep_darker_gap:
        gap = F.get(fills, F.lit(0)) - F.get(fills, F.lit(1))
        darker = (F.size(marks) > 1) & (F.round(gap, 9) >= rules.keep_darker_gap)
    faint = F.lit(False)
    if rules.strict_double_mark:
        faint = (
            (F.size(marks) > 0)
            & ~darker
            & F.exists("bubbles", lambda b: ~b["marked"] & (b["fill_ratio"] >= rules.strict_double_mark))
        )

    def settle(b: Column) -> Column:
        kept = F.when(F.col("_darker"), b["marked"] & (b["opt_pos"] == F.col("_top")))
        added = b["marked"] | (b["fill_ratio"] >= rules.strict_double_mark)
        marked = kept.otherwise(F.when(F.col("_faint"), added).otherwise(b["marked"]))
        dropped = F.col("_darker") & b["marked"] & (b["opt_pos"] != F.col("_top"))
        return b.withField("marked", marked).withField("dropped", dropped)

    flags = F.array_compact(
        F.array(F.when(F.col("_darker"), "kept_darker_mark"), F.when(F.col("_faint"), "faint_second_mark"))
    )
    return (
        field.withColumns({"_darker": darker, "_faint": faint, "_top": top_pos})
        .withColumn("mark_flags", flags)
        .withColumn("bubbles", F.transform("bubbles", settle))
        .drop("_darker", "_faint", "_top")
    )


def field_value(bubbles: Column, empty: str = "") -> Column:
    """Values of the marked bubbles in template order, else the empty value."""
    marked = F.filter(bubbles, lambda b: b["marked"])
    joined = F.array_join(F.transform(marked, lambda b: b["opt"]), "")
    return F.when(F.size(marked) > 0, joined).otherwise(empty)


def summarize(
    field: DataFrame, rules: FieldRules = FieldRules(), empty: str = "", keep: Sequence[str] = ()
) -> DataFrame:
    """Value, least confidence, flags and the review decision of each field, with the columns to keep."""
    bubbles = F.col("bubbles")
    has = {f.name for f in field.schema["bubbles"].dataType.elementType.fields}
    n = F.size(F.filter(bubbles, lambda b: b["marked"]))
    weak = F.exists(bubbles, lambda b: b["marked"] & (b["fill_ratio"] < rules.min_marked_fill))

    def missed_mark(b):
        missed = ~b["marked"] & (b["fill_ratio"] > rules.max_unmarked_fill)
        return missed & ~b["dropped"] if "dropped" in has else missed

    confidence = F.round(F.array_min(F.transform(bubbles, lambda b: b["confidence"])), 3)
    listed = [
        F.when(n > 1, "multi_marked"),
        F.when(n == 0, "empty"),
        F.when(weak, "weak_mark"),
        F.when(F.exists(bubbles, missed_mark), "possible_missed_mark"),
        F.when(confidence < rules.min_confidence, "low_confidence"),
    ]
    if "low_confidence" in field.columns:
        listed.append(F.when(F.col("low_confidence"), "ambiguous_threshold"))
    if "model_disagrees" in has:
        listed.append(F.when(F.exists(bubbles, lambda b: b["model_disagrees"]), "model_disagrees"))
    flags = F.array_compact(F.array(*listed))
    for extra in ("mark_flags", "page_flags"):
        if extra in field.columns:
            flags = F.array_union(flags, F.col(extra))
    review = F.arrays_overlap(
        F.col("flags"), F.array(*[F.lit(f) for f in ("out_of_page", *rules.review_flags)])
    )
    return field.select(
        "scan_id",
        "name",
        field_value(bubbles, empty).alias("value"),
        confidence.alias("confidence"),
        F.array_sort(F.array_distinct(flags)).alias("flags"),
        n.alias("marked_count"),
        *keep,
    ).withColumn("needs_review", review)


def decode_grid(fields: DataFrame, values: Sequence[str], threshold: float) -> DataFrame:
    """A text per sheet from the fields of a grid: the value of the one filled bubble, blank for none, `*` for several.

    fields(scan_id, pos, fills), the fills of a field in the order of the values. A field is one character before
    its sheet is gathered, so the bubbles are neither shuffled nor sorted.
    """
    # As many values as a template has; written out, as a lambda would be interpreted for every bubble
    hits = [F.get("fills", F.lit(i)) > threshold for i in range(len(values))]
    n = reduce(Column.__add__, [F.when(hit, 1).otherwise(0) for hit in hits])
    value = F.coalesce(*[F.when(hit, v) for hit, v in zip(hits, values)])
    rows = fields.select("scan_id", "pos", n.alias("n"), value.alias("v"))
    char = F.when(F.col("n") == 1, F.col("v")).when(F.col("n") == 0, " ").otherwise("*")
    parts = F.array_sort(F.collect_list(F.struct("pos", char.alias("c"))))["c"]
    return rows.groupBy("scan_id").agg(F.array_join(parts, "").alias("text"))


# ---- zones --------------------------------------------------------------------------------


def finalize_zone(
    zones: DataFrame, pattern: str | None, min_confidence: float = 0.6, empty: str = "", extra=()
) -> DataFrame:
    """Pattern and confidence flags, review decision and empty value of zone reads
    (value, confidence, flags)."""
    has = F.col("value") != ""
    mismatch = has & ~F.col("value").rlike(rf"^(?:{pattern})\z") if pattern else F.lit(False)
    found = F.array_compact(
        F.array(
            F.when(mismatch, "pattern_mismatch"),
            F.when(has & (F.col("confidence") < min_confidence), "low_confidence"),
        )
    )
    flags = F.array_sort(F.array_union("flags", found))
    wanted = F.array(*map(F.lit, (*ZONE_REVIEW_FLAGS, *extra)))
    return (
        zones.withColumn("flags", flags)
        .withColumn("needs_review", F.arrays_overlap("flags", wanted))
        .withColumn("value", F.when(has, F.col("value")).otherwise(empty))
    )


def _ranked(reads: Column, pattern: str) -> Column:
    """A zone's candidates array<struct<engine, text, confidence, ..>>, comparable: the best is the largest."""

    def rank(r: Column) -> Column:
        filled = r["text"] != ""
        valid = filled & r["text"].rlike(rf"^(?:{pattern})\z")
        first = (-r["engine"]).alias("first")
        return F.struct(valid.alias("valid"), filled.alias("filled"), r["confidence"].alias("confidence"), first, r["text"].alias("text"))

    return F.transform(reads, rank)


def best_read(reads: Column, pattern: str) -> Column:
    """The best of one zone's candidates: valid, then non-empty, then most confident; the earlier engine wins a tie."""
    return F.array_max(_ranked(reads, pattern))


def vote(reads: DataFrame, pattern: str, min_confidence: float = 0.6) -> DataFrame:
    """Best read per zone from engine candidates(engine, text, confidence), one row each; see `vote_zones`."""
    zones = reads.groupBy("scan_id", "name").agg(F.collect_list(F.struct("engine", "text", "confidence")).alias("reads"))
    return vote_zones(zones, pattern, min_confidence)


def vote_zones(zones: DataFrame, pattern: str, min_confidence: float = 0.6) -> DataFrame:
    """Best read per zone from zones(reads), the engine candidates of each.

    Later engines count only when the first one is invalid or unsure; the best read is that of `best_read`.
    """
    zones = zones.select("scan_id", "name", _ranked(F.col("reads"), pattern).alias("reads"))
    sure = F.exists("reads", lambda r: (r["first"] == -1) & r["valid"] & (r["confidence"] >= min_confidence))
    zones = zones.withColumn("sure", F.coalesce(sure, F.lit(False)))
    used = F.filter("reads", lambda r: ~F.col("sure") | (r["first"] == -1))
    texts = F.array_distinct(
        F.transform(F.filter("used", lambda r: r["filled"]), lambda r: F.upper(F.regexp_replace(r["text"], r"\s+", "")))
    )
    best = F.col("best")
    zones = zones.withColumn("used", used).withColumn("best", F.array_max("used"))
    return zones.select(
        "scan_id",
        "name",
        best["text"].alias("value"),
        best["confidence"].alias("confidence"),
        (-best["first"]).alias("engine"),
        F.array_compact(
            F.array(
                F.when(best["text"] == "", "empty"), F.when(F.size(texts) > 1, "engine_disagree")
            )
        ).alias("flags"),
    )


def choose_symbol(symbols: DataFrame) -> DataFrame:
    """First engine that found a symbol, per zone, from symbols(engine, place, text);
    a null engine was not available, a null text found nothing."""
    hit = F.when(F.col("text").isNotNull(), F.col("engine"))
    found = F.struct(hit.alias("engine"), "place", "text")
    zones = symbols.groupBy("scan_id", "name").agg(
        F.count("engine").alias("tried"),
        F.min(F.when(hit.isNotNull(), found)).alias("best"),
        F.min(hit).alias("first"),
        F.collect_list(hit).alias("engines"),
    )
    several = F.size(F.filter("engines", lambda e: e == F.col("first"))) > 1
    flags = (
        F.when(F.col("tried") == 0, F.array(F.lit("engine_unavailable")))
        .when(F.col("first").isNull(), F.array(F.lit("not_found")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(several, "multiple_symbols"),
                    F.when(F.col("first") > 1, "decoded_by_fallback"),
                )
            )
        )
    )
    return zones.select(
        "scan_id",
        "name",
        F.coalesce(F.col("best.text"), F.lit("")).alias("value"),
        F.col("first").alias("engine"),
        flags.alias("flags"),
    )


# ---- sheets -------------------------------------------------------------------------------


def quality_flags(limits: dict[str, float]) -> Column:
    """Measures under their minimum; a minimum of 0 turns a measure off."""
    low = [F.when(F.col(m) < limit, m) for m, limit in limits.items() if limit]
    return F.array_compact(F.array(*low)) if low else F.array().cast("array<string>")


def fast_accept(
    sheets: DataFrame, field: DataFrame, rules: FieldRules = FieldRules(), empty_max=0.25, marked_min=0.6
) -> DataFrame:
    """Sheets whose cheap read is final: nothing to review and every bubble clear.

    `field` is the sheet frame (`marked_fields`): unclear bubbles and harmful flags of a sheet are found in
    one aggregation of its fields, which are dealt by sheet already.
    """
    foggy = F.exists(
        "bubbles", lambda b: F.when(b["marked"], b["fill_ratio"] < marked_min).otherwise(b["fill_ratio"] > empty_max)
    )
    rows = summarize(field.withColumn("_foggy", foggy), rules, keep=["_foggy"])
    harmful = F.size(F.array_remove("flags", "empty")) > 0
    bad = rows.groupBy("scan_id").agg(F.bool_or(F.col("_foggy") | harmful).alias("_bad"))
    accepted = (F.col("status") == "ok") & ~F.coalesce("_bad", F.lit(False))
    return (
        sheets.select("scan_id", "status")
        .join(bad, "scan_id", "left")
        .select("scan_id", F.when(accepted, "fast").otherwise("full").alias("read_pass"))
    )


def dropout_fallback(first: DataFrame, grey: DataFrame, share: float, flag: bool = True) -> DataFrame:
    """Take the grey read of sheets whose first read leaves too many questions blank."""
    blanks = first.groupBy("scan_id").agg(
        F.count_if(F.col("value") == "").alias("blank"), F.count("*").alias("total")
    )
    pale = blanks.where(F.col("blank") > share * F.col("total")).select(
        "scan_id", F.lit("grey").alias("read")
    )
    second = grey.select("scan_id", "name", F.col("value").alias("grey_value"))
    joined = first.join(pale, "scan_id", "left").join(second, ["scan_id", "name"], "left")
    grey_read = F.col("read").isNotNull() & F.col("grey_value").isNotNull()
    return joined.select(
        "scan_id",
        "name",
        F.when(grey_read, F.col("grey_value")).otherwise(F.col("value")).alias("value"),
        F.when(grey_read & F.lit(flag), "dropout_fallback").otherwise("").alias("sheet_flag"),
    )
