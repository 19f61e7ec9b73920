"""Accuracy against ground truth, review efficiency, latency and label inference."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.config import local_frame
from answerlake.functions import text as tx
from answerlake.functions import values as vl
from answerlake.operators import ranking
from answerlake.session import hand_over

MULTI = "*"  # truth: multi-marked, options not recorded
KINDS_OF_BUBBLES = ("field", "custom")


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.when(whole != 0, F.round(part / whole, digits))


def compare_truth(truth: DataFrame, readings: DataFrame) -> DataFrame:
    """One row per expected value: truth(scan_id, name, expected) against
    readings(scan_id, name, kind, value, confidence, flags, flagged).

    A truth of `*` is right when the value goes to review; a name nothing was read for is 'missing'.
    """
    expected, got = tx.strip(F.coalesce("expected", F.lit(""))), tx.strip(F.coalesce("value", F.lit("")))
    right = F.when(expected == MULTI, F.col("flagged")).otherwise(expected == got)
    return truth.join(readings, ["scan_id", "name"], "left").select(
        "scan_id",
        "name",
        F.coalesce("kind", F.lit("missing")).alias("kind"),
        expected.alias("expected"),
        got.alias("got"),
        "confidence",
        "flags",
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
        F.when(F.col("kind").isNotNull(), right).alias("correct"),
    )


def counters() -> list[Column]:
    """The value metrics of a group, from columns correct and flagged."""
    right, flagged = F.col("correct"), F.col("flagged")
    total, n_right, n_flagged = F.count("*"), F.count_if(right), F.count_if(flagged)
    caught, silent = F.count_if(flagged & ~right), F.count_if(~flagged & ~right)
    auto = total - n_flagged
    return [
        total.alias("total"),
        n_right.alias("correct"),
        ratio(n_right, total).alias("accuracy"),
        n_flagged.alias("flagged"),
        ratio(n_flagged, total).alias("review_rate"),
        auto.alias("auto_accepted"),
        ratio(auto - silent, auto).alias("auto_accepted_accuracy"),
        silent.alias("silent_errors"),
        ratio(caught, n_flagged).alias("flagged_error_rate"),
        ratio(caught, total - n_right).alias("errors_caught_rate"),
    ]


def value_metrics(items: DataFrame, by_kind: bool = False) -> DataFrame:
    """Metrics of all values, and of each kind and of bubble fields when asked (one pass)."""
    read = items.where("kind <> 'missing'")
    if not by_kind:
        return read.agg(*counters())
    bubbles = F.when(F.col("kind").isin(*KINDS_OF_BUBBLES), "bubbles")
    groups = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("kind:"), "kind"), bubbles))
    # Every value counts in at most three groups
    return read.withColumn("group", F.explode(groups)).groupBy("group").agg(*counters())


def sheet_metrics(items: DataFrame, sheets: DataFrame, truth_sheets: DataFrame) -> DataFrame:
    """Sheet totals: errors, missing truth, exact matches and straight-through rate."""
    right = items.where("kind <> 'missing'").groupBy("scan_id").agg(F.bool_and("correct").alias("exact"))
    known = truth_sheets.select("scan_id", F.lit(True).alias("known"))
    rows = sheets.select("scan_id", "status").join(known, "scan_id", "left").join(right, "scan_id", "left")
    error = F.col("status") == "error"
    scanned = ~error & F.coalesce("known", F.lit(False))
    exact = scanned & F.coalesce("exact", F.lit(True))
    ok = scanned & (F.col("status") == "ok")
    n = F.count_if
    return rows.agg(
        F.count("*").alias("total"),
        n(error).alias("error"),
        n(~error & F.col("known").isNull()).alias("missing_truth"),
        n(scanned).alias("scanned"),
        n(ok).alias("ok"),
        n(scanned & ~ok).alias("needs_review"),
        n(exact).alias("exact_match"),
        n(exact & ok).alias("auto_accepted_exact"),
        ratio(n(exact), n(scanned)).alias("exact_match_rate"),
        ratio(n(scanned & ~ok), n(scanned)).alias("review_rate"),
        ratio(n(exact & ok), n(ok)).alias("auto_accepted_accuracy"),
        ratio(n(error), F.count("*")).alias("error_rate"),
        ratio(n(exact & ok), F.count("*")).alias("straight_through_rate"),
    )


def bubble_metrics(bubbles: DataFrame, truth: DataFrame, values: Sequence[str]) -> DataFrame:
    """Bubble confusion against the marks that spell the truth."""
    expected = truth.where(F.col("expected") != MULTI).select(
        "scan_id", "name", vl.split_ordered(F.col("expected"), values).alias("_marks")
    )
    rows = bubbles.select("scan_id", "name", "opt_pos", (F.col("marked") == 1).alias("got")).join(
        expected, ["scan_id", "name"]
    )
    should, got = F.array_contains("_marks", F.col("opt_pos") - 1), F.col("got")
    tp, fp, fn, tn = (
        F.count_if(c) for c in (should & got, ~should & got, should & ~got, ~should & ~got)
    )
    first = F.col("opt_pos") == 1
    sums = rows.agg(
        tp.alias("true_positive"),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
        tn.alias("true_negative"),
        F.count_if(F.col("_marks").isNull() & first).alias("undecomposable_fields"),
    )
    t, f, m = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    precision, recall = ratio(t, t + f), ratio(t, t + m)
    total = t + f + m + F.col("true_negative")
    return sums.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "accuracy": ratio(t + F.col("true_negative"), total),
        }
    ).withColumn(
        "f1",
        F.when(
            (F.col("precision") > 0) & (F.col("recall") > 0),
            F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 6),
        ),
    )


def review_reasons(items: DataFrame) -> DataFrame:
    """Why values went to review, and how often each reason was a real error."""
    flags = F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("(none)")))
    return (
        items.where("kind <> 'missing' AND flagged")
        .select(F.explode(flags).alias("flag"), "correct")
        .groupBy("flag")
        .agg(F.count("*").alias("count"), F.count_if(~F.col("correct")).alias("wrong"))
    )


def worst_errors(items: DataFrame, k: int = 50) -> DataFrame:
    """Silent errors first, then the most confident ones."""
    sure = F.desc(F.coalesce("confidence", F.lit(0.0)))
    return items.where("NOT correct").orderBy("flagged", sure, "scan_id", "name").limit(k)


def latency(timings: DataFrame) -> DataFrame:
    """mean, p50, p95 and max per stage."""
    out = ranking.quantiles(timings, ["stage"], "ms", {"p50": 0.5, "p95": 0.95})
    return out.select("stage", *[F.round(c, 2).alias(c) for c in ("mean", "p50", "p95", "max")])


def fill_percentiles(bubbles: DataFrame) -> DataFrame:
    shares = {f"p{q}": q / 100 for q in (1, 5, 50, 95, 99)}
    out = ranking.quantiles(bubbles, ["marked"], "fill_ratio", shares)
    return out.select("marked", "count", *[F.round(p, 3).alias(p) for p in shares])


def review_thresholds(percentiles: DataFrame) -> DataFrame:
    """Suggested fill limits; null when there are too few bubbles of either kind."""
    marked, n = F.col("marked") == 1, F.col("count")
    row = percentiles.agg(
        F.max(F.when(marked, F.col("p5"))).alias("p5"),
        F.max(F.when(~marked, F.col("p99"))).alias("p99"),
        F.max(F.when(marked, n)).alias("n1"),
        F.max(F.when(~marked, n)).alias("n0"),
    )
    top = F.least(F.greatest(F.col("p99") + 0.15, F.lit(0.35)), F.lit(0.45))
    low = F.least(F.greatest(F.col("p5") - 0.4, F.col("top") + 0.1), F.lit(0.5))
    enough = (F.col("n1") >= 10) & (F.col("n0") >= 50) & (F.col("low") > F.col("top"))
    return (
        row.withColumn("top", top)
        .withColumn("low", low)
        .select(
            F.when(enough, F.round("top", 2)).alias("max_unmarked_fill_ratio"),
            F.when(enough, F.round("low", 2)).alias("min_marked_fill_ratio"),
        )
    )


def self_check(items: DataFrame) -> DataFrame:
    """Agreement per field and overall (name null)."""
    return items.where("kind <> 'missing'").rollup("name").agg(
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("agreement"), F.count("*").alias("n")
    )


# ---- labels -------------------------------------------------------------------------------


PAIRS_HELD = 1 << 20  # pairs of a block, before equal ones are added up
DENSE_SUMS = 1 << 21  # sums that a task keeps in one array (16 MB); templates with more keep those that occur


def label_correlation(
    marks: DataFrame, tokens: DataFrame, bubbles: Sequence[str], labels: Sequence[str], vocabulary: Sequence[str]
) -> DataFrame:
    """Correlation of every bubble's mark with every label token over the sheets that have
    the label.

    A sparse matrix product: a task adds up, for its sheets, the pairs (bubble, label token) that occur together,
    a block of pairs at a time, and sends only sums that are not zero; so do the counts of single marks,
    tokens and labels. Spark adds the sums; pairs that never occur together come in when
    the labels are spread over bubbles and tokens at the end.
    marks(scan_id, bubble), tokens(scan_id, label, letters).
    """
    b_index, l_index = {b: i for i, b in enumerate(bubbles)}, {n: i for i, n in enumerate(labels)}
    t_index = {t: i for i, t in enumerate(vocabulary)}
    nt = len(vocabulary)
    sheets = (
        marks.groupBy("scan_id")
        .agg(F.collect_set("bubble").alias("bubbles"))
        .join(
            tokens.groupBy("scan_id").agg(F.collect_list(F.struct("label", "letters")).alias("labels")),
            "scan_id",
            "right",
        )
    )

    width = len(labels) * (nt + 1)
    space = (len(bubbles) + 1) * width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a sum is known by bubble, label and token, as one number; place 0 of bubbles and tokens means any
        sums = np.zeros(space, np.int64) if space <= DENSE_SUMS else (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            marked = [[0, *(b_index[b] + 1 for b in (m if m is not None else ()))] for m in batch["bubbles"]]
            given = [
                [l_index[e["label"]] * (nt + 1) + t for e in entries for t in (0, *{t_index[c] + 1 for c in e["letters"] if c in t_index})]
                for entries in batch["labels"]
            ]
            start = size = 0
            for at in range(len(marked)):
                size += len(marked[at]) * len(given[at])
                if size > PAIRS_HELD or at == len(marked) - 1:
                    sums = added(sums, pairs(marked[start : at + 1], given[start : at + 1]))
                    start, size = at + 1, 0
        codes, n = (np.flatnonzero(sums), sums[sums > 0]) if isinstance(sums, np.ndarray) else sums
        bubble, label, token = codes // width, codes % width // (nt + 1), codes % (nt + 1)
        yield pd.DataFrame(
            {
                "bubble": [bubbles[i - 1] if i else None for i in bubble],
                "label": [labels[i] for i in label],
                "token": [vocabulary[i - 1] if i else None for i in token],
                "n": n,
            }
        )

    def pairs(marked: list[list[int]], given: list[list[int]]) -> np.ndarray:
        """The number of every pair of a mark and a label token of the same sheet."""
        many, most = (np.array([len(x) for x in lists]) for lists in (marked, given))
        left = np.array([x for m in marked for x in m], np.int64)
        right = np.array([x for g in given for x in g], np.int64)
        times = np.repeat(most, many)  # tokens beside each mark
        first = np.repeat(np.cumsum(most) - most, many)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        return np.repeat(left, times) * width + right[place]

    def added(sums, codes: np.ndarray):
        if isinstance(sums, np.ndarray):
            return sums + np.bincount(codes, minlength=space)
        found, of = np.unique(np.concatenate((sums[0], codes)), return_inverse=True)
        weights = np.concatenate((sums[1], np.ones(len(codes), np.int64)))
        return found, np.bincount(of, weights, len(found)).astype(np.int64)

    found = (
        sheets.select("bubbles", "labels")
        .mapInPandas(run, "bubble string, label string, token string, n bigint")
        .groupBy("bubble", "label", "token")
        .agg(F.sum("n").cast("double").alias("n"))
    )

    # read four times below, so it is made once
    found = hand_over(found, "sums")

    def counts(where: str, name: str, *keys: str) -> DataFrame:
        return found.where(where).select(*keys, F.col("n").alias(name))

    grid = counts("bubble IS NULL AND token IS NULL", "n", "label")
    for column, values in (("bubble", bubbles), ("token", vocabulary)):
        grid = grid.withColumn(column, F.explode(F.array(*map(F.lit, values))))
    sums = (
        grid.join(counts("bubble IS NOT NULL AND token IS NULL", "sm", "label", "bubble"), ["label", "bubble"], "left")
        .join(counts("bubble IS NULL AND token IS NOT NULL", "sl", "label", "token"), ["label", "token"], "left")
        .join(counts("bubble IS NOT NULL AND token IS NOT NULL", "sml", "bubble", "label", "token"), ["bubble", "label", "token"], "left")
        .fillna(0.0, ["sm", "sl", "sml"])
    )
    mean_m, mean_l = F.col("sm") / F.col("n"), F.col("sl") / F.col("n")
    spread = F.sqrt((mean_m - mean_m * mean_m) * (mean_l - mean_l * mean_l))
    corr = F.when(spread > 1e-9, (F.col("sml") / F.col("n") - mean_m * mean_l) / spread).otherwise(0.0)
    return sums.where("n > 0").select("bubble", "label", "token", F.round(corr, 6).alias("corr"))


def label_shapes(labels: DataFrame) -> DataFrame:
    """Per label column(sheet, column, value): common length, shares of lengths and digits.

    Lengths are counted before they are ranked; a column has few distinct lengths.
    """
    bare = tx.strip(F.coalesce("value", F.lit("")))
    filled = labels.select("column", bare.alias("v"))
    by_length = (
        filled.groupBy("column", F.length("v").alias("len"))
        .agg(
            F.count("*").alias("n"),
            F.bool_and(F.col("v").rlike(r"^\p{Nd}+$")).alias("digits"),
        )
    )
    some = F.col("len") > 0
    order = F.when(some, F.struct("n", -F.col("len")))
    return by_length.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("filled"),
        F.max_by(F.when(some, F.col("len")), order).alias("common"),
        F.max(F.when(some, F.col("n"))).alias("n_common"),
        F.sum(F.when(F.col("len") >= 2, F.col("n")).otherwise(0)).alias("n_long"),
        F.min(F.when(some, F.col("len"))).alias("shortest"),
        F.max(F.when(some, F.col("len"))).alias("longest"),
        F.bool_and(F.when(some, F.col("digits"))).alias("digits"),
    )


def composite_split(labels: DataFrame) -> DataFrame:
    """Columns that are really several one-character fields, split into sub-columns; values of
    another length are unknown (null), blanks are empty."""
    shape = label_shapes(labels)
    packed = (
        (F.col("filled") >= 2)
        & (F.col("common") >= 2)
        & (F.col("n_common") >= 0.5 * F.col("filled"))
        & (F.col("n_long") >= 0.8 * F.col("filled"))
    )
    name = F.lower("column")
    stem = F.when(name.rlike(r"[\d.]") | (name == ""), "f").otherwise(name)
    joined = labels.join(shape.where(packed).select("column", "common"), "column", "left")
    bare = tx.strip(F.coalesce("value", F.lit("")))
    places = F.sequence(F.lit(1), F.coalesce("common", F.lit(1)))
    char = F.substring(bare, F.col("place"), F.lit(1))
    token = (
        F.when(F.col("common").isNull(), bare)
        .when(bare == "", "")
        .when(F.length(bare) != F.col("common"), F.lit(None))
        .otherwise(F.translate(char, " _-", ""))
    )
    return joined.withColumn("place", F.explode(places)).select(
        "sheet",
        F.when(F.col("common").isNull(), F.col("column"))
        .otherwise(F.concat(stem, F.col("place").cast("string")))
        .alias("name"),
        token.alias("token"),
    )


def infer_validation(labels: DataFrame) -> DataFrame:
    """required, length bounds and no-gap rules of numeric label columns."""
    shape = label_shapes(labels)
    return shape.where("digits AND longest >= 2").select(
        "column",
        (F.col("filled") == F.col("rows")).alias("required"),
        F.col("shortest").alias("min_length"),
        F.col("longest").alias("max_length"),
        F.lit(False).alias("allow_gaps"),
        (F.col("shortest") != F.col("longest")).alias("allow_empty_ends"),
    )


def blank_columns(labels: DataFrame) -> DataFrame:
    blank = tx.strip(F.coalesce("value", F.lit(""))) == ""
    return labels.groupBy("column").agg(F.bool_and(blank).alias("b")).where("b").select("column")


# The orders of printed options.
SEQUENCES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "abcdefghijklmnopqrstuvwxyz",
    "0123456789",
    "1234567890",
    "123456789",
)


def infer_values(votes: DataFrame, n_values: int) -> DataFrame:
    """Option values by position from votes(field, place, token): the most voted token of each
    place, completed from a standard order when all known places agree with one."""
    counted = votes.groupBy("field", "place", "token").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("field", "place").agg(
        F.min_by("token", F.struct(-F.col("n"), F.col("token"))).alias("token")
    )
    rows = [
        (rank * 100 + offset, offset, place, seq[offset + place])
        for rank, seq in enumerate(SEQUENCES)
        for offset in range(0, len(seq) - n_values + 1)
        for place in range(n_values)
    ]
    schema = pa.schema(
        [("candidate", pa.int32()), ("offset", pa.int32()), ("place", pa.int32()), ("standard", pa.string())]
    )
    standard = local_frame(votes.sparkSession, rows, schema)
    known = chosen.groupBy("field").agg(F.count("*").alias("known"))
    fits = (
        chosen.join(standard, "place")
        .where("token = standard")
        .groupBy("field", "candidate", "offset")
        .agg(F.count("*").alias("hits"))
        .join(known, "field")
        .where(f"hits = known AND (offset = 0 OR known = {n_values})")
        .groupBy("field")
        .agg(F.min("candidate").alias("candidate"))
    )
    places = known.select("field", F.explode(F.sequence(F.lit(0), F.lit(n_values - 1))).alias("place"))
    return (
        places.join(fits, "field", "left")
        .join(chosen, ["field", "place"], "left")
        .join(standard.drop("offset"), ["candidate", "place"], "left")
        .select(
            "field",
            "place",
            F.coalesce("standard", "token", F.concat(F.lit("v"), (F.col("place") + 1).cast("string"))).alias("value"),
            F.col("standard").isNotNull().alias("from_standard"),
        )
    )
