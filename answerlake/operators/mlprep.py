"""Training-set preparation and calibration of mark classifiers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlake.functions import values as vl
from answerlake.operators import ranking
from answerlake.operators.metrics import MULTI
from answerlake.session import hand_over


def samples(bubbles: DataFrame, truth: DataFrame, values: Sequence[str]) -> DataFrame:
    """Bubbles labelled marked or empty from the true value; unknown multi-marks and values the
    bubbles cannot spell are left out. Crops stay references to the page."""
    expected = truth.where(F.col("expected") != MULTI).select(
        "scan_id", "name", "expected", vl.split_ordered(F.col("expected"), values).alias("_marks")
    )
    label = F.when(F.array_contains("_marks", F.col("opt_pos") - 1), "marked").otherwise("empty")
    return (
        bubbles.join(expected.where("_marks IS NOT NULL"), ["scan_id", "name"])
        .withColumn("label", label)
        .drop("_marks")
    )


def manifest(labelled: DataFrame) -> DataFrame:
    """Manifest rows of labelled bubbles."""
    source = F.concat(F.lit("S"), F.col("scan_id").cast("string"))
    return labelled.select(
        F.concat_ws("/", "label", F.concat_ws("_", source, "name", "opt")).alias("path"),
        "label",
        F.lit("bubble").alias("kind"),
        source.alias("source"),
        F.col("name").alias("field"),
        F.col("opt").alias("value"),
        F.when(F.col("marked") == 1, "marked").otherwise("empty").alias("predicted"),
        F.col("fill_ratio").alias("confidence"),
    )


def _hash_order(value: Column, seed: int) -> Column:
    return F.md5(F.concat(value.cast("string"), F.lit(f":{seed}")))


def _spread(digest: str) -> Column:
    """The digest's first 13 hex digits as a number in the same order."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def _groups(rows: DataFrame, group: str) -> DataFrame:
    """The groups, written once: cut points, ranges, places and totals read them, not the rows behind them."""
    return hand_over(rows.select(group).where(F.col(group).isNotNull()).distinct(), "groups", tidy=True)


def split_by_group(rows: DataFrame, group: str, share: float = 0.15, seed: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """Train/validation by whole groups (source sheets) in hash order; needs five groups."""
    groups = _groups(rows, group) if groups is None else groups
    groups = groups.withColumn("_h", _hash_order(F.col(group), seed))
    placed = ranking.numbered(groups, [F.col("_h"), F.col(group)], _spread("_h"), name="_number")
    total = groups.agg(F.count("*")).scalar()
    n_val = F.greatest(F.round(total * share), F.lit(1))
    part = F.when(F.col("_number") <= n_val, "validation").otherwise("train")
    return rows.join(placed.select(group, part.alias("part")), group)


def split_by_label(rows: DataFrame, ident: str, label: str, share: float = 0.15, seed: int = 0):
    """Train/validation stratified by label in hash order; a label with two rows gives one."""
    hashed = rows.withColumn("_h", _hash_order(F.col(ident), seed))
    placed = ranking.numbered(hashed, [F.col("_h"), F.col(ident)], _spread("_h"), within=[label], name="_number")
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    least = F.when(F.col("_n") >= 2, 1).otherwise(0)
    n_val = F.greatest(F.round(F.col("_n") * share), least)
    return (
        placed.join(counts, F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("part", F.when(F.col("_number") <= n_val, "validation").otherwise("train"))
        .drop("_h", "_number", "_label", "_n")
    )


def split(rows: DataFrame, group: str, ident: str, label: str, share: float = 0.15, seed: int = 0, least: int = 5) -> DataFrame:
    """Train/validation by whole groups; with fewer than `least` groups, by rows of each label."""
    groups = _groups(rows, group)
    few = groups.limit(least).count() < least
    return split_by_label(rows, ident, label, share, seed) if few else split_by_group(rows, group, share, seed, groups)


def label_order(rows: DataFrame, label: str, head: Sequence[str] = ("empty", "marked")) -> DataFrame:
    """Class index of every label: the head labels first, the others in order."""
    from pyspark.sql import Window

    rank = F.lit(len(head))
    for i, name in reversed(list(enumerate(head))):
        rank = F.when(F.col(label) == name, i).otherwise(rank)
    # Distinct labels only: a handful of rows
    order = Window.orderBy(rank, label)
    return rows.select(label).distinct().select(label, (F.row_number().over(order) - 1).alias("index"))


# ---- calibration --------------------------------------------------------------------------


def log_prob(logits: Column, target: Column, temperature: float | Column = 1.0) -> Column:
    """Log of the target's softmax probability, at least log(1e-12)."""
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(logits) / temperature
    total = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    picked = F.get(logits, target) / temperature
    return F.greatest(picked - top - F.ln(total), F.lit(math.log(1e-12)))


def confidence(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Largest softmax probability."""
    top = F.array_max(logits)
    return 1.0 / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))


def predicted(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def nll(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    value = F.avg(-log_prob(F.col("logits"), F.col("target"), temperature))
    return rows.agg(F.round(value, 6).alias("nll"), F.count("*").alias("n"))


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, each open at its lower end."""
    sure = confidence(F.col("logits"))
    right = (predicted(F.col("logits")) == F.col("target")).cast("double")
    per_bin = (
        rows.select(sure.alias("c"), right.alias("r"))
        .groupBy(F.ceil(F.col("c") * bins).alias("bin"))
        .agg(F.count("*").alias("n"), F.abs(F.avg("r") - F.avg("c")).alias("gap"))
    )
    return per_bin.agg(
        F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n")
    )


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with the overall accuracy beside them.

    Rows are reduced to (target, predicted) counts first.
    """
    cells = rows.groupBy("target", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("target").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    given = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("given"))
    total = cells.agg(F.round(F.sum(hit) / F.sum("n"), 5)).scalar()
    per = actual.join(given, "label", "full").fillna(0)
    p = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return per.withColumn("p", p).withColumn("r", r).select(
        "label",
        F.round("p", 5).alias("precision"),
        F.round("r", 5).alias("recall"),
        F.round(f1, 5).alias("f1"),
        "support",
        total.alias("accuracy"),
    )


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(target, predicted, n) for every pair of classes that occur, pairs that never occur with 0."""
    cells = rows.groupBy("target", "predicted").agg(F.count("*").alias("n"))
    classes = cells.agg(F.array_union(F.collect_set("target"), F.collect_set("predicted")).alias("c"))
    grid = classes.select("c", F.explode("c").alias("target")).select("target", F.explode("c").alias("predicted"))
    return grid.join(cells, ["target", "predicted"], "left").fillna(0, ["n"])


def _temperature_sums(rows: DataFrame, sharpness: float):
    """Sums over all rows at one sharpness (1 / temperature): loss and mean confidence, each with its slopes."""
    logits, target, s = F.col("logits"), F.col("target"), F.lit(sharpness)
    total = lambda f: F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + f(x))
    top = F.array_max(logits)
    weight = lambda x: F.exp((x - F.col("top")) * s)
    parts = rows.select("logits", "target", top.alias("top")).select(
        "logits", "target", "top", total(weight).alias("z"), total(lambda x: weight(x) * x).alias("zx"), total(lambda x: weight(x) * x * x).alias("zxx")
    )
    mean, own = F.col("zx") / F.col("z"), F.get(logits, target)
    log_p = (own - F.col("top")) * s - F.log("z")
    free = log_p > math.log(1e-12)  # losses are capped there and have no slope
    return parts.agg(
        F.count("*").alias("n"),
        F.count_if(predicted(logits) != target).alias("errors"),
        F.avg(-F.greatest(log_p, F.lit(math.log(1e-12)))).alias("loss"),
        F.avg(F.when(free, mean - own).otherwise(0.0)).alias("slope"),
        F.avg(F.when(free, F.col("zxx") / F.col("z") - mean * mean).otherwise(0.0)).alias("bend"),
        F.avg(1 / F.col("z")).alias("sure"),
        F.avg((F.col("top") - mean) / F.col("z")).alias("rise"),
    ).first()


def fit_temperature(rows: DataFrame, low: float = 0.05, high: float = 20.0, passes: int = 40, close: float = 1e-10) -> DataFrame:
    """Softmax temperature of least mean loss between `low` and `high`: temperature, n, errors.

    Without errors the loss falls for ever, so the temperature whose mean confidence is (n + 1) / (n + 2) is taken;
    a fit worse than none gives 1, and so do no rows. A Newton search on the inverse temperature, in which the loss
    is convex: every pass is one aggregate of mergeable sums (first and second derivative), usually
    five or six passes, and only those sums reach the driver. A step out of the bracket goes to its end or halves it.
    """
    at, lower, upper = 1.0, 1 / high, 1 / low
    now = plain = _temperature_sums(rows, at)
    n, errors = plain["n"], plain["errors"]
    for _ in range(passes if n else 0):
        value, slope = (now["slope"], now["bend"]) if errors else (now["sure"] - (n + 1) / (n + 2), now["rise"])
        lower, upper = (lower, at) if value > 0 else (at, upper)
        step = at - value / slope if slope > 0 else math.inf if value < 0 else -math.inf
        if not lower < step < upper:
            # the ends have been looked at once they are part of the bracket by a step there
            end = 1 / low if step >= upper and upper == 1 / low else 1 / high if step <= lower and lower == 1 / high else None
            step = end if end is not None and at != end else math.sqrt(lower * upper)
        if abs(step - at) <= close * at or upper - lower <= close * lower:
            break
        at = step
        now = _temperature_sums(rows, at)
    worse = bool(errors) and now["loss"] > plain["loss"]
    best = 1.0 if not n or worse else 1 / at
    return rows.sparkSession.createDataFrame([(round(best, 6), n, errors)], "temperature double, n bigint, errors bigint")


# ---- synthetic answers and colours --------------------------------------------------------


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by its parts: the same on every retry of a task."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def random_answers(
    sheets: DataFrame, questions: Sequence[str], options: Sequence[str], blank=0.1, multi=0.05, seed=0
) -> DataFrame:
    """Random answers with blank and double-mark rates."""
    n = len(options)
    rows = sheets.select("scan_id", F.explode(F.array(*map(F.lit, questions))).alias("name"))
    u, v = (uniform(F.col("scan_id"), F.col("name"), F.lit(i), seed=seed) for i in (0, 1))
    first = F.floor(F.col("v") * n).cast("int")
    second = F.pmod(first + 1, F.lit(n))
    choice = F.array(*map(F.lit, options))
    low, high = F.least(first, second), F.greatest(first, second)
    pair = F.concat(F.get(choice, low), F.get(choice, high))
    value = F.when(F.col("u") < blank, "").when(F.col("u") < blank + multi, pair).otherwise(F.get(choice, first))
    return rows.withColumns({"u": u, "v": v}).select("scan_id", "name", value.alias("value"))


LIGHTNESS_SHARE = 0.5  # lightness counts half, so that an ink and its lighter edges stay together
CLOSE_COLOURS = 10.0  # mean colours nearer than this are one
BINS_AT_ONCE = 1 << 17  # bins of pages that are cut together


def palette(pixels: DataFrame, page: str = "page", k: int = 6, least: float = 0.002) -> DataFrame:
    """The main colours of each page of pixels(page, b, g, r, n): (page, colour, lightness, a, bb, share).

    Near-white paper is a colour of its own. The others are counted in a histogram of 32 steps per channel, so
    a page is at most 32768 bins with exact sums, whatever its size; a page's box of bins is then cut in Lab, up to
    k times, always the box and axis with the largest spread, where the two sides differ most. Boxes of near mean
    colour are joined, and colours below the least share are left out. Colours are numbered by falling share.
    """
    lightness, a, b = vl.lab(*[F.col(c).cast("double") for c in ("b", "g", "r")])
    rows = pixels.where(F.col("n") > 0).withColumns({"L": lightness, "A": a, "B": b})
    paper = (F.col("L") > 85) & (F.hypot("A", "B") < 12)
    bins = rows.groupBy(page, paper.alias("paper"), *[F.floor(F.when(paper, 0).otherwise(F.col(c)) / 8).alias(f"_{c}") for c in "bgr"]).agg(
        F.sum("n").cast("double").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("L", "A", "B")]
    )
    schema = StructType().add(pixels.schema[page]).add("colour", "string")
    for name in ("lightness", "a", "bb", "share"):
        schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            codes, _ = _coded(rows[page])
            # the last page may go on in the next batch
            whole = int(np.searchsorted(codes, codes[-1])) if len(codes) else 0
            rest = rows.slice(whole)
            if whole:
                yield from _palettes(rows.slice(0, whole), page, k, least, schema.fieldNames())
        if rest is not None and rest.num_rows:
            yield from _palettes(rest, page, k, least, schema.fieldNames())

    # a fixed number of tasks: pages are small, so their bytes say nothing about the work
    width = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bins.repartition(width, page).sortWithinPartitions(page).mapInArrow(run, schema)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A sorted column as the number of its value, from 0, and the values."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _palettes(rows: pa.Table, page: str, k: int, least: float, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Palettes of whole pages: those with about equally many bins are cut together."""
    codes, idents = _coded(rows[page])
    sheet = rows["paper"].to_numpy()
    lab, n = np.stack([rows[c].to_numpy() for c in ("L", "A", "B")], axis=1), rows["n"].to_numpy()
    order = np.lexsort((*lab.T, n, sheet, codes))
    lab, n, sheet, codes = lab[order], n[order], sheet[order], codes[order]
    total = np.bincount(codes, weights=n, minlength=len(idents))
    inked = np.bincount(codes[~sheet], minlength=len(idents))
    starts = np.searchsorted(codes, np.arange(len(idents)))  # a page's paper comes after its other colours
    found = []
    for size in np.unique(np.ceil(np.log2(inked[inked > 0])).astype(int)):
        pages = np.flatnonzero((inked > 0) & (np.ceil(np.log2(np.maximum(inked, 1))).astype(int) == size))
        step = max(1, BINS_AT_ONCE >> int(size))
        for some in (pages[i : i + step] for i in range(0, len(pages), step)):
            place = np.arange(inked[some].max())
            there = place < inked[some][:, None]
            at = np.where(there, starts[some][:, None] + place, 0)
            weight, mean = colours_of(lab[at], np.where(there, n[at], 0.0), k)
            one, colour = np.nonzero((weight > 0) & (weight / total[some][:, None] >= least))
            found.append((some[one], weight[one, colour], mean[one, colour]))
    ids, weight, mean = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), np.zeros(0), np.zeros((0, 3)))
    order = np.lexsort((*mean.T[::-1], -weight, ids))
    ids, weight, mean = ids[order], weight[order], mean[order]
    named = (np.arange(len(ids)) - np.searchsorted(ids, ids)).astype(str).astype(object)
    white = np.bincount(codes[sheet], weights=n[sheet], minlength=len(idents))
    papers = np.flatnonzero(white > 0)
    sums = np.stack([np.bincount(codes[sheet], weights=n[sheet] * x, minlength=len(idents)) for x in lab[sheet].T], axis=1)
    ids, weight = np.concatenate((ids, papers)), np.concatenate((weight, white[papers]))
    mean = np.concatenate((mean, sums[papers] / white[papers][:, None]))
    columns = [[round(v, 1) for v in x.tolist()] for x in mean.T] + [[round(v, 4) for v in (weight / total[ids]).tolist()]]
    colour = pa.array([*named, *["paper"] * len(papers)], pa.string())
    yield pa.RecordBatch.from_arrays([idents.take(pa.array(ids)), colour, *[pa.array(c, pa.float64()) for c in columns]], names=list(names))


def colours_of(lab: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (pages, k) and means (pages, k, 3) of each page's colours, from its bins lab (pages, bins, 3) counted n times.

    What `cut_boxes` and `joined` do for one page, for all of them at once; bins counted 0 times are none.
    """
    pages = np.arange(len(n))
    scaled = lab * np.array([LIGHTNESS_SHARE, 1.0, 1.0])
    box = np.where(n > 0, 0, -1)
    gains, axes, marks = (np.zeros((len(n), k)) for _ in range(3))

    def cut(boxes: np.ndarray) -> None:
        """The best cut of one box of each page: its gain, axis, and the first value of the second side."""
        inside = box == boxes[:, None]
        weight = np.where(inside, n, 0.0)
        best, axis_of, mark = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
        for axis in range(3):
            order = np.argsort(np.where(inside, scaled[:, :, axis], np.inf), axis=1, kind="stable")
            x, w = np.take_along_axis(scaled[:, :, axis], order, 1), np.take_along_axis(weight, order, 1)
            left, sums = np.cumsum(w, axis=1), np.cumsum(w * x, axis=1)
            whole, moment = left[:, -1:], sums[:, -1:]
            left, sums = left[:, :-1], sums[:, :-1]
            can = (w[:, 1:] > 0) & (x[:, 1:] != x[:, :-1])
            right = np.where(can, whole - left, 1.0)
            left, whole = np.where(can, left, 1.0), np.where(whole > 0, whole, 1.0)
            gain = np.where(can, left * right / whole * (sums / left - (moment - sums) / right) ** 2, 0.0)
            if not gain.shape[1]:
                continue
            at = gain.argmax(axis=1)
            better = gain[pages, at] > best
            best = np.where(better, gain[pages, at], best)
            axis_of, mark = np.where(better, axis, axis_of), np.where(better, x[pages, at + 1], mark)
        gains[pages, boxes], axes[pages, boxes], marks[pages, boxes] = best, axis_of, mark

    cut(np.zeros(len(n), int))
    for new in range(1, k):
        # a page without a cut left gets none: its new boxes are empty
        at = gains.argmax(axis=1)
        value = np.take_along_axis(scaled, axes[pages, at].astype(int)[:, None, None], 2)[:, :, 0]
        moved = (gains[pages, at] > 0)[:, None] & (box == at[:, None]) & (value >= marks[pages, at][:, None])
        if not moved.any():
            break
        box[moved] = new
        cut(at)
        cut(np.full(len(n), new))
    weight = np.stack([np.where(box == b, n, 0.0).sum(axis=1) for b in range(k)], axis=1)
    sums = np.stack([(lab * np.where(box == b, n, 0.0)[:, :, None]).sum(axis=1) for b in range(k)], axis=1)
    for _ in range(k - 1):
        means = sums / np.where(weight > 0, weight, 1.0)[:, :, None] * np.array([LIGHTNESS_SHARE, 1.0, 1.0])
        apart = np.sqrt(((means[:, :, None] - means[:, None]) ** 2).sum(3))
        some = (weight[:, :, None] > 0) & (weight[:, None] > 0) & ~np.eye(k, dtype=bool)
        apart = np.where(some, apart, np.inf).reshape(len(n), -1)
        at = apart.argmin(axis=1)
        near = np.flatnonzero(apart[pages, at] < CLOSE_COLOURS)
        if not len(near):
            break
        i, j = at[near] // k, at[near] % k
        weight[near, i] += weight[near, j]
        sums[near, i] += sums[near, j]
        weight[near, j], sums[near, j] = 0.0, 0.0
    return weight, sums / np.where(weight > 0, weight, 1.0)[:, :, None]


def cut_boxes(lab: np.ndarray, n: np.ndarray, k: int) -> list[np.ndarray]:
    """Indexes of up to k boxes of weighted colours."""
    scaled = lab * np.array([LIGHTNESS_SHARE, 1.0, 1.0])

    def cut(box: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        best = None
        for axis in range(3):
            order = box[np.argsort(scaled[box, axis], kind="stable")]
            x, w = scaled[order, axis], n[order]
            left, sums = np.cumsum(w)[:-1], np.cumsum(w * x)[:-1]
            right = w.sum() - left
            gain = left * right / w.sum() * (sums / left - ((w * x).sum() - sums) / right) ** 2
            gain[x[1:] == x[:-1]] = 0
            if len(gain) and gain.max() > 0 and (best is None or gain.max() > best[0]):
                at = int(gain.argmax()) + 1
                best = (float(gain.max()), order[:at], order[at:])
        return best

    boxes = [np.arange(len(lab))]
    cuts = [cut(boxes[0])]
    while len(boxes) < k and any(cuts):
        at = max((i for i, c in enumerate(cuts) if c), key=lambda i: cuts[i][0])
        _, one, two = cuts[at]
        boxes[at : at + 1], cuts[at : at + 1] = [one, two], [cut(one), cut(two)]
    return boxes


def joined(boxes: list[np.ndarray], lab: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Boxes whose mean colours are close put together, the closest first."""
    boxes = list(boxes)
    while len(boxes) > 1:
        means = np.array([np.average(lab[b], axis=0, weights=n[b]) for b in boxes]) * np.array([LIGHTNESS_SHARE, 1.0, 1.0])
        apart = np.sqrt(((means[:, None] - means) ** 2).sum(2)) + np.where(np.eye(len(boxes)), np.inf, 0)
        i, j = np.unravel_index(apart.argmin(), apart.shape)
        if apart[i, j] >= CLOSE_COLOURS:
            break
        boxes[i] = np.concatenate((boxes[i], boxes[j]))
        del boxes[j]
    return boxes
