"""Exact numbering and neighbours over an order that no single task has to sort.

Rows are cut into value ranges of a numeric column that leads the order; ranges hold about
equally many rows because the cut points are approximate percentiles. A row's number is its
place in its range plus the rows in earlier ranges, so one hot group is spread over many tasks.
The cut points are literals: a recomputed task always finds the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER_BUCKETS = 256  # ranges per order at least; as many as shuffle partitions, so that setting bounds a range


def cut_points(df: DataFrame, spread: Column, buckets: int) -> list[float]:
    """At most `buckets` cut points: one small row, however large the data is."""
    share = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    row = df.agg(F.percentile_approx(spread.cast("double"), share, 10 * buckets).alias("p")).first()
    return sorted(set(row["p"] or []))


def range_of(spread: Column, cuts: Sequence[float]) -> Column:
    """How many cut points are at or below the value, found in two short steps."""
    if not cuts:
        return F.lit(0)
    value = spread.cast("double")
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def below(points: Column) -> Column:
        return F.size(F.filter(points, lambda p: p <= value))

    heads = F.array(*[F.lit(float(g[0])) for g in groups])
    table = F.array(*[F.array(*[F.lit(float(p)) for p in g]) for g in groups])
    group = F.greatest(below(heads), F.lit(1))
    return (group - 1) * step + below(F.element_at(table, group))


def _ranged(df: DataFrame, spread: Column) -> DataFrame:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(ORDER_BUCKETS, shuffle)
    # A column of its own: within the search a row's value would be worked out again for every cut point
    valued = df.withColumn("_spread", spread.cast("double"))
    return valued.withColumn("_range", range_of(F.col("_spread"), cut_points(df, spread, buckets))).drop("_spread")


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    spread: Column,
    within: Sequence[str] = (),
    name: str = "number",
) -> DataFrame:
    """Add the 1-based place of each row in `order`, counted separately per `within`.

    `spread` is a numeric column that never falls along `order`.
    """
    ranged = _ranged(df, spread)
    keys = [*within, "_range"]
    before = (
        Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = Window.partitionBy(*keys).orderBy(*order)
    return (
        _join_ranges(ranged.withColumn("_place", F.row_number().over(place)), offsets, keys)
        .withColumn(name, F.col("_place").cast("long") + F.col("_before"))
        .drop("_range", "_place", "_before")
    )


def neighbours(
    df: DataFrame,
    ident: str,
    order: Sequence[Column],
    spread: Column,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add previous_id and next_id of each row in `order`, per `within`."""
    ranged = _ranged(df, spread)
    keys = [*within, "_range"]
    place = Window.partitionBy(*keys).orderBy(*order)
    edge = Window.partitionBy(*within).orderBy("_range")
    local = ranged.withColumn("_prev", F.lag(ident).over(place)).withColumn(
        "_next", F.lead(ident).over(place)
    )
    edges = (
        local.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_prev").isNull(), F.col(ident))).alias("_first"),
            F.max(F.when(F.col("_next").isNull(), F.col(ident))).alias("_last"),
        )
        .select(
            *keys,
            F.lag("_last").over(edge).alias("_before"),
            F.lead("_first").over(edge).alias("_after"),
        )
    )
    return (
        _join_ranges(local, edges, keys)
        .withColumn("previous_id", F.coalesce("_prev", "_before"))
        .withColumn("next_id", F.coalesce("_next", "_after"))
        .drop("_range", "_prev", "_next", "_before", "_after")
    )


def _join_ranges(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the range keys, null-safe: a missing group is a group of its own."""
    right = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in edges.columns if c not in keys])
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return rows.join(right, on, "left").drop(*[f"_k_{k}" for k in keys])


def tile(number: Column, total: Column, parts: int) -> Column:
    """Which of `parts` equal runs a place falls in; the first runs take the remainder."""
    base = F.floor(total / parts)
    extra = total % parts
    cut = extra * (base + 1)
    return F.when(number <= cut, F.ceil(number / (base + 1))).otherwise(
        extra + F.ceil((number - cut) / F.greatest(base, F.lit(1)))
    ).cast("int")


def quantiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group as columns, with count, mean and max.

    Equal values are counted first, then the distinct values are ranked in ranges, so neither
    a frequent value nor a large group lands in one task.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranged = _ranged(hist, F.col("_v"))
    keys = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        ranged.groupBy(*keys)
        .agg(F.sum("_n").alias("_m"))
        .select(
            *keys,
            F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
            F.sum("_m").over(whole).alias("_all"),
        )
    )
    place = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = _join_ranges(ranged.withColumn("_upto", F.sum("_n").over(place)), offsets, keys)
    upto, last = F.col("_upto") + F.col("_before"), F.col("_all") - 1

    def at(share: float, side) -> Column:
        return F.min(F.when(upto > side(last * share), F.col("_v")))

    out = rows.groupBy(*group).agg(
        F.max("_all").alias("count"),
        (F.sum(F.col("_v") * F.col("_n")) / F.max("_all")).alias("mean"),
        F.max("_v").alias("max"),
        *[at(q, F.floor).alias(f"_lo_{name}") for name, q in shares.items()],
        *[at(q, F.ceil).alias(f"_hi_{name}") for name, q in shares.items()],
    )
    for name, q in shares.items():
        low, high, exact = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), (F.col("count") - 1) * q
        out = out.withColumn(name, low + (high - low) * (exact - F.floor(exact)))
    return out.drop(*[c for c in out.columns if c.startswith(("_lo_", "_hi_"))])
