import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from answerlake.operators import ranking


def skewed(n=4000, seed=3):
    """A third of the rows in one group, some rows in a missing group, values with ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"g{rng.randint(0, 30)}")
        rows.append((i, group, rng.choice([1.0, 2.0, rng.random() * 100])))
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["id", "grp", "value"])


def test_numbered_per_group(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    out = ranking.numbered(df, [F.col("value"), F.col("id")], F.col("value"), within=["grp"], name="n").toPandas()
    want = pdf.sort_values(["value", "id"]).groupby("grp", dropna=False).cumcount() + 1
    got = out.set_index("id")["n"].sort_index()
    assert (got == pd.Series(want.values, index=pdf.loc[want.index, "id"].values).sort_index()).all()
    assert len(out) == len(pdf)


def test_the_spread_is_worked_out_outside_the_search(spark):
    # in the search's lambdas, where it would run for every cut point, a Python function is refused
    half = F.udf(lambda x: x / 2.0, "double")
    out = ranking.numbered(spark.range(1000), [F.col("id")], half("id"), name="n").collect()
    assert all(r["n"] == r["id"] + 1 for r in out) and len(out) == 1000


def test_neighbours_descending(spark):
    pdf = skewed(1500)
    out = ranking.neighbours(spark.createDataFrame(pdf), "id", [F.desc("id")], -F.col("id")).toPandas().set_index("id")
    for i in (0, 1, 700, 1499):
        before, after = out.loc[i, "previous_id"], out.loc[i, "next_id"]
        assert (pd.isna(before) and i == 1499) or before == i + 1
        assert (pd.isna(after) and i == 0) or after == i - 1


def test_quantiles_match_linear_interpolation(spark):
    pdf = skewed().dropna()
    out = ranking.quantiles(spark.createDataFrame(pdf), ["grp"], "value", {"p5": 0.05, "p95": 0.95}).toPandas()
    for row in out.itertuples():
        values = pdf[pdf.grp == row.grp].value
        assert np.isclose(row.p5, np.percentile(values, 5)) and np.isclose(row.p95, np.percentile(values, 95))
        assert row.count == len(values)


def test_tile_is_the_divmod_split(spark):
    for total, parts in ((23, 5), (3, 5), (10, 3)):
        tile = ranking.tile(F.col("id") + 1, F.lit(total), parts)
        got = [r["t"] for r in spark.range(total).select(tile.alias("t")).collect()]
        sizes = [total // parts + (i < total % parts) for i in range(parts)]
        assert got == [i + 1 for i, size in enumerate(sizes) for _ in range(size)]
