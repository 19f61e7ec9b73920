"""Sets of equal fills keep their row; a template's range has two names at least; no hidden cut."""

from pyspark.sql import functions as F

from answerlake.functions import text as tx
from answerlake.operators import listing
from answerlake.plans.decoding import fill_threshold


def test_flat_fills_get_the_default(spark):
    fills = spark.createDataFrame([("a", 9.0)] * 4 + [("b", 0.0)] * 5 + [("b", 200.0)] * 5, "name string, fill double")
    found = {r["name"]: r["threshold"] for r in fill_threshold(fills, "name").collect()}
    assert found["a"] == 60.0 and 25 <= found["b"] <= 150


def test_strict_ranges(spark):
    frame = spark.createDataFrame([("q5..5",), ("q5..6",)], "t string")
    rows = frame.select(tx.range_names(F.col("t")), tx.range_names(F.col("t"), strict=True)).collect()
    assert [tuple(r) for r in rows] == [(["q5"], None), (["q5", "q6"], ["q5", "q6"])]


def test_all_duplicates_are_listed(spark):
    scans = spark.range(120).select(F.col("id").alias("scan_id"), F.lit(1).alias("job_id"), F.lit("k").alias("primary_key"))
    assert listing.duplicates_of(scans, 3).count() == 119
    assert listing.duplicates_of(scans, 3, most=50).count() == 50
