import numpy as np
from pyspark.sql import functions as F

from answerlake.functions import plugins
from answerlake.operators import decode


def test_steps_classifier_and_readers(spark):
    @plugins.step("darker")
    def darker(df, by):
        return df.withColumn("v", F.col("v") - by)

    df = spark.createDataFrame([(1, 9.0), (2, 5.0)], "i int, v double")
    out = plugins.run_steps(df, [("darker", {"by": 1.0}), ("darker", {"by": 2.0})])
    assert [r["v"] for r in out.orderBy("i").collect()] == [6.0, 2.0]

    predict = plugins.classifier(lambda: lambda crops: crops.mean(axis=1) / 10)
    arrays = df.withColumn("crop", F.array("v", "v"))
    assert [r["p"] for r in arrays.select("i", predict("crop").alias("p")).orderBy("i").collect()] == [0.9, 0.5]

    crops = spark.createDataFrame([(1, "z", b"12"), (2, "z", b"")], "scan_id bigint, name string, crop binary")

    def reader():
        def read(crop):
            if not crop:
                raise ValueError("nothing to read")
            return crop.decode(), 0.9

        return read

    votes = {r["scan_id"]: r for r in decode.vote(plugins.zone_reader(crops, 1, reader), r"\d+").collect()}
    assert votes[1]["value"] == "12" and votes[2]["flags"] == ["empty"]
    assert np.isclose(votes[1]["confidence"], 0.9)


def test_table_function(spark):
    plugins.register(spark)
    rows = spark.sql("SELECT t.s, e.name FROM VALUES ('q1..3'), ('x'), ('q3..1') AS t(s), LATERAL expand_fields(t.s) e").collect()
    assert sorted(r["name"] for r in rows) == ["q1", "q2", "q3", "x"]
