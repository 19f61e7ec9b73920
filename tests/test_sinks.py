"""What the sinks leave in the shared folder."""

from pathlib import Path

from answerlake.plans import catalog
from answerlake.sinks import writers

SF = "/root/testdata/sf0.001"


def test_samples_are_appended_compressed(spark, tmp_path):
    """Appending twice keeps both batches; the repeated names and paths of a manifest take little room."""
    path = str(tmp_path / "samples")
    rows = [(f"marked/S{i}_q{i % 7}_A", "marked", i / 1000, None if i % 5 else "") for i in range(4000)]
    frame = spark.createDataFrame(rows, "path string, label string, confidence double, note string").coalesce(2)
    writers.append_samples(frame, path)
    writers.append_samples(frame.where("confidence < 1"), path)
    got = [tuple(r) for r in spark.read.schema(frame.schema).json(path).collect()]
    assert sorted(got, key=repr) == sorted(rows + rows[:1000], key=repr)
    files = list(Path(path).glob("part-*"))
    assert files and sum(f.stat().st_size for f in files) < sum(len(r[0]) + len(r[1]) for r in got) / 2


def test_training_works_out_its_bubbles_once(spark):
    """Both appends read the written bubbles, so lines are read by one job group of the query and not by every append."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalog.queries()["snk_training"](spark, SF).collect()
    # sharedState keeps executions in order; those of this query are the last ones
    new = store.executionsList(before, store.executionsCount() - before)
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size())]
    assert sum("lineitem.parquet" in p for p in plans) == 1
