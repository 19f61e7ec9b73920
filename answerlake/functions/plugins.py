"""Places to plug in: named table steps, crop classifiers, zone readers and a SQL table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.config import expand_fields

STEPS: dict[str, Callable[..., DataFrame]] = {}
READS = "scan_id bigint, name string, engine int, text string, confidence double"


def step(name: str):
    """Register a DataFrame step under a name templates can use."""

    def add(function: Callable[..., DataFrame]):
        STEPS[name] = function
        return function

    return add


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Apply named steps in order."""
    for name, options in steps:
        df = STEPS[name](df, **options)
    return df


def classifier(load: Callable[[], Callable[[np.ndarray], np.ndarray]]):
    """A column function from a model: `load` runs once per task and returns batch -> probability."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(np.stack(batch.to_numpy())))

    return predict


def zone_reader(crops: DataFrame, engine: int, load: Callable[[], Callable[[bytes], tuple[str, float]]]) -> DataFrame:
    """Candidate reads of crops(scan_id, name, crop) by one engine, in the form `decode.vote` takes;
    a crop the engine fails on is read as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for batch in batches:
            out = []
            for crop in batch["crop"]:
                try:
                    out.append(read(crop))
                except Exception:  # noqa: BLE001 - a broken crop must not lose the sheet
                    out.append(("", 0.0))
            text, confidence = zip(*out) if out else ((), ())
            yield batch[["scan_id", "name"]].assign(engine=engine, text=text, confidence=confidence)

    return crops.select("scan_id", "name", "crop").mapInPandas(run, READS)


@F.udtf(returnType="pos int, name string")
class ExpandFields:
    """Names of a field range, for SQL: SELECT * FROM t, LATERAL expand_fields(t.span)."""

    def eval(self, text: str):
        try:
            names = expand_fields([text])
        except ValueError:
            return
        for pos, name in enumerate(names, 1):
            yield pos, name


def register(spark: SparkSession) -> None:
    spark.udtf.register("expand_fields", ExpandFields)
