"""Session set-up and the shared folder used for checkpoints and written hand-over tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "answerlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are designed for; cluster settings win if given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Batches of pages are cut by size, not only by rows
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where one process does all work."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one run."""
    return f"{shared_root(spark)}/answerlake/{uuid.uuid4().hex}/{name}"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it has ended; for queries whose result is written or collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hand_over(df: DataFrame, name: str, tidy: bool = False, **options: str) -> DataFrame:
    """Cut lineage by writing a table and reading it back (survives lost executors); tidy: the shuffles behind it go."""
    path = scratch(df.sparkSession, name)
    with tidied(df.sparkSession) if tidy else nullcontext():
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
