"""Writers: typed CSV, JSON lines, routed results, training samples and keyed tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlake.operators import listing
from answerlake.operators.export import ExportColumn, csv_columns

# Texts as they are, blanks at their ends included
PLAIN_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def write_csv(df: DataFrame, path: str, columns: Sequence[ExportColumn], delimiter=",", zeros="none", header=True):
    """Typed CSV, one file per task; the guard keeps spreadsheets from dropping zeros."""
    rows = csv_columns(df, columns, zeros)
    writer = rows.write.option("sep", delimiter).option("header", header).option("emptyValue", "")
    writer.option("quoteAll", False).option("escape", '"').csv(path)


def write_job_tables(df: DataFrame, path: str, job: str, order: Sequence[str]) -> None:
    """A folder of CSV files with headers per job, the rows of a job in order; a large job is several files.

    Empty texts are quoted, so that reading keeps them apart from missing values.
    """
    rows = df.repartitionByRange(job, *order).sortWithinPartitions(job, *order)
    rows.write.partitionBy(job).options(**PLAIN_CSV).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """One flat CSV table with a header in every file."""
    df.write.options(**PLAIN_CSV).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What `write_table` or `write_job_tables` wrote; a quoted empty text stays one, nothing at all is null."""
    reader = spark.read.schema(schema).options(**PLAIN_CSV).option("nullValue", "\x01")
    return reader.csv(path).select(*schema.fieldNames())


def write_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    df.write.mode("append").json(path)


def write_routed(df: DataFrame, path: str) -> None:
    """One folder per route; rebalancing writes a large route as several even files."""
    df.hint("rebalance", "route").write.partitionBy("route").parquet(path)


def write_sharded(df: DataFrame, path: str, ident: str = "scan_id") -> None:
    """Documents in folders by the first two characters of their id's hash, which spreads them evenly."""
    shard = F.substring(F.md5(F.col(ident).cast("string")), 1, 2)
    rows = df.withColumn("shard", shard).hint("rebalance", "shard")
    rows.write.partitionBy("shard").json(path)


def append_samples(df: DataFrame, path: str) -> None:
    """Training samples as compressed JSON lines: a row per bubble repeats its names and its path."""
    df.write.mode("append").json(path, compression="gzip")


def upsert_table(spark: SparkSession, target: str, changes: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """A keyed table with the changes over it, new columns included, written to a new path; readers
    move to `out` once it is complete, so a failed job leaves the old table whole."""
    bad = [c for c in changes.columns if not IDENTIFIER.fullmatch(c)]
    if bad:
        raise ValueError(f"{bad[0]!r} is not a column name")
    merged = listing.upsert(spark.read.parquet(target), changes, keys)
    merged.write.parquet(out)
    return spark.read.schema(merged.schema).parquet(out)


def write_staging(df: DataFrame, url: str, table: str, batch: int = 5000, **options) -> None:
    """Rows into a database's staging table; the database then merges it into its own table."""
    if not IDENTIFIER.fullmatch(table):
        raise ValueError(f"{table!r} is not a table name")
    df.write.mode("overwrite").option("batchsize", batch).options(**options).jdbc(url, table)
