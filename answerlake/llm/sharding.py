"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly, bytes first of all.

A group is all rows of equal text (null counts as empty) and stays together unless it alone is more than
a fraction of a shard; then its rows are dealt into parts by a hash. Packing has two levels, so that
no task sees all groups: a bucket of groups is packed into bundles, largest first, each where the dot
product of its sizes with the residual capacity is highest; then the bundles of all buckets, whose
number only the parameters set, are packed into the shards in the same way.

Repeated rows are rows of their own; null ids are kept; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.session import hand_over

SHARDS = 16
#: A group is split when it holds more than 1/HEAVY of a shard's bytes, tokens or rows.
HEAVY = 8
BUNDLES = 32
LEAST_BUCKETS = 64
SIZES = ("bytes", "tokens", "rows")
#: How much each size counts in the dot product: the law is near-equal bytes.
WEIGHTS = np.array([8.0, 1.0, 1.0])


class Bins:
    """Bins of equal capacity in every dimension."""

    def __init__(self, totals: np.ndarray, bins: int):
        self.scale = np.where(totals > 0, bins / np.maximum(totals, 1), 0.0)
        self.residual = np.ones((bins, len(totals)))

    def place(self, sizes: np.ndarray) -> int:
        share = sizes * self.scale
        at = int(np.argmax(self.residual @ (WEIGHTS * share)))
        self.residual[at] -= share
        return at


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
    )


def _bundled(items: DataFrame, buckets: int, bundles: int) -> DataFrame:
    """items (key, part, bytes, tokens, rows) with their bucket and bundle."""
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int"))
    totals = items.groupBy("bucket").agg(*[F.sum(s).alias(f"all_{s}") for s in SIZES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bins = None, None
        for batch in batches:
            numbers = batch.column(2).to_pylist()
            sizes, totals = (
                np.stack([batch.column(i).to_numpy() for i in range(at, at + 3)], axis=1).astype(float) for at in (3, 6)
            )
            placed = np.empty(len(numbers), np.int32)
            for i, number in enumerate(numbers):
                if number != bucket:
                    bucket, bins = number, Bins(totals[i], bundles)
                placed[i] = bins.place(sizes[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(placed)], ["key", "part", "bucket", *SIZES, "bundle"]
            )

    return (
        items.join(totals, "bucket")
        .select("key", "part", "bucket", *SIZES, *[f"all_{s}" for s in SIZES])
        .repartition("bucket").sortWithinPartitions("bucket", F.desc("bytes"), "key", "part")
        .mapInArrow(run, "key binary, part int, bucket int, bytes long, tokens long, rows long, bundle int")
    )


def assign(docs: DataFrame, shards: int = SHARDS, heavy: int = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot (gapless from 0 in a shard) of every document."""
    spark = docs.sparkSession
    rows = hand_over(_rows(docs), "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = np.array([n or 0 for n in rows.agg(*sums).first()], float)
    # at most three times shards * heavy groups can be this large, so their list may be broadcast
    limits = np.maximum(totals / (shards * heavy), 1)
    parts = F.ceil(F.greatest(*[F.col(s) / F.lit(float(n)) for s, n in zip(SIZES, limits)])).cast("int")
    split = rows.groupBy("key").agg(*sums).withColumn("parts", parts).where((F.col("parts") > 1) & (F.col("rows") > 1))
    rows = (
        rows.join(F.broadcast(split.select("key", "parts")), "key", "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int"))
        .drop("parts")
    )
    buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = hand_over(_bundled(rows.groupBy("key", "part").agg(*sums), buckets, bundles), "bundles")
    # buckets * bundles rows at most, whatever the number of documents
    sized = items.groupBy("bucket", "bundle").agg(*[F.sum(s).alias(s) for s in SIZES])
    sized = sorted(sized.collect(), key=lambda r: (-r["bytes"], r["bucket"], r["bundle"]))
    bins, filled, placed = Bins(totals, shards), [0] * shards, []
    for r in sized:
        shard = bins.place(np.array([r[s] for s in SIZES], float))
        placed.append((r["bucket"], r["bundle"], shard, filled[shard]))
        filled[shard] += r["rows"]
    places = spark.createDataFrame(placed, "bucket int, bundle int, shard int, first long")
    own = Window.partitionBy("bucket", "bundle").orderBy("doc_id", "text_crc32", "size", "key")
    return (
        rows.join(items.select("key", "part", "bucket", "bundle"), ["key", "part"])
        .withColumn("at", F.row_number().over(own) - 1)
        .join(F.broadcast(places), ["bucket", "bundle"])
        .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))
    )


def write(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Parquet files by shard, rows in slot order; documents are matched by doc_id."""
    rows = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
