"""Helpers of the text operators: tables, byte-wise normalisers, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.session import hand_over

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _LOWER.encode())

_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a number written as decimal text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def in_slices(items: list, weights: list[int], limit: int):
    """Consecutive slices of about `limit` total weight, at least one item each."""
    start = total = 0
    for at, weight in enumerate(weights):
        if at > start and total + weight > limit:
            yield items[start:at]
            start, total = at, 0
        total += weight
    if start < len(items):
        yield items[start:]


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: workers live on in later stages and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A task function over batches that gives its memory back when it has ended."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


#: A key counts as heavy from this share of all rows on, so that there are at most this many heavy keys.
HEAVY = 1000


def look_up(rows: DataFrame, facts: DataFrame, key: str, count: str, heavy: int = HEAVY) -> DataFrame:
    """Left join of rows with facts, one row per value of `key` (null is a value of its own).

    `count` is the column of facts with the rows of the key. Keys with a thousandth of all rows or more, a
    thousand of them at most, are broadcast, so that a hot key stays where it is; the others are joined by a
    shuffle. Both inputs are read twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * heavy >= total
    fields = [c for c in facts.columns if c not in (key, count)]
    names = [F.col(c).alias(f"__{c}") for c in fields]
    many = facts.where(hot).select(F.col(key).alias("__key"), F.lit(True).alias("__hot"), *names)
    few = facts.where(~hot).select(F.col(key).alias("__key"), *names)
    met = rows.join(F.broadcast(many), rows[key].eqNullSafe(many["__key"]), "left")
    out = [*[F.col(c) for c in rows.columns], *[F.col(f"__{c}").alias(c) for c in fields]]
    rest = met.where("__hot IS NULL").select(*rows.columns)
    rest = rest.join(few, rest[key].eqNullSafe(few["__key"]), "left")
    return met.where("__hot").select(*out).unionByName(rest.select(*out))


def codes_of(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with a boundary before and after, and the length of each."""
    codes = np.frombuffer((" " + "  ".join(group) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.array([len(w) + 2 for w in group])


def grams_of(codes: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1 .. order: hashes of the n codes that end at each place (0 where they leave the word)."""
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.arange(len(codes)) - start
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(codes), np.uint64)
        for n in range(1, order + 1):
            back = np.arange(len(codes)) - (n - 1)
            hashes = (hashes ^ (codes[np.maximum(back, 0)] + np.uint64(n << 32))) * _MIX
            hashes = hashes ^ (hashes >> np.uint64(29))
            yield np.where(inside >= n - 1, hashes | np.uint64(1), np.uint64(0))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of longs: one row (node, root) per linked node.

    Alternates large-star and small-star steps until the set of edges stays the same: every node then
    hangs on the smallest node of its component. A step is a minimum per node (combined before the
    shuffle) and a join that adaptive execution may split, so a node with very many links needs no
    task of its own; each round is written to the shared folder. Links with a null or a self-link
    are left out; no links give no rows.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull())
        .distinct()
    )
    edges, seen = hand_over(edges, "links"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select("lo", "lo").distinct()
            )
        seen = tuple(mark)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = hand_over(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
