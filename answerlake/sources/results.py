"""Stored results and file listings: JSON lines, trees of result documents, rasters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_LINES = "scan_id bigint, source_path string, page int, status string, score double, _cut string"
DOCUMENT = (
    "scan_id bigint, status string, fields map<string, struct<value:string, confidence:double, "
    "flags:array<string>, needs_review:boolean>>, review array<struct<kind:string, name:string>>"
)
# Names copy programs use while a file is still arriving.
TEMPORARY = (".tmp", ".part", ".partial", ".crdownload", ".download", ".filepart")


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines to resume from: lines cut short are dropped, and so is every page of a file
    one of whose pages failed."""
    rows = (
        spark.read.schema(RESULT_LINES)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_cut")
        .json(path)
    )
    whole = rows.where("_cut IS NULL").drop("_cut")
    failed = whole.where("status = 'error'").select("source_path").distinct()
    return whole.join(failed, "source_path", "left_anti")


def read_result_tree(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Result documents below a folder, however deep; multi_line for one document per file."""
    reader = spark.read.schema(DOCUMENT).option("recursiveFileLookup", "true").option("multiLine", multi_line)
    return reader.json(path)


def shred(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, review items) of result documents."""
    readings = documents.select("scan_id", "status", F.explode("fields").alias("name", "reading")).select(
        "scan_id", "status", "name", "reading.*"
    )
    review = documents.select("scan_id", F.inline("review"))
    return readings, review


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """files(path, length, modified) below a folder: hidden, temporary and empty ones held back.

    Only the listing is read; the files' content column is pruned.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    wanted = name.rlike(rf"\.({'|'.join(suffixes)})$")
    arriving = name.startswith(".") | name.startswith("~$")
    for suffix in TEMPORARY:
        arriving = arriving | name.endswith(suffix)
    return files.where(wanted & ~arriving & (F.col("length") > 0))


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """pages(scan_id, width, height, pixels) from binary grey maps named by their scan id."""

    def parse(batches):
        for batch in batches:
            rows = []
            for path_of, content in zip(batch["path"], batch["content"]):
                kind, width, height, top = content[:64].split(maxsplit=4)[:4]
                size = int(width) * int(height)
                if kind != b"P5" or top != b"255":
                    raise ValueError(f"{path_of} is not an 8-bit grey map")
                stem = path_of.rsplit("/", 1)[-1].split(".")[0]
                rows.append((int(stem.lstrip("S") or 0), int(width), int(height), content[-size:]))
            yield pd.DataFrame(rows, columns=["scan_id", "width", "height", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path).select("path", "content")
    return files.mapInPandas(parse, "scan_id bigint, width int, height int, pixels binary")


def grey_map(page: np.ndarray) -> bytes:
    """An 8-bit page in the format read_rasters reads."""
    h, w = page.shape
    return b"P5\n%d %d\n255\n" % (w, h) + page.astype(np.uint8).tobytes()
