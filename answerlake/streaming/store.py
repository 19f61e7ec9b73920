"""A table of the newest row per key that a stream keeps up to date, as a few levelled files sets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlake.operators import listing


class KeyedStore:
    """The newest row of every key, whichever batch brought it.

    Every batch becomes one file set. A batch is merged with the sets of level 0, 1, 2 .. that end the list, as
    a binary counter carries, so after n batches there are at most log2(n) + 1 sets and a row is rewritten log2(n)
    times. A manifest names the sets that count; a batch shows once its manifest, one small file that Spark's
    committer moves into place, is there. A batch that is given again after a failure finds its number in the
    manifest and changes nothing; file sets that never reached a manifest, and merged ones, are left to the
    retention rule of the folder.

    Rows of a key are compared by `order`, then by a hash of the row, so equal orders give one fixed row.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.order = list(keys), list(order)
        self.version, self.batch, self.sets = 0, -1, []
        try:
            found = spark.read.text(f"{self.root}/manifest/*").orderBy(F.get_json_object("value", "$.version").cast("long").desc()).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        if found:
            state = json.loads(found["value"])
            self.version, self.batch, self.sets = state["version"], state["batch"], state["sets"]

    def newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys and c not in self.order]
        place = F.struct(*self.order, F.xxhash64(*rest, *self.order))
        return listing.newest(rows, self.keys, place).select(*self.schema.fieldNames())

    def _set(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}")

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Take in a batch; false if it, or a later one, is there already."""
        if batch <= self.batch:
            return False
        level, sets, parts = 0, list(self.sets), [rows.select(*self.schema.fieldNames())]
        while sets and sets[-1]["level"] == level:
            parts.append(self._set(sets.pop()["name"]))
            level += 1
        name = f"set-{level}-{uuid.uuid4().hex}"
        self.newest(reduce(DataFrame.unionByName, parts)).write.parquet(f"{self.root}/{name}")
        self._switch(batch, [*sets, {"name": name, "level": level}])
        return True

    def _switch(self, batch: int, sets: list[dict]) -> None:
        version = self.version + 1
        line = json.dumps({"version": version, "batch": batch, "sets": sets})
        row = self.spark.createDataFrame([(line,)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.root}/manifest/{version:012d}")
        self.version, self.batch, self.sets = version, batch, sets

    def read(self) -> DataFrame:
        if not self.sets:
            return self.spark.createDataFrame([], self.schema)
        parts = [self._set(s["name"]) for s in self.sets]
        return parts[0] if len(parts) == 1 else self.newest(reduce(DataFrame.unionByName, parts))
