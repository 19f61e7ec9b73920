"""Tiles of vectors against all pairs, and what of them is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlake.llm import embeddings
from answerlake.session import hand_over


def made(spark, kind):
    """Directions without principal axes, near copies of some, equal vectors under other ids, negative zeros."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 24))
    base[:5, :3] = 0.0
    rows = np.concatenate((base, base[:60] + rng.normal(size=(60, 24)) * 0.05, base[:40], np.where(base[:5] == 0, -0.0, base[:5])))
    rows = rows.astype(np.float32)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"vec_id long, embedding array<{kind}>")
    units = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    close = units @ units.T >= 0.95
    return frame, {i: int(close[i].sum()) - 1 for i in range(len(rows))}, {i: int(np.flatnonzero(c)[0]) for i, c in enumerate(close)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_tiles_against_all_pairs(spark, kind):
    frame, links, first = made(spark, kind)
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, tile=16).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["component_id"] for i, r in found.items()} == first


def test_classes_that_share_a_hash_are_told_apart_by_their_vectors(spark, monkeypatch):
    frame, links, _ = made(spark, "float")
    monkeypatch.setattr(embeddings, "_key", lambda v: F.size(v).cast("long"))
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame, tile=64).collect()} == links


def test_tiles_that_meet_are_read_where_they_are(spark):
    """A tile meets many others: neither it nor a pair is dealt anew, so disk grows with the vectors only."""
    frame, _, _ = made(spark, "float")
    _, classes = embeddings._classes(frame)
    axes = embeddings._axes(classes, 24)
    tiles = hand_over(embeddings._tiles(classes, axes, 16), "tiles")
    met = embeddings._links(tiles, axes, 0.95, "f4")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    pairs = embeddings._meetings(tiles, 10.0).select("tile", "other").collect()
    n = tiles.count()
    assert len(pairs) == len({frozenset(p) for p in pairs}) == n * (n + 1) // 2
