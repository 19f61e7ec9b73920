"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Vectors are normalised and rotated to their principal axes, which leaves cosines as they are. Tiles hold
vectors that are near in the leading dimensions; two tiles meet only if their boxes come near enough.
Within a pair of tiles the products of the leading dimensions are accumulated a few at a time, and the rest
is bounded by the product of the suffix norms (Cauchy-Schwarz): a pair is left as soon as its bound
is below the threshold. What is left is decided by the full cosine in double precision.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of
different lengths are never compared. Equal vectors are one class: their links are counted, not compared.
Rows that repeat an id are vectors of their own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.llm.common import components
from answerlake.session import hand_over

TILE = 4096
#: Leading dimensions of a tile's box, and how many dimensions are accumulated before each look at the bounds.
BOX = 4
STEPS = (16, 24)
#: Slack of bounds and boxes for rounding; the last decision uses none.
SLACK = 1e-9
#: Slack of the first look, which is taken in single precision: its products are of at most 25 terms whose absolute values add
#: up to 1 at most, so they are off by less than 2e-6.
SINGLE = 1e-5
#: Pairs whose bounds are taken at a time.
PAIRS = 1 << 18
#: Files of tiles: so many tiles each, but no more files than this. Every file meets every file in a task of its own.
FILE, FILES = 4, 256


def _key(v: Column) -> Column:
    # 0.0 is added so that negative zeros are the same as others
    return F.xxhash64(F.transform(v, lambda x: x + F.lit(0).cast("float")))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, v) with null where the vector cannot link, and classes of equal vectors.

    Vectors of floats stay floats: half the bytes, and the same numbers.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(~bad & some, v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = classes.withColumn("node", F.monotonically_increasing_id()).withColumn("key", _key(F.col("v")))
    return rows, hand_over(classes, "classes", tidy=True, **{"parquet.enable.dictionary": "false"})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # a power of two first, so that neither very large nor very small components overflow
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stacked(flat: pa.Array) -> np.ndarray:
    return np.stack(flat.to_numpy(zero_copy_only=False))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns), largest first, from second moments added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_stacked(batch.column(0)))
                total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    moments = np.zeros((dim, dim))
    # dim * dim rows, whatever the number of vectors
    for r in classes.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        moments[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def _tiles(classes: DataFrame, axes: np.ndarray, tile: int) -> DataFrame:
    """Rows (tile, nodes, x, lo, hi): numbers and copies of a tile's vectors, the vectors as given, the box of their unit vectors."""
    dim, kind = len(axes), _kind(classes)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch.column(0))
                lead = _unit(x) @ axes[:, :2]
                rows = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], rows, pa.array(lead[:, 0]), pa.array(lead[:, -1])],
                    ["node", "copies", "x", "lead", "next"],
                )

    rotated = classes.select("v", "node", "copies").mapInArrow(
        rotate, "node long, copies long, x binary, lead double, next double"
    )
    # slabs by the first axis; in each, tiles follow the second
    count = classes.count()
    slabs = max(1, round((count / tile) ** 0.5))
    cuts = rotated.approxQuantile("lead", [i / slabs for i in range(1, slabs)], 0.01) if slabs > 1 else []
    slab = sum(((F.col("lead") >= cut).cast("int") for cut in cuts), F.lit(0))
    files = min(FILES, max(1, -(-count // (FILE * tile))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: pa.Table) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), kind).reshape(-1, dim)
            lead = _unit(x) @ axes[:, :BOX]
            nodes = np.stack((part.column("node").to_numpy(), part.column("copies").to_numpy()), axis=1)
            box = [pa.array([lead.min(axis=0).tolist()]), pa.array([lead.max(axis=0).tolist()])]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(nodes[0, 0])]), pa.array([nodes.tobytes()]), pa.array([x.tobytes()]), *box],
                ["tile", "nodes", "x", "lo", "hi"],
            )

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for number in np.unique(rows.column("slab").to_numpy()).tolist():
                part = rows.filter(pc.equal(rows.column("slab"), number))
                if rest is not None and rest.column("slab")[0].as_py() != number:
                    yield emit(rest)
                    rest = None
                rest = part if rest is None else pa.concat_tables([rest, part])
                while rest is not None and rest.num_rows >= tile:
                    yield emit(rest.slice(0, tile))
                    rest = rest.slice(tile) if rest.num_rows > tile else None
        if rest is not None:
            yield emit(rest)

    return (
        rotated.withColumn("slab", slab.cast("int"))
        .repartitionByRange(files, "slab", "next").sortWithinPartitions("slab", "next", "node")
        .select("slab", "node", "copies", "x")
        .mapInArrow(build, "tile long, nodes binary, x binary, lo array<double>, hi array<double>")
    )


def _kind(classes: DataFrame) -> str:
    return "f4" if classes.schema["v"].dataType.simpleString() == "array<float>" else "f8"


def _meetings(tiles: DataFrame, radius: float) -> DataFrame:
    """Pairs of tiles whose boxes are within the radius, each pair once: (tile, nodes, x, other, nodes2, x2).

    Written tiles are read where they are, file against file, and nothing of them is shuffled: a tile meets many others, so a
    join by key would write it once for each.
    """
    one = tiles.hint("shuffle_replicate_nl")
    two = tiles.select(*[F.col(c).alias(to) for c, to in (("tile", "other"), ("nodes", "nodes2"), ("x", "x2"), ("lo", "lo2"), ("hi", "hi2"))])
    gap = F.lit(0.0)
    for d in range(BOX):
        # shorter vectors have fewer dimensions in their boxes
        lo, hi, lo2, hi2 = (F.get(c, F.lit(d)) for c in ("lo", "hi", "lo2", "hi2"))
        apart = F.greatest(lo2 - hi, lo - hi2, F.lit(0.0))
        gap = gap + F.coalesce(apart * apart, F.lit(0.0))
    # of a pair, which tile comes first is dealt by parity, so that the tasks of both orders have work
    even = (F.col("tile") + F.col("other")) % 2 == 0
    once = (F.col("tile") == F.col("other")) | (even == (F.col("tile") < F.col("other")))
    met = one.join(two, once & (gap <= radius * radius + SLACK))
    return met.select("tile", "nodes", "x", "other", "nodes2", "x2")


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple]:
    """Index arrays (i, j) of the pairs of unit vectors with a cosine of at least the threshold, in blocks."""
    px, py, dim = x @ axes, y @ axes, x.shape[1]
    steps = [k for k in STEPS if k < dim] + [dim]
    suffix = {k: [np.sqrt((p[:, k:] ** 2).sum(axis=1)) for p in (px, py)] for k in steps}
    # the bound of every pair as one product: the leading dimensions and, as one more, the suffix norms
    first = steps[0]
    a = np.concatenate((px[:, :first], suffix[first][0][:, None]), axis=1).astype(np.float32)
    b = np.concatenate((py[:, :first], suffix[first][1][:, None]), axis=1).astype(np.float32).T
    rows = max(1, PAIRS // len(y))
    for start in range(0, len(x), rows):
        columns = start if same else 0
        flat = np.flatnonzero(a[start : start + rows] @ b[:, columns:] >= np.float32(threshold - SINGLE))
        i, j = flat // (len(y) - columns) + start, flat % (len(y) - columns) + columns
        if same:
            i, j = i[i < j], j[i < j]
        dots, done = np.zeros(len(i)), 0
        for k in steps:
            dots = dots + np.einsum("ij,ij->i", px[i, done:k], py[j, done:k])
            keep = dots + suffix[k][0][i] * suffix[k][1][j] >= threshold - SLACK
            i, j, dots, done = i[keep], j[keep], dots[keep], k
        keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        if keep.any():
            yield i[keep], j[keep]


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of what was joined so far, after joining i and j as well."""
    i, j = root[i], root[j]
    while True:
        new = root.copy()
        low = np.minimum(new[i], new[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root, new)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _links(tiles: DataFrame, axes: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """Rows (a, b, n): for each vector with links in a pair of tiles, a vector it is joined to there and the
    number of vectors linked to it. At most one row per vector and pair of tiles, however many links."""
    dim = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tile, nodes1, x, other, nodes2, y = (c[at].as_py() for c in batch.columns)
                same = tile == other
                nodes1, nodes2 = (np.frombuffer(p, np.int64).reshape(-1, 2) for p in (nodes1, nodes2))
                x, y = (_unit(np.frombuffer(p, kind).reshape(-1, dim)) for p in (x, y))
                nodes = nodes1 if same else np.concatenate((nodes1, nodes2))
                n, root = np.zeros(len(nodes)), np.arange(len(nodes))
                for i, j in linked(x, y, axes, threshold, same):
                    j = j if same else j + len(x)
                    n += np.bincount(i, nodes[j, 1], len(nodes)) + np.bincount(j, nodes[i, 1], len(nodes))
                    root = _forest(root, i, j)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some, 0]), pa.array(nodes[root[some], 0]), pa.array(n[some].astype(np.int64))], ["a", "b", "n"]
                )

    pairs = _meetings(tiles, max(1e-6, float(np.sqrt(max(0.0, 2 * (1 - threshold))))))
    return pairs.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least the threshold), component_id, kept."""
    rows, classes = _classes(vectors)
    links = None
    # one pass per length of vectors that occurs
    for (dim,) in classes.select(F.size("v")).distinct().collect():
        part = classes.where(F.size("v") == dim)
        axes = _axes(part, dim)
        tiles = hand_over(_tiles(part, axes, tile), "tiles", tidy=True)
        more = hand_over(_links(tiles, axes, threshold, _kind(classes)), "links", tidy=True)
        links = more if links is None else links.union(more)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # rows find their class by a hash of 64 bits if no two classes share one, else by the vector itself
    by = "key" if classes.select("key").distinct().count() == classes.count() else "v"
    found = (
        classes.join(degrees, "node", "left").join(components(links.select("a", "b")), "node", "left")
        .select(
            by, "first_id", F.coalesce("root", "node").alias("root"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        )
    )
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = found.join(smallest, "root").select(by, "n_links", "component_id")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    if by == "key":
        rows = rows.select("vec_id", F.when(F.col("v").isNotNull(), _key(F.col("v"))).alias("key"))
    return rows.join(found, by, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m AS component_id, e.vec_id = m AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = e.vec_id
"""
