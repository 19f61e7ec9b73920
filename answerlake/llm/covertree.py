"""Product-quantisation codes of vectors by a cover-tree Lloyd.

Components become integers floor(4096 * x), vectors are cut into equal consecutive parts and each part has a
codebook that six rounds of Lloyd's rule refine, all in integers. Rows are dealt into blocks. A block holds one
cover tree per part over its distinct part vectors: a node is a ball around one of its own vectors, the centres of
its children are more than half its radius apart and no vector is farther than that from the nearest. The leaves
of a subtree are neighbours, so differences of cumulative sums give the count and the sum of any subtree.

A round walks the trees with the codebook. By the triangle inequality an entry farther from the centre than
the nearest entry plus twice the radius is nearest to no vector of the ball; a node with one entry left is assigned
whole, the others are entered, and single vectors are compared exactly. A tree is built once, written to the shared
folder and walked in every round; a round sends the sums of each task, whose number the codebook fixes, and the
driver sees only codebooks (parts x entries x width integers).

Handling: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose
length differs from that of the smallest kept id or is no multiple of the number of parts, and those with
a component too large for exact 64-bit distances (`reach`; 65536 and more at the given width). Ids that repeat are
rows of their own; equal ids, and null ids after all others, are ordered by vector. Distance ties go to the lower
entry. Fewer rows than entries give a smaller codebook, an empty table gives no rows, and columns beside
vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from answerlake.llm.common import look_up
from answerlake.session import hand_over

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block: bounds the memory of a task, not the result.
BLOCK = 4096
#: A node of at most so many vectors is not divided further.
LEAF = 8
#: Relative slack of bounds for rounding; the last decision is exact.
SLACK = 1e-9


def reach(width: int) -> int:
    """Components below this keep squared distances of parts inside 62 bits."""
    return int((2**60 / width) ** 0.5)


class Tree:
    """A cover tree over distinct integer vectors: leaves in tree order, nodes as ranges of leaves.

    A node covers leaves lo..hi; those before `single` hang on it directly, the others on its children
    (nodes first .. first + children). Its centre is the leaf `centre`.
    """

    FIELDS = ("leaves", "copies", "order", "lo", "single", "hi", "first", "children", "centre", "radius")

    def __init__(self, *fields: np.ndarray):
        for name, field in zip(self.FIELDS, fields):
            setattr(self, name, field)

    @classmethod
    def build(cls, points: np.ndarray, copies: np.ndarray, leaf: int = LEAF) -> Tree:
        x, order = points.astype(float), np.arange(len(points))
        nodes, todo = [[0, 0, len(points), 0, 0, 0, 0.0]], [0]
        while todo:
            node = nodes[todo.pop()]
            lo, _, hi, _, _, centre, _ = node
            inside = order[lo:hi]
            near = np.sqrt(((x[inside] - x[centre]) ** 2).sum(1))
            node[6] = float(near.max())
            node[1] = hi
            if hi - lo <= leaf:
                continue
            centres, owner = [centre], np.zeros(hi - lo, np.int64)
            while True:
                far = int(near.argmax())
                if near[far] <= node[6] / 2:
                    break
                away = np.sqrt(((x[inside] - x[inside[far]]) ** 2).sum(1))
                closer = away < near
                owner[closer] = len(centres)
                near = np.minimum(near, away)
                centres.append(inside[far])
            sizes = np.bincount(owner)
            order[lo:hi] = inside[np.lexsort((owner, sizes[owner] > 1))]
            at = node[1] = lo + int((sizes == 1).sum())
            node[3] = len(nodes)
            for child in np.flatnonzero(sizes > 1):
                todo.append(len(nodes))
                nodes.append([at, 0, at + int(sizes[child]), 0, 0, centres[child], 0.0])
                at += int(sizes[child])
            node[4] = len(nodes) - node[3]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lo, single, hi, first, children, centre = (np.array([n[k] for n in nodes], np.int32) for k in range(6))
        return cls(points[order], copies[order], order.astype(np.int32), lo, single, hi, first, children,
                   place[centre].astype(np.int32), np.array([n[6] for n in nodes]))

    def assign(self, entries: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Whole subtrees as (lo, hi, entry) arrays, and the leaves compared exactly with their entries."""
        whole, singles = [], [np.empty(0, np.int64)]
        at, left = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        while len(at):
            gap = np.sqrt(((self.leaves[self.centre[at]][:, None, :].astype(float) - entries[None]) ** 2).sum(2))
            gap[~left] = np.inf
            bound = gap.min(1) + 2 * self.radius[at]
            left = gap <= (bound * (1 + SLACK) + SLACK)[:, None]
            sole = left.sum(1) == 1
            whole.append((self.lo[at[sole]], self.hi[at[sole]], left[sole].argmax(1)))
            at, left = at[~sole], left[~sole]
            singles.append(_ranges(self.lo[at], self.single[at]))
            left = np.repeat(left, self.children[at], axis=0)
            at = _ranges(self.first[at], self.first[at] + self.children[at])
        single = np.concatenate(singles)
        nearest = np.empty(len(single), np.int64)
        for start in range(0, len(single), 8192):
            part = single[start : start + 8192]
            nearest[start : start + 8192] = _squares(self.leaves[part], entries).argmin(1)
        return whole, single, nearest

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and component sums of each entry."""
        weighted = self.leaves.astype(np.int64) * self.copies[:, None]
        upto = np.concatenate((np.zeros((1, weighted.shape[1]), np.int64), weighted.cumsum(0)))
        rows = np.concatenate((np.zeros(1, np.int64), self.copies.cumsum()))
        n, total = np.zeros(len(entries), np.int64), np.zeros((len(entries), weighted.shape[1]), np.int64)
        whole, single, nearest = self.assign(entries)
        for lo, hi, entry in whole:
            np.add.at(n, entry, rows[hi] - rows[lo])
            np.add.at(total, entry, upto[hi] - upto[lo])
        np.add.at(n, nearest, self.copies[single])
        np.add.at(total, nearest, weighted[single])
        return n, total

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each distinct vector, in the order given to `build`."""
        entry = np.empty(len(self.leaves), np.int64)
        whole, single, nearest = self.assign(entries)
        for lo, hi, of in whole:
            entry[_ranges(lo, hi)] = np.repeat(of, hi - lo)
        entry[single] = nearest
        square = ((self.leaves.astype(np.int64) - entries[entry]) ** 2).sum(1)
        out, error = np.empty_like(entry), np.empty_like(square)
        out[self.order], error[self.order] = entry, square
        return out, error


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1 and so on."""
    size = (hi - lo).astype(np.int64)
    return np.arange(size.sum()) + np.repeat(lo - (size.cumsum() - size), size)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((points[:, None, :].astype(np.int64) - entries[None]) ** 2).sum(2)


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _trees(blob: bytes, parts: int) -> tuple[list[Tree], np.ndarray]:
    """The trees of a block, and for each of its rows the distinct vector of each part."""
    with np.load(io.BytesIO(blob)) as saved:
        trees = [Tree(*(saved[f"{part}{name}"] for name in Tree.FIELDS)) for part in range(parts)]
        return trees, saved["rows"]


def _blocks(kept: DataFrame, parts: int, block: int) -> DataFrame:
    """One row per block: ids and labels of its rows, and its trees."""
    label = kept.schema["label"].dataType
    schema = StructType().add("vec_id", ArrayType(kept.schema["vec_id"].dataType)).add("label", ArrayType(label)).add("tree", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                rows = batch.slice(start, block)
                values = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                values = values.astype(np.int32 if np.abs(values).max() < 2**31 else np.int64)
                arrays, places = {}, []
                for part, v in enumerate(np.split(values, parts, axis=1)):
                    points, place, copies = np.unique(v, axis=0, return_inverse=True, return_counts=True)
                    places.append(place.reshape(-1).astype(np.int32))
                    tree = Tree.build(points, copies)
                    arrays |= {f"{part}{name}": getattr(tree, name) for name in Tree.FIELDS}
                arrays["rows"] = np.stack(places)
                columns = [pa.array([rows.column(k).to_pylist()], pa.list_(rows.schema.types[k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_packed(arrays)], pa.binary())], ["vec_id", "label", "tree"])

    return kept.select("vec_id", "label", "v").mapInArrow(run, schema)


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, place, n, total): rows and component sums of each entry, place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for blob in batch.column(0):
                for part, tree in enumerate(_trees(blob.as_py(), len(books))[0]):
                    rows, sums = tree.sums(books[part])
                    n[part] += rows
                    total[part] += sums
        part, entry, place = np.indices((len(books), *books[0].shape)).reshape(3, -1)
        counts = np.repeat(np.concatenate(n), books[0].shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (part, entry, place, counts, np.concatenate(total).reshape(-1))], ["part", "entry", "place", "n", "total"]
        )

    found = blocks.select("tree").mapInArrow(run, "part long, entry long, place long, n long, total long")
    return found.groupBy("part", "entry", "place").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")])


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    schema = StructType()
    for name in ("vec_id", "label"):
        schema.add(name, blocks.schema[name].dataType.elementType)
    schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                trees, rows = _trees(batch.column(2)[at].as_py(), len(books))
                codes, error = np.empty(rows.shape, np.uint8), 0
                for part, tree in enumerate(trees):
                    entry, square = tree.codes(books[part])
                    codes[part] = entry[rows[part]]
                    error = error + square[rows[part]]
                text = codes.T.tobytes().hex()
                step = 2 * len(books)
                code = [text[k : k + step] for k in range(0, len(text), step)]
                columns = [batch.column(k)[at].values for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.select("vec_id", "label", "tree").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) per kept vector, and the final codebook of each part."""
    x = F.col("embedding").cast("array<double>")
    finite = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c * SCALE))
    width = F.size("embedding") / parts
    small = ~F.exists(x, lambda c: F.abs(c * SCALE) >= F.floor(F.sqrt(F.lit(float(2**60)) / width)) - 1)
    kept = vectors.where(finite & (F.size("embedding") % parts == 0)).where(small).select("vec_id", "label", scaled.alias("v"))
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not seeds:
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.where("false"), []
    dim = len(seeds[0]["v"])
    kept = kept.where(F.size("v") == dim)
    first = np.array([r["v"] for r in seeds if len(r["v"]) == dim], np.int64)
    if len(first) < len(seeds):
        first = np.array([r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    books = np.split(first, parts, axis=1)
    blocks = hand_over(_blocks(kept, parts, block), "blocks")
    for _ in range(rounds):
        for r in _sums(blocks, books).where("n > 0").collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return _coded(blocks, books), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks."""
    coded, books = compress(vectors)
    coded = hand_over(coded, "codes")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    return look_up(coded, hand_over(totals, "totals"), "label", "rows").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    width = f"len(e) // {PARTS}"
    square = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "SELECT p.vec_id, p.part, min((CAST({0} AS BIGINT), c.entry)) AS best FROM p JOIN c{1} c USING (part) GROUP BY ALL"
    steps = []
    for k in range(ROUNDS):
        steps.append(
            f"""a{k} AS MATERIALIZED ({nearest.format(square, k)}),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN
  (SELECT part, entry, list(q ORDER BY place) AS v FROM (SELECT part, entry, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM
    (SELECT a.part, a.best[2] AS entry, u.place, sum(p.v[u.place]) AS s, count(*) AS n FROM a{k} a JOIN p USING (vec_id, part), (SELECT unnest(range(1, w + 1)) AS place FROM (SELECT max(len(v)) AS w FROM p)) u GROUP BY ALL)) GROUP BY ALL) n USING (part, entry))"""
        )
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * ({width}) + 1 : (part + 1) * ({width})] AS v FROM k, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p) WHERE entry < {ENTRIES}),
{", ".join(steps)},
f AS MATERIALIZED ({nearest.format(square, ROUNDS)}),
r AS (SELECT vec_id, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT r.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM r JOIN k USING (vec_id)
"""


SQL = _sql()
