"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, exact Hamming check.

Null and empty texts (or texts of white space only) have the fingerprint zero and are linked like any
other. A text of fewer words than a shingle is one shingle. Repeated rows and equal texts share a
fingerprint and so a component. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.common import LOWER_BYTES, components, giving_back
from answerlake.session import hand_over

SEED = 42
#: Shingles hashed at a time, so that a very long text needs no array of its own length.
PIECE = 1 << 18
#: Fingerprints of one block key compared by one task; larger blocks are cut into cells of this size.
CELL = 1024
#: Bits of the fingerprints that the exact check of similar texts starts from, and the steps that draw them out of a hash.
WIDE = 256
_STEPS = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x1E3779B97F4A7C15)
#: Share of the pairs at the threshold that may have no band in common.
MISS = 1e-3
#: Keys of texts a task remembers, to send the shingles of equal texts once.
REMEMBER = 1 << 18
#: Pairs a member from which a block is dense.
DENSE = 1
#: Pairs whose bands a task compares at a time.
PAIRS = 1 << 14
#: Bits of the marks that rule out pairs of large groups; large sets need more for a sharp answer, none is lost.
MARKS = 2048
#: Columns of the words of a wide fingerprint.
HALVES = [f"f{i}" for i in range(WIDE // 64)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 values."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), "doc_id long, fp long")


def block_masks(distance: int, bits: int = 64) -> list[int]:
    """Masks of which a pair within `distance` bits agrees on at least one: all choices of `distance`
    out of twice as many blocks, so a key keeps about half of the bits and seldom meets by chance."""
    blocks = 2 * distance
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Within runs of equal keys, links between each fingerprint and the root of those it reaches."""
    n = len(keys)
    root, alive, step = np.arange(n), np.arange(n), 1
    a_all, b_all = [], []
    while True:
        alive = alive[alive + step < n]
        alive = alive[keys[alive + step] == keys[alive]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(fps[alive] ^ fps[alive + step]) <= distance]
        # links whose ends already share a root add nothing
        near = near[root[near] != root[near + step]]
        if len(near):
            a_all.append(near)
            b_all.append(near + step)
            low = np.minimum(root[near], root[near + step])
            np.minimum.at(root, near, low)
            np.minimum.at(root, near + step, low)
        step += 1
    if not a_all:
        return fps[:0], fps[:0]
    return fps[np.concatenate(a_all)], fps[np.concatenate(b_all)]


def fingerprint_links(fps: DataFrame, distance: int = 3, cell: int = CELL) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within `distance` bits of each other.

    fps has distinct values. Only links that add to what a block has joined so far come out, so a block
    of m close fingerprints gives far fewer than m * m rows. A block of more than `cell` members is dealt
    into cells, and every two cells meet in one group of at most about two cells.
    """
    masks = block_masks(distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("block", "key"),
    )
    large = (
        keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
        .select("block", "key", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    )
    dealt = (
        keyed.join(large, ["block", "key"], "left")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("cells", F.lit(1))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
        .select("fp", F.xxhash64("block", "key", F.least("own", "other"), F.greatest("own", "other")).alias("meet"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rest = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(k, f):
            a, b = _linked(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            rest = np.concatenate((rest, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield links(keys[:cut], rest[:cut])
                keys, rest = keys[cut:], rest[cut:]
        if len(keys):
            yield links(keys, rest)

    return (
        dealt.select("meet", "fp").repartition("meet").sortWithinPartitions("meet", "fp")
        .mapInArrow(giving_back(run), "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable)."""
    rows = hand_over(fingerprints(docs, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(fingerprint_links(classes.select("fp"), distance))
    classes = (
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles, hashed a piece at a time; none for a text without words."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n, width = b" ".join(words), max(1, len(words) - shingle + 1), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, parts = xxhash.xxh64_intdigest, []
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        places = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        parts.append(np.unique(np.array([digest(joined[s:e], SEED) for s, e in places], np.uint64)))
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE bits (four words) by the majority of the set's hashes, each drawn out by a mixer."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(shingles), PIECE // 4):
        part = shingles[at : at + PIECE // 4, None] + _STEPS
        with np.errstate(over="ignore"):
            part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            part ^= part >> np.uint64(31)
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")


def bands_for(n: int, similarity: float) -> np.ndarray:
    """Bits of each band. A band has about log2(n) - 6 bits, so that a block stays small at every n, and there are
    as many bands as leave at most MISS of the pairs at the threshold without a common block."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    width = min(40, max(12, int(np.ceil(np.log2(max(2, n)))) - 6))
    number = int(np.ceil(np.log(MISS) / np.log1p(-((1 - differ) ** width))))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(WIDE, width, replace=False) for _ in range(number)])


def _close_pairs(part: dict[str, np.ndarray], keys: np.ndarray, similarity: float, limit: int | None):
    """Positions (a, b) and differing bits of the pairs in runs of equal blocks that may be similar and have different
    roots, and a mask of the rows of dense blocks: those with more than `limit` pairs a member send the nearest
    partner of every member only. A pair belongs to the first band its texts share (keys: the bands of every row),
    and texts of one cell to the cell's own block, so no pair comes twice."""
    block, fps, size, root, place = (part[c] for c in ("block", "prints", "size", "root", "place"))
    n, far = len(block), _reach(similarity)
    start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    members, found = np.bincount(of), np.zeros(len(start), np.int64)
    band, side = place >> 2, place & 3

    def near(left, step):
        right = left + step
        fits = np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right])
        left = left[fits & (root[left] != root[right]) & ((side[left] == 0) | (side[left] != side[right]))]
        bits = np.bitwise_count(fps[left] ^ fps[left + step]).sum(axis=1).astype(np.int64)
        left, bits = left[bits <= far], bits[bits <= far]
        first = [np.argmax(keys[p] == keys[p + step], axis=1) for p in np.split(left, range(PAIRS, len(left), PAIRS))]
        own = np.concatenate(first) == band[left]
        if "marks" in part:
            own[own] = _may_be_similar(part["marks"], size, left[own], left[own] + step, similarity)
        return left[own], bits[own]

    def steps(alive, stopped):
        step = 1
        while True:
            alive = alive[alive + step < n]
            alive = alive[(block[alive + step] == block[alive]) & ~stopped[of[alive]]]
            if not len(alive):
                return
            yield step, *near(alive, step)
            step += 1

    dense, none = np.zeros(len(start), bool), np.zeros(0, np.int64)
    pairs = [(none, none, none)]
    for step, left, bits in steps(np.arange(n), dense):
        pairs.append((left, left + step, bits))
        if limit is not None:
            found += np.bincount(of[left], minlength=len(start))
            dense |= found > limit * members
    a, b, differ = (np.concatenate(p) for p in zip(*pairs))
    if dense.any():
        keep = ~dense[of[a]]
        best = np.full(n, np.iinfo(np.int64).max)
        for step, left, bits in steps(np.flatnonzero(dense[of]), np.zeros(len(start), bool)):
            np.minimum.at(best, left, bits << 32 | (left + step))
            np.minimum.at(best, left + step, bits << 32 | left)
        left = np.flatnonzero(best < np.iinfo(np.int64).max)
        right, bits = best[left] & 0xFFFFFFFF, best[left] >> 32
        # two that are nearest to each other are one pair
        once = (left < right) | (best[right] & 0xFFFFFFFF != left)
        left, right, bits = left[once], right[once], bits[once]
        a, b, differ = (np.concatenate((x[keep], y)) for x, y in ((a, left), (b, right), (differ, bits)))
    return a, b, differ, dense[of]


def _reach(similarity: float) -> int:
    """Bits of a wide fingerprint that similar sets may differ in: the mean and four deviations."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * differ + 4 * np.sqrt(WIDE * differ * (1 - differ)))


def set_marks(shingles: np.ndarray) -> np.ndarray:
    """MARKS bits of which a shingle sets one."""
    out = np.zeros(MARKS, bool)
    out[(shingles >> np.uint64(40)) % np.uint64(MARKS)] = True
    return np.packbits(out, bitorder="little")


def _may_be_similar(marks: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """False only where the sets cannot be similar: a mark of one that the other lacks stands for a shingle it lacks."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), PAIRS):
        x, y = marks[a[at : at + PAIRS]], marks[b[at : at + PAIRS]]
        left, right = (size[i[at : at + PAIRS]].astype(np.int64) for i in (a, b))
        both = np.minimum(left - np.bitwise_count(x & ~y).sum(axis=1), right - np.bitwise_count(y & ~x).sum(axis=1))
        total = left + right - both
        out[at : at + PAIRS] = (total == 0) | (both / np.maximum(total, 1) >= similarity)
    return out


def _band_keys(prints: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The bits of every band (a column each) of fingerprints of WIDE bits."""
    powers = np.int64(1) << np.arange(bands.shape[1], dtype=np.int64)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    return np.stack([bits[:, b].astype(np.int64) @ powers for b in bands], axis=1)


def _candidates(rows: DataFrame, bands: np.ndarray, similarity: float, limit: int | None) -> DataFrame:
    """Pairs (a, b) of rows (block, id, the words of a wide fingerprint, size, root, place) and the bits they differ in;
    with `limit`, also (block, member) of dense blocks, with the member's place instead of the bits. place is the
    band's number times 4, plus 0 in a cell's own block, else 1 or 2 for the lower or the upper of two cells. Rows with
    `marks` give no pair that the marks rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> pa.RecordBatch:
            part = {c: table.column(c).to_numpy() for c in ("block", "size", "root", "place")}
            part["prints"] = np.stack([table.column(f).to_numpy() for f in HALVES], axis=1).view(np.uint64)
            if "marks" in table.column_names:
                part["marks"] = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint64).reshape(-1, MARKS // 64)
            at = table.column("id").to_numpy()
            keys = _band_keys(part["prints"], bands)
            a, b, differ, dense = _close_pairs(part, keys, similarity, limit)
            inside = int(dense.sum())
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [
                pa.concat_arrays([pa.array(np.minimum(at[a], at[b])), pa.array(at[dense])]),
                pa.concat_arrays([pa.array(np.maximum(at[a], at[b])), none(inside)]),
                pa.concat_arrays([none(len(a)), pa.array(part["block"][dense])]),
                pa.array(np.concatenate((differ, part["place"][dense])).astype(np.int32)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "block", "differ"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[-1]
            if batch.column(0)[0] == last and len(held) > 1:
                continue
            part = pa.Table.from_batches(held)
            cut = int(np.searchsorted(part.column(0).to_numpy(), last.as_py()))
            if cut:
                yield found(part.slice(0, cut))
                held = part.slice(cut).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    columns = [c for c in ("block", "id", *HALVES, "size", "root", "place", "marks") if c in rows.columns]
    return rows.select(*columns).repartition("block").sortWithinPartitions("block", "id").mapInArrow(
        giving_back(run), "a long, b long, block long, differ int"
    )


def _unseen(keys: list[int], seen: set[int]) -> list[bool]:
    """Which keys come for the first time; `seen` is emptied when it has REMEMBER keys, so some may come again."""
    if len(seen) > REMEMBER:
        seen.clear()
    new = []
    for k in keys:
        new.append(k not in seen)
        seen.add(k)
    return new


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """One row (key, shingles) for every wanted key. Of the equal texts of a task one is shuffled, so a large group
    of copies is a row a task."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            yield batch.filter(pa.array(_unseen(batch.column(0).to_pylist(), seen), pa.bool_()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(t.as_py(), shingle).astype("<u8").tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["key", "shingles"])

    some = texts.mapInArrow(giving_back(once), "key long, text string").join(wanted, "key", "left_semi")
    return some.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(giving_back(hashed), "key long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough; sets has one row (key, shingles) for every key of a pair."""
    both = (
        pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("right")), "b").select("a", "b", "left", "right")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                similarity_of(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= similarity
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(giving_back(run), "a long, b long")


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, cell: int = CELL) -> DataFrame:
    """doc_id, key (of the text) and root (of its component) of every row: texts whose sets of `shingle` words have a
    Jaccard similarity of at least `similarity` are linked.

    Candidates share a band of wide fingerprints and are close in all their bits. The shingles of texts in a pair
    are written once, and pairs are checked on them. A dense block first sends the nearest partner of every member only,
    so the pairs grow with the texts. Then it sends its other pairs whose ends are still in different components and
    whose marks do not rule them out, so a large group of near copies needs few checks and no pair is left out.
    """
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    kinds = ", ".join(f"{f} long" for f in HALVES)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task sends size and fingerprint of equal texts once, with the first; they are null elsewhere."""
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                new = _unseen(part.column(1).to_pylist(), seen)
                sets = [shingle_set(t.as_py(), shingle) if n else np.empty(0, np.uint64) for n, t in zip(new, part.column(2))]
                prints = np.array([wide_fingerprint(x) for x in sets], "<u8").view("<i8")
                known = pa.array([not n for n in new])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int32(), mask=np.array(known)),
                     *[pa.array(p, mask=np.array(known)) for p in prints.T.copy()]],
                    ["doc_id", "key", "size", *HALVES],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, "text")
    rows = hand_over(rows.mapInArrow(giving_back(marks), f"doc_id long, key long, size int, {kinds}"), "fingerprints")
    classes = hand_over(rows.where("size is not null").groupBy("key").agg(*[F.max(c).alias(c) for c in ("size", *HALVES)]), "classes")
    bands = bands_for(classes.count(), similarity)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = np.stack([c.to_numpy() for c in part.columns[2:]], axis=1)
                keys = _band_keys(prints, bands) | np.arange(n, dtype=np.int64) << 44
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), n)),
                     *[pa.array(np.repeat(p, n)) for p in prints.T], pa.array(np.repeat(part.column(1).to_numpy(), n))],
                    ["band", "id", *HALVES, "size"],
                )

    keyed = classes.select("key", "size", *HALVES).mapInArrow(giving_back(banded), f"band long, id long, {kinds}, size int")
    large = keyed.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = hand_over(large.select("band", F.ceil(F.col("n") / cell).cast("int").alias("cells")), "large")
    dealt = (
        keyed.join(large, "band", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("id"), "cells").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .withColumn("block", F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
        .withColumn("place", (F.shiftright("band", 44) * 4 + F.col("side")).cast("int"))
        .withColumn("root", F.col("id"))
    )
    found = hand_over(_candidates(dealt, bands, similarity, DENSE), "candidates")
    pairs = found.where("b is not null").select("a", "b")
    members = found.where("b is null").select("block", F.col("a").alias("id"), F.col("differ").alias("place"))
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(members.select("id")).distinct()
    sets = hand_over(_sets(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), wanted, shingle), "sets")
    links = hand_over(_verified(pairs, sets, similarity), "links")
    roots = hand_over(components(links), "roots")
    if members.head(1):

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = [set_marks(np.frombuffer(x.as_buffer(), "<u8")).tobytes() for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], ["id", "marks"])

        inside = sets.join(members.select(F.col("id").alias("key")), "key", "left_semi")
        marks = inside.mapInArrow(giving_back(marked), "id long, marks binary")
        left = (
            members.join(classes.withColumnRenamed("key", "id").join(marks, "id"), "id")
            .join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select("block", "id", *HALVES, "size", F.coalesce("root", "id").alias("root"), "place", "marks")
        )
        rest = hand_over(_candidates(left, bands, similarity, None).select("a", "b"), "rest")
        if rest.head(1):
            more = hand_over(_verified(rest, sets, similarity), "links")
            roots = hand_over(components(links.union(more)), "roots") if more.head(1) else roots
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar texts: the smallest doc_id, then the smallest key of the text;
    null ids come last and of rows that repeat id and text one stays. The columns stay as they are."""
    found = hand_over(similar_texts(docs.select("doc_id", "text"), shingle, similarity), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("order")
    counts = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")).select("root", order, "n")
    first = counts.groupBy("root").agg(F.min("order").alias("first"))
    tail = "_" * (1 + max(len(c) for c in docs.columns))  # names that no column of docs has
    of_id, of_key, mark_id, mark_key = (f"{c}{tail}" for c in ("of", "text", "id", "key"))
    marks = counts.join(first, "root").select(
        F.col("order.doc_id").alias(mark_id), F.col("order.key").alias(mark_key),
        F.col("order").eqNullSafe(F.col("first")).alias(f"stays{tail}"), F.col("n").alias(f"n{tail}"),
    )
    marks = hand_over(marks.where(f"not stays{tail} or n{tail} > 1"), "marks")
    rows = docs.withColumn(of_id, F.col("doc_id").cast("long")).withColumn(of_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col(of_id).eqNullSafe(F.col(mark_id)) & (F.col(of_key) == F.col(mark_key))
    kept = rows.join(marks, same, "left_anti")
    again = marks.where(f"stays{tail}")
    if again.head(1):
        kept = kept.union(rows.join(again, same, "left_semi").dropDuplicates([of_id, of_key]))
    return kept.select(*docs.columns)


def hex_of(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
