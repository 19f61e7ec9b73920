"""The prefix trie of conversations, and sums over its subtrees by an Euler tour.

A conversation is a sequence of turns (role, text). A turn is known by 128 hash bits of its content and place, and
a prefix by the running sums of them, so that equal prefixes are found by one aggregation, however long or
however often repeated. Nodes are named (smallest member, depth).

Every node has an enter and an exit arc. The successor of an arc follows from the first child, the next sibling and the
parent, which makes one list of the whole tour. The list is ranked by contraction: chains that lie inside
a block of neighbouring names become one item each, round after round with coarser blocks; where blocks do not
shorten the list, every item whose coin is tails and whose predecessor's is heads is taken up by the predecessor.
A block holds at most `CHUNK` items by its construction or by a count beforehand, and the last block ranks what is left.
Going back through the rounds gives the place of every arc, and sums over a subtree are differences of prefix
sums at its exit and enter arcs, taken in chunks of places.

No step gathers a conversation, the children of a node or the members of a node: positions come from ranges
of turns, hot keys of joins are broadcast (`look_up`), siblings are linked by ranges of their names. A digest
of members is by its nature read in order; pieces of the list are put together in parallel and one
stream per node hashes the pieces.

Handling: turns are ordered by turn (null first), then role, then text, so ties and repeated rows have a fixed order
and repeats stay. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left
out. An empty table gives no rows. Texts are read whole, however long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm.common import look_up
from answerlake.operators.ranking import ORDER_BUCKETS, cut_points, neighbours, range_of
from answerlake.session import hand_over

#: Items a task takes at once: arcs of a block, turns of a run, places of a prefix sum.
CHUNK = 8192
#: Sides of a first block: names c // SIDE, depths d // SIDE, two arcs each.
SIDE = 64
#: Bytes of a piece of a member list.
PIECE = 1 << 16
LANES = ("s1", "s2", "s3", "s4")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, size): the places of a conversation's turns from 1, hashes and bytes of their content."""
    rows = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    spread = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    cuts = cut_points(rows.select("turn"), spread, ORDER_BUCKETS)
    run = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("run", range_of(spread, cuts)).select(
        "conv_id", "run", F.row_number().over(run).cast("long").alias("place"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64("text", F.lit(7), "role").alias("h2"), F.octet_length("text").cast("long").alias("size"),
    )
    placed = hand_over(placed, "placed")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv_id", "run").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
    # most conversations have one run and need no offset
    later = sizes.where("before IS NOT NULL").select("conv_id", "run", "before")
    return placed.join(later, ["conv_id", "run"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "size"
    )


def rebuilt(own: DataFrame, family: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, total, h1, h2, size) of the rebuilt conversations, and (conv_id, total) of all.

    The first h turns come from the conversation c - c % family, the rest are the own turns after the first h,
    h = crc32(c) % modulus.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    base = F.col("conv_id") - F.col("conv_id") % family
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    facts = lengths.withColumn("base", base).withColumn("h", h).join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_n", F.lit(0)))
    )
    facts = facts.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    facts = hand_over(facts.select("conv_id", "n", "base", "h", "taken", "total"), "lengths")
    heads = own.where(F.col("pos") < modulus).withColumnRenamed("conv_id", "base")
    first = heads.join(facts, "base").where("pos <= h").select("conv_id", F.col("pos").alias("d"), "total", "h1", "h2", "size")
    rest = look_up(own.where(F.col("pos") > h), facts.select("conv_id", "n", "taken", "total"), "conv_id", "n")
    rest = rest.select("conv_id", (F.col("pos") - h + F.col("taken")).alias("d"), "total", "h1", "h2", "size")
    return first.unionByName(rest), facts.select("conv_id", "total")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.struct(depth.cast("long").alias("d"), F.xxhash64(depth, *sums).alias("p"), F.xxhash64(F.lit(3), *sums[::-1], depth).alias("q"))


def members(rows: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, d, k, up, size, last): the prefix k of each length, and the one before it."""
    x, y = F.xxhash64("d", "h1", "h2"), F.xxhash64("h2", F.lit(5), "h1", "d")
    lanes = [F.shiftrightunsigned(x, 32), x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(y, 32), y.bitwiseAND(0xFFFFFFFF)]
    rows = rows.withColumn("run", F.floor(F.col("d") / chunk)).withColumns({f"x{lane}": v for lane, v in zip(LANES, lanes)})
    upto = Window.partitionBy("conv_id", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = hand_over(rows.withColumns({lane: F.sum(f"x{lane}").over(upto) for lane in LANES}), "runs")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "run").agg(*[F.sum(f"x{lane}").alias(lane) for lane in LANES])
    runs = runs.select("conv_id", "run", *[F.sum(lane).over(before).alias(f"b{lane}") for lane in LANES]).where("run > 0")
    rows = rows.join(runs, ["conv_id", "run"], "left")
    upto = [F.col(lane) + F.coalesce(f"b{lane}", F.lit(0)) for lane in LANES]
    back = [u - F.col(f"x{lane}") for u, lane in zip(upto, LANES)]
    return rows.select(
        "conv_id", "d", _name(F.col("d"), upto).alias("k"), _name(F.col("d") - 1, back).alias("up"), "size", (F.col("d") == F.col("total")).alias("last")
    )


def nodes_of(prefixes: DataFrame, totals: DataFrame) -> DataFrame:
    """(c, d, k, size, n_convs, n_children, first, parent): the nodes; first is the name of the first child."""
    found = prefixes.groupBy("k").agg(
        F.min("conv_id").alias("c"), F.count("*").alias("n_convs"), F.min("up").alias("up"), F.min("size").alias("size")
    )
    zero = F.lit(0).cast("long")
    root = totals.agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        _name(zero, [zero] * 4).alias("k"), "c", "n_convs", F.lit(None).cast(found.schema["up"].dataType).alias("up"), zero.alias("size")
    )
    found = hand_over(found.unionByName(root), "prefixes")
    kids = found.where("up IS NOT NULL").groupBy(F.col("up").alias("k")).agg(F.count("*").alias("n_children"), F.min("c").alias("first"))
    found = hand_over(found.join(kids, "k", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    parents = found.where("n_children > 0").select(F.col("k").alias("up"), F.col("n_children").alias("n"), F.col("c").alias("parent"))
    return hand_over(look_up(found, parents, "up", "n").withColumn("d", F.col("k.d")).drop("up"), "nodes")


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs (c, d, e) with their successors (nc, nd, ne): e is 0 for entering and 1 for leaving a node."""
    below = nodes.where("parent IS NOT NULL")
    linked = neighbours(below.select("c", "d", "parent"), "c", [F.col("c")], F.col("c"), ["parent", "d"])
    root = nodes.where("parent IS NULL").select("c", "d", "parent", F.lit(None).cast("long").alias("next_id"))
    leave = linked.select("c", "d", "parent", "next_id").unionByName(root)
    more = F.col("next_id").isNotNull()
    leave = leave.select(
        "c", "d", F.lit(1).alias("e"), F.when(more, F.col("next_id")).otherwise(F.col("parent")).alias("nc"),
        F.when(more, F.col("d")).otherwise(F.when(F.col("parent").isNotNull(), F.col("d") - 1)).alias("nd"),
        F.when(more, F.lit(0)).otherwise(F.when(F.col("parent").isNotNull(), F.lit(1))).alias("ne"),
    )
    leaf = F.col("n_children") == 0
    enter = nodes.select(
        "c", "d", F.lit(0).alias("e"), F.when(leaf, F.col("c")).otherwise(F.col("first")).alias("nc"),
        F.when(leaf, F.col("d")).otherwise(F.col("d") + 1).alias("nd"), F.when(leaf, F.lit(1)).otherwise(F.lit(0)).alias("ne"),
    )
    return hand_over(enter.unionByName(leave).withColumn("len", F.lit(1).cast("long")), "arcs")


KEY, NEXT, HEAD = ["c", "d", "e"], ["nc", "nd", "ne"], ["hc", "hd", "he"]
_LINK = "c long, d long, e int, hc long, hd long, he int, off long, head boolean, nc long, nd long, ne int, len long"


def chains(group: pa.Table) -> pa.Table:
    """Each item of a block with the head of its chain and the arcs between; heads with what follows the chain."""
    n = group.num_rows
    column = {c: group.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in (*KEY, *NEXT, "len")}
    keys = np.stack([column[c] for c in KEY], axis=1)
    follow = np.stack([column[c] for c in NEXT], axis=1)
    inverse = np.unique(np.concatenate((keys, follow)), axis=0, return_inverse=True)[1].reshape(-1)
    place = np.full(2 * n, -1)
    place[inverse[:n]] = np.arange(n)
    after = np.where(group.column("nc").is_null().to_numpy(zero_copy_only=False), -1, place[inverse[n:]])
    inside = np.flatnonzero(after >= 0)
    head, off = np.arange(n), np.zeros(n, np.int64)
    head[after[inside]] = inside
    off[after[inside]] = column["len"][inside]
    while True:
        further = head[head]
        if (further == head).all():
            break
        off, head = off + off[head], further
    tail = np.flatnonzero(after < 0)
    last = np.full(n, -1)
    last[head[tail]] = tail
    first = last >= 0
    arrays = [*(group.column(c).combine_chunks() for c in KEY), *(group.column(c).combine_chunks().take(pa.array(head)) for c in KEY), pa.array(off), pa.array(first)]
    arrays += [group.column(c).combine_chunks().take(pa.array(np.where(first, last, 0), mask=~first)) for c in NEXT]
    arrays.append(pa.array(np.where(first, off[last] + column["len"][last], 0), mask=~first))
    return pa.Table.from_arrays(arrays, names=[*KEY, *HEAD, "off", "head", *NEXT, "len"])


def ranked(arcs: DataFrame, chunk: int = CHUNK, side: int = SIDE) -> DataFrame:
    """(c, d, e, pos): the place of every arc in the tour, from 0."""
    links, items, n, block, last, turn = [], arcs, arcs.count(), side, None, 0
    while n > 1:
        whole = n <= chunk
        by = [F.floor(F.col(c) / block) if not whole else F.lit(0) for c in ("c", "d")]
        # blocks of the first round cannot be larger; later ones are counted
        fits = whole or (2 * block * block <= chunk)
        if not fits and last is not None and n <= last / 2:
            fits = (items.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= chunk
        if fits:
            found = items.withColumns({"g": by[0], "h": by[1]}).groupBy("g", "h").applyInArrow(chains, _LINK)
            found = hand_over(found, "chains")
            links.append(found.where("NOT head").select(*KEY, *HEAD, "off"))
            items, block = found.where("head").select(*KEY, *NEXT, "len"), block * 8
            last, n = n, items.count()
            continue
        coin = F.xxhash64(*KEY, F.lit(turn)) % 2 == 0
        heads = items.where(coin).select(*[F.col(c).alias(h) for c, h in zip(KEY, HEAD)], *[F.col(x).alias(c) for c, x in zip(KEY, NEXT)], F.col("len").alias("off"))
        taken = hand_over(heads.join(items.where(~coin), KEY).select(*KEY, *HEAD, "off", *NEXT, "len"), "taken")
        links.append(taken.select(*KEY, *HEAD, "off"))
        grown = taken.select(*[F.col(h).alias(c) for c, h in zip(KEY, HEAD)], *[F.col(c).alias(f"t{c}") for c in NEXT], (F.col("off") + F.col("len")).alias("tlen"))
        rest = items.join(taken.select(*KEY), KEY, "left_anti").join(grown, KEY, "left")
        some = F.col("tlen").isNotNull()
        items = hand_over(rest.select(*KEY, *[F.when(some, F.col(f"t{c}")).otherwise(F.col(c)).alias(c) for c in NEXT], F.coalesce("tlen", "len").alias("len")), "items")
        turn, last, n = turn + 1, n if turn % 3 else 2 * n, items.count()
    found = items.select(*KEY, F.lit(0).cast("long").alias("pos"))
    for link in reversed(links):
        at = found.select(*[F.col(c).alias(h) for c, h in zip(KEY, HEAD)], F.col("pos").alias("at"))
        found = found.unionByName(link.join(at, HEAD).select(*KEY, (F.col("at") + F.col("off")).alias("pos")))
        found = hand_over(found, "places")
    return found


def prefix_sums(rows: DataFrame, columns: list[str], n: int, chunk: int = CHUNK) -> DataFrame:
    """rows with each column summed over all places up to its own; places `pos` are 0 .. n - 1."""
    run = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.floor(F.col("pos") / chunk))
    local = rows.withColumns({c: F.sum(c).over(run) for c in columns})
    if n <= chunk:
        return local.drop("run")
    totals = rows.groupBy(F.col("run").alias("pos")).agg(*[F.sum(c).alias(c) for c in columns])
    before = prefix_sums(totals, columns, -(-n // chunk), chunk).select((F.col("pos") + 1).alias("run"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    out = local.join(before, "run", "left")
    return out.select(*[c for c in rows.columns if c not in (*columns, "run")], *[(F.col(c) + F.coalesce(f"_b_{c}", F.lit(0))).alias(c) for c in columns])


def subtree_sums(nodes: DataFrame, columns: list[str], chunk: int = CHUNK, side: int = SIDE) -> DataFrame:
    """(c, d, *columns): each column summed over the subtree of each node."""
    places = ranked(tour(nodes), chunk, side)
    weights = nodes.select("c", "d", F.lit(0).alias("e"), *columns)
    zero = nodes.select("c", "d", F.lit(1).alias("e"), *[F.lit(0).cast("long").alias(c) for c in columns])
    arcs = hand_over(places.join(weights.unionByName(zero), KEY), "weights")
    sums = prefix_sums(arcs.withColumns({f"own_{c}": F.col(c) for c in columns}), columns, arcs.count(), chunk)
    # up to the exit, less what comes before the enter arc
    part = [F.sum(F.when(F.col("e") == 1, F.col(c)).otherwise(F.col(f"own_{c}") - F.col(c))).alias(c) for c in columns]
    return sums.groupBy("c", "d").agg(*part)


def digests(ends: DataFrame) -> DataFrame:
    """(k, sha): SHA-256 of the comma-joined conv_ids of each k, ascending."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, out = batch.column(0), []
            p, q, ids = (np.asarray(x) for x in (k.field("p"), k.field("q"), batch.column(1)))
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                for at in range(lo, hi, PIECE // 8):
                    out.append((at, ",".join(map(str, ids[at : min(hi, at + PIECE // 8)].tolist()))))
            at = pa.array([a for a, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([k.take(at), batch.column(1).take(at), pa.array([t for _, t in out], pa.string())], ["k", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, kept = None, None, None
        for batch in batches:
            done = []
            for k, piece in zip(batch.column(0), batch.column(2)):
                now = (k["d"].as_py(), k["p"].as_py(), k["q"].as_py())
                if now == key:
                    state.update(b"," + piece.as_buffer())
                    continue
                if key is not None:
                    done.append((kept, state.hexdigest()))
                state, key, kept = hashlib.sha256(piece.as_buffer()), now, k.as_py()
            yield rows_of(done, batch.schema.field("k").type)
        if key is not None:
            yield rows_of([(kept, state.hexdigest())], batch.schema.field("k").type)

    def rows_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([s for _, s in rows], pa.string())], ["k", "sha"])

    k = "k struct<d: long, p: long, q: long>"
    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ends.select("k", "conv_id").repartitionByRange(width, "k", "conv_id").sortWithinPartitions("k", "conv_id")
    made = spread.mapInArrow(pieces, f"{k}, first long, piece string")
    return made.repartition("k").sortWithinPartitions("k", "first").mapInArrow(hashed, f"{k}, sha string")


def trie(rows: DataFrame, chunk: int = CHUNK, side: int = SIDE) -> DataFrame:
    """The nodes with their counts, subtree sums and the digest of the conversations that end there."""
    sequence, totals = rebuilt(hand_over(turns(rows), "turns"))
    prefixes = hand_over(members(sequence, chunk), "members")
    nodes = nodes_of(prefixes, totals)
    weighed = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    sums = subtree_sums(weighed, ["n_leaves", "saved_tokens"], chunk, side)
    zero = F.lit(0).cast("long")
    ends = prefixes.where("last").select("k", "conv_id").unionByName(totals.where("total = 0").select(_name(zero, [zero] * 4).alias("k"), "conv_id"))
    found = nodes.join(sums, ["c", "d"]).join(digests(ends), "k", "left")
    return found.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


SQL = """
WITH t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT c, count(*) AS n, c - c % 5 AS b, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda a, x: list_reduce(CAST(range(8) AS BIGINT[]), lambda q, i: CASE WHEN q % 2 = 1 THEN xor(q // 2, 3988292384) ELSE q // 2 END, xor(a, x)), 4294967295), 4294967295) % 9 AS h FROM t GROUP BY c),
r AS (SELECT k.c, t.pos AS d, t.role, t.text FROM k JOIN t ON t.c = k.b AND t.pos <= k.h UNION ALL
    SELECT k.c, t.pos - k.h + least(k.h, coalesce(b.n, 0)), t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h LEFT JOIN k b ON b.c = k.b),
m AS MATERIALIZED (SELECT c, d, list([role, text]) OVER (PARTITION BY c ORDER BY d) AS path, strlen(text) AS size FROM r UNION ALL SELECT c, 0, [], 0 FROM k),
n AS MATERIALIZED (SELECT path, d, min(c) AS conv, count(*) AS members, min(size) AS size FROM m GROUP BY path, d),
o AS MATERIALIZED (SELECT m.c, m.d, n.conv FROM m JOIN n USING (path, d)),
p AS MATERIALIZED (SELECT n.conv, n.d, n.members, n.size, o.conv AS parent FROM n LEFT JOIN o ON o.c = n.conv AND o.d = n.d - 1),
q AS MATERIALIZED (SELECT p.*, coalesce(x.kids, 0) AS kids FROM p LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS kids FROM p WHERE parent IS NOT NULL GROUP BY ALL) x ON x.parent = p.conv AND x.d = p.d),
s AS (SELECT o.conv, o.d, CAST(sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, CAST(sum((members - 1) * size) AS BIGINT) AS saved FROM q JOIN o ON o.c = q.conv AND o.d <= q.d GROUP BY ALL),
e AS (SELECT o.conv, o.d, sha256(string_agg(CAST(o.c AS VARCHAR), ',' ORDER BY o.c)) AS sha FROM o JOIN (SELECT c, max(d) AS d FROM m GROUP BY c) l USING (c, d) GROUP BY ALL)
SELECT q.conv AS conv_id, q.d AS depth, q.parent AS parent_conv_id, q.members AS n_convs, q.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM q JOIN s ON s.conv = q.conv AND s.d = q.d LEFT JOIN e ON e.conv = q.conv AND e.d = q.d
"""
