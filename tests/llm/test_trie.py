"""The conversation trie against SQL and a plain trie in Python; small chunks reach every way of ranking."""

import hashlib
import random
import zlib

import pytest

from answerlake.llm import queries, trie
from tests.oracle import connect, spark_rows, sql_rows

SCHEMA = "conv_id long, turn long, role string, text string, k string, d int, pos int, n long"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    name = {p: min(c for c, _ in m) for p, m in members.items()}
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c, last in sorted(m) if last)
        out.add((name[p], len(p), name[p[:-1]] if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n) + [5_000_000_000, 10**15]:
        for t in range(rng.choice([1, 2, 3, 5, 30])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None]), rng.choice(["a", "b", "é", None, "long " * 30]) if rng.random() < 0.7 else "a"))
    rows += rng.sample(rows, 10) + [(None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,side", [(16, 2), (16, 64), (8192, 64)])
def test_nodes_are_those_of_a_plain_trie(spark, chunk, side):
    rows = random_rows(chunk + side, 30)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    found = trie.trie(df, chunk, side).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == plain(rows)


def test_hot_and_empty_tables(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    copies = [(c, t, "user", "same" * t) for c in range(60) for t in range(3)] + [(1000, t, None, f"t{t % 7}") for t in range(90)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in copies], SCHEMA)
    assert {tuple(r) for r in trie.trie(df, 32, 4).collect()} == plain(copies)
    # the base has fewer turns than asked for, so the rebuilt conversation of 1 has none
    few = [(c, 0, None, None) for c in range(1, 5)]
    assert {tuple(r) for r in trie.trie(spark.createDataFrame([(*r, "x", 1, 2, 3) for r in few], SCHEMA)).collect()} == plain(few)


def test_same_rows_as_sql_on_the_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    columns, rows = spark_rows(queries.op13_conversation_trie(spark, sf))
    assert (columns, rows) == sql_rows(connect(sf), trie.SQL)
