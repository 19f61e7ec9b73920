"""Codes of vectors against SQL and a plain Lloyd in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from answerlake.llm import covertree, queries
from tests.oracle import connect, spark_rows, sql_rows


def plain(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and codebooks of rows (id, vector)."""
    rows = sorted((i, [math.floor(4096 * x) for x in v]) for i, v in rows)
    width = len(rows[0][1]) // parts
    cut = [[(i, tuple(v[p * width : (p + 1) * width])) for i, v in rows] for p in range(parts)]
    books = [[v for _, v in part[:entries]] for part in cut]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, part in enumerate(cut):
            members = {}
            for _, v in part:
                members.setdefault(best(v, books[p])[1], []).append(v)
            for k, vs in members.items():
                books[p][k] = tuple(sum(c) // len(vs) for c in zip(*vs))
    out = {}
    for n, (i, _) in enumerate(rows):
        found = [best(cut[p][n][1], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


def test_tree_holds_its_laws():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(-50, 50, (700, 3)), axis=0)
    copies = rng.integers(1, 9, len(points))
    tree = covertree.Tree.build(points, copies, leaf=2)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for node in range(len(tree.lo)):
        inside = tree.leaves[tree.lo[node] : tree.hi[node]].astype(float)
        centre = tree.leaves[tree.centre[node]]
        assert tree.lo[node] <= tree.centre[node] < tree.hi[node]
        assert np.sqrt(((inside - centre) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
        kids = range(tree.first[node], tree.first[node] + tree.children[node])
        hearts = np.array([tree.leaves[tree.centre[k]] for k in kids], float)
        if len(hearts) > 1:
            apart = np.sqrt(((hearts[:, None] - hearts) ** 2).sum(2)) + 1e9 * np.eye(len(hearts))
            assert apart.min() > tree.radius[node] / 2
    entries = points[rng.choice(len(points), 9)]
    squares = ((points[:, None] - entries) ** 2).sum(2)
    entry, error = tree.codes(entries)
    assert (entry == squares.argmin(1)).all() and (error == squares.min(1)).all()
    n, total = tree.sums(entries)
    assert (n == np.bincount(squares.argmin(1), copies, 9)).all()
    for k in range(9):
        mine = squares.argmin(1) == k
        assert (total[k] == (points[mine] * copies[mine, None]).sum(0)).all()


@pytest.mark.parametrize("block", [5, 4096])
def test_codes_are_those_of_plain_lloyd(spark, block):
    rng = random.Random(5)
    hearts = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    vectors = [[h + rng.gauss(0, 0.1) for h in rng.choice(hearts)] for _ in range(120)] + [[0.5] * 16] * 40 + [[-0.0001] * 16]
    rows = [(i * 3, v, i % 4 if i % 5 else None, "extra") for i, v in enumerate(vectors)]
    bad = [(0, None, 1, "x"), (1, [float("nan")] * 16, 1, "x"), (2, [None] * 16, 1, "x"), (4, [float("inf")] + [0.0] * 15, 1, "x"), (5, [], 1, "x")]
    df = spark.createDataFrame(rows[1:] + bad + [(0, vectors[0], 0, "extra")], "vec_id long, embedding array<double>, label int, code string")
    coded, books = covertree.compress(df, block=block)
    expected, expected_books = plain([(i, v) for i, v, *_ in rows])
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == expected
    assert [[tuple(e) for e in b.tolist()] for b in books] == [list(map(tuple, b)) for b in expected_books]


def test_report_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert covertree.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.0] * 8, None), (1, [0.0] * 8, None), (2, [1.0] * 8, 3), (None, [1.0] * 8, None), (9, [1.0] * 9, 3)]
    found = covertree.report(spark.createDataFrame(rows, schema)).collect()
    digest = hashlib.sha256(",".join(["0,0,4096,4096"] * 8).encode()).hexdigest()
    assert sorted(((r["vec_id"] or 0), r["code"], r["error"], r["label_error"]) for r in found) == [
        (0, "02" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "02" * 8, 0, 0)]
    assert {r["codebooks_sha256"] for r in found} == {digest}


def test_same_rows_as_sql_on_the_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    columns, rows = spark_rows(queries.queries()["op11_vector_codes"](spark, sf))
    assert (columns, rows) == sql_rows(connect(sf), queries.oracle_sql()["op11_vector_codes"])
