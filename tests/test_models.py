"""Temperature, palettes, label products, blank forms and undo against plain searches; sheets that hang."""

import math
import os
import random
import time

import numpy as np
import pytest

from answerlake.operators import deadline, measure, metrics, mlprep, review


def mean_loss(rows, t):
    out = []
    for logits, target in rows:
        z = np.array(logits) / t
        p = np.exp(z - z.max())
        out.append(-math.log(max(1e-12, (p / p.sum())[target])))
    return sum(out) / len(out)


def mean_sure(rows, t):
    return float(np.mean([1 / np.exp((np.array(x) - max(x)) / t).sum() for x, _ in rows]))


@pytest.mark.parametrize("seed,noise", [(1, 1.0), (2, 4.0), (3, 0.3)])
def test_temperature_is_that_of_a_fine_search(spark, seed, noise):
    rng = random.Random(seed)
    rows = [([rng.gauss(0, noise) + (3.0 if k == target else 0) for k in range(4)], target) for target in rng.choices(range(4), k=200)]
    found = mlprep.fit_temperature(spark.createDataFrame(rows, "logits array<double>, target int")).first()
    errors = sum(int(np.argmax(x)) != t for x, t in rows)
    assert (found["n"], found["errors"]) == (200, errors)
    fine = np.exp(np.linspace(math.log(0.05), math.log(20), 4001))
    if errors:
        best = min(fine, key=lambda t: mean_loss(rows, t))
        assert mean_loss(rows, found["temperature"]) <= mean_loss(rows, best) + 1e-9
        assert found["temperature"] == pytest.approx(best, rel=2e-3)
    else:
        assert mean_sure(rows, found["temperature"]) == pytest.approx(201 / 202, abs=1e-5) or found["temperature"] == pytest.approx(0.05)


def test_temperature_at_the_ends(spark):
    schema = "logits array<double>, target int"
    assert tuple(mlprep.fit_temperature(spark.createDataFrame([], schema)).first()) == (1.0, 0, 0)
    wrong = spark.createDataFrame([([9.0, 0.0], 1), ([9.0, 0.0], 1)], schema)
    assert mlprep.fit_temperature(wrong).first()["temperature"] == pytest.approx(20.0)
    alike = spark.createDataFrame([([1e-9, 0.0], 0)], schema)
    assert mlprep.fit_temperature(alike).first()["temperature"] == pytest.approx(0.05)


def test_palette_of_separated_colours_per_page(spark):
    rng, rows = random.Random(4), []
    inks = {1: [((200, 30, 30), 600), ((20, 160, 40), 300), ((10, 10, 10), 100)], 2: [((30, 30, 210), 500)], 3: []}
    for page, colours in inks.items():
        for (b, g, r), n in colours:
            rows += [(page, b + rng.randint(-4, 4), g + rng.randint(-4, 4), r + rng.randint(-4, 4), 1) for _ in range(n)]
        rows += [(page, 250, 250, 252, 500), (page, 128, 0, 128, 1)]
    found = {}
    for r in mlprep.palette(spark.createDataFrame(rows, "page int, b int, g int, r int, n int")).collect():
        found.setdefault(r["page"], {})[r["colour"]] = r["share"]
    assert found[1] == {"0": 0.3997, "1": 0.1999, "2": 0.0666, "paper": 0.3331}
    assert found[2] == {"0": 0.4995, "paper": 0.4995}
    assert found[3] == {"paper": 0.998}


def test_undo_of_one_long_log_is_a_tree(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["edit", "undo", "redo", "undo", "redo"])) for i in range(1, 900)]
    rows += [(2, i, "edit" if i % 40 == 5 else rng.choice(["undo", "redo"])) for i in range(1, 300)] + [(None, 7, "edit"), (3, 1, "undo")]
    df = spark.createDataFrame(rows, "scan_id bigint, id bigint, action string")
    for steps in (3, 20):
        want = {}
        for scan, i, action in rows:
            now, undo, redo = want.get(scan, (0, [], []))
            if action == "edit":
                now, undo, redo = i, [*undo, now][-steps:], []
            elif action == "undo" and undo:
                now, undo, redo = undo[-1], undo[:-1], [*redo, now]
            elif action == "redo" and redo:
                now, undo, redo = redo[-1], [*undo, now], redo[:-1]
            want[scan] = (now, undo, redo)
        found = {r["scan_id"]: tuple(r)[1:] for r in review.current_versions(df, steps, run=32).collect()}
        assert found == {s: (n, len(u), len(r)) for s, (n, u, r) in want.items()}


@pytest.mark.parametrize("dense,held", [(1 << 21, 1 << 20), (0, 7)])
def test_label_correlation_is_that_of_numpy(spark, monkeypatch, dense, held):
    monkeypatch.setattr(metrics, "DENSE_SUMS", dense)
    monkeypatch.setattr(metrics, "PAIRS_HELD", held)
    rng = random.Random(8)
    bubbles, labels, tokens = ["a", "b", "c"], ["x", "y"], ["A", "B", "*"]
    marks = [(s, b) for s in range(60) for b in bubbles[:2] if rng.random() < 0.5]
    answers = [(s, lab, rng.choice(["A", "B", "AB", "", "Z"])) for s in range(60) for lab in labels if rng.random() < 0.9]
    found = metrics.label_correlation(
        spark.createDataFrame(marks, "scan_id int, bubble string"),
        spark.createDataFrame([(s, lab, list(v)) for s, lab, v in answers], "scan_id int, label string, letters array<string>"),
        bubbles, labels, tokens,
    )
    got = {(r["bubble"], r["label"], r["token"]): r["corr"] for r in found.collect()}
    assert len(got) == 18
    for (b, lab, tok), corr in got.items():
        pairs = np.array([((s, b) in set(marks), tok in v) for s, x, v in answers if x == lab], float)
        flat = pairs.std(axis=0).min() < 1e-9
        assert corr == pytest.approx(0 if flat else np.corrcoef(pairs.T)[0, 1], abs=1e-6)


def test_blank_form_over_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pages = [(f"t{i % 2}", 7, 45, rng.integers(0, 256, 315, dtype=np.uint8).tobytes()) for i in range(41)] + [("t0", 7, 45, b"short")]
    df = spark.createDataFrame(pages, "template_id string, width int, height int, pixels binary").repartition(6)
    found = {(r["template_id"], r["pixel"]): r["level"] for r in measure.blank_page(df).collect()}
    assert len(found) == 630
    for t in ("t0", "t1"):
        stack = np.sort(np.stack([np.frombuffer(p[3], np.uint8) for p in pages if p[0] == t and len(p[3]) == 315]), axis=0)
        at = math.floor(0.8 * (len(stack) - 1) + 0.5)
        assert all(found[t, i] == stack[at, i] for i in range(315))


def test_a_sheet_that_hangs_or_kills_its_reader(spark):
    def read(item):
        if item["kind"] == "hang":
            time.sleep(60)
        if item["kind"] == "die":
            os._exit(3)
        if item["kind"] == "raise":
            raise ValueError("bad sheet")
        return (item["id"] * 2,)

    kinds = ["fine", "hang", "fine", "die", "raise", "fine", "fine"]
    df = spark.createDataFrame(list(enumerate(kinds)), "id int, kind string").coalesce(1)
    start = time.monotonic()
    rows = {r["id"]: (r["twice"], r["error"]) for r in deadline.read_each(df, "id", read, {"twice": "int"}, 2).collect()}
    assert time.monotonic() - start < 50
    assert rows == {0: (0, None), 1: (None, "not read within 2 s"), 2: (4, None), 3: (None, "the reader ended"), 4: (None, "bad sheet"), 5: (10, None), 6: (12, None)}
    assert deadline.read_each(df.limit(0), "id", read, {"twice": "int"}, 2).count() == 0


def test_sheets_that_hang_wait_side_by_side(spark):
    def read(item):
        if item["id"] % 3 == 0:
            time.sleep(60)
        if item["id"] % 10 == 1:
            end = time.process_time() + 0.2
            while time.process_time() < end:
                pass
        return (item["id"],)

    df = spark.range(90).coalesce(1)
    start = time.monotonic()
    rows = {r["id"]: (r["same"], r["error"]) for r in deadline.read_each(df, "id", read, {"same": "bigint"}, 2).collect()}
    assert time.monotonic() - start < 30  # one after the other they take 60 s at least
    assert rows == {i: (None, "not read within 2 s") if i % 3 == 0 else (i, None) for i in range(90)}


def test_pages_of_one_size_are_measured_together(spark):
    rng = np.random.default_rng(4)
    sizes = [(85, 50), (85, 50), (9, 3), (1, 7), (12, 1), (85, 50)]
    stacks = [rng.integers(0, 256, size, dtype=np.uint8) for size in sizes]
    rows = [(i, s.shape[1], s.shape[0], s.tobytes()) for i, s in enumerate(stacks)] + [(90, 5, 5, b"short"), (91, 0, 0, b"")]
    df = spark.createDataFrame(rows, "scan_id bigint, width int, height int, pixels binary").coalesce(1)
    found = {r["scan_id"]: (r["sharpness"], r["contrast"], r["error"]) for r in measure.quality(df).collect()}
    assert len(found) == 8 and found[90][2] and found[91][2]
    for i, page in enumerate(stacks):
        h, w = page.shape
        inner = page[h // 10 : h - h // 10, w // 10 : w - w // 10].astype(int)
        edge = np.pad(inner, 1, mode="reflect")
        lap = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * inner
        flat = np.sort(inner.ravel())
        low, high = (flat[max(math.ceil(share * flat.size) - 1, 0)] for share in (0.01, 0.99))
        assert found[i] == (pytest.approx(lap.var(), abs=0.051), high - low, None)
    assert len(measure.sharpness_of(np.stack([stacks[0], stacks[1]]))) == 2


def test_colours_of_many_pages_are_those_of_each(spark):
    rng = np.random.default_rng(12)
    lab, n = rng.uniform(-80, 90, (40, 30, 3)), rng.integers(1, 50, (40, 30)).astype(float)
    n[rng.random(n.shape) < 0.4] = 0
    n[0], n[1, 1:] = 0, 0
    weight, mean = mlprep.colours_of(lab, n, 6)
    for p in range(len(n)):
        own, times = lab[p][n[p] > 0], n[p][n[p] > 0]
        groups = mlprep.joined(mlprep.cut_boxes(own, times, 6), own, times) if len(own) else []
        want = sorted((times[g].sum(), *np.average(own[g], axis=0, weights=times[g])) for g in groups)
        found = sorted((w, *m) for w, m in zip(weight[p], mean[p]) if w > 0)
        assert np.allclose(found, want) and len(found) == len(want)
