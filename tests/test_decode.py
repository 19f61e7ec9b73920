import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from answerlake.operators import decode, measure
from answerlake.sources.results import grey_map, read_rasters


def largest_gap(values, stride, default):
    jump, threshold = 25.0, default
    for i in range(len(values) - stride):
        rise = values[i + stride] - values[i]
        if rise > jump:
            jump, threshold = rise, values[i] + rise / 2
    return jump, threshold


def otsu(values):
    n, best, at = len(values), -1.0, None
    for i in range(1, n):
        gap = np.mean(values[:i]) - np.mean(values[i:])
        score = round(i / n * (n - i) / n * gap * gap, 6)
        if score > best:
            best, at = score, i
    if at is None or np.mean(values[at:]) - np.mean(values[:at]) < 30:
        return None
    return (values[at - 1] + values[at]) / 2


def global_threshold(values, looseness):
    jump, threshold = largest_gap(values, 2 * ((looseness + 1) // 2), 200.0)
    if jump == 25.0 and len(values) >= 4:
        split = otsu(values)
        threshold = threshold if split is None else split
    return threshold


def test_thresholds_against_loops(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for sheet in range(60):
        fields = {}
        for q in range(rng.integers(1, 6)):
            dark = rng.random(rng.integers(1, 7)) < 0.3
            level = np.where(dark, rng.integers(40, 120, len(dark)), rng.integers(150 if sheet % 4 else 100, 250, len(dark)))
            fields[f"q{q}"] = sorted(map(float, level))
            rows += [(sheet, f"q{q}", float(v)) for v in level]
        page = global_threshold(sorted(v for f in fields.values() for v in f), 4)
        stds = {n: round(float(np.std(f)), 2) for n, f in fields.items()}
        std_line = global_threshold(sorted(stds.values()), 1)
        for name, f in fields.items():
            flat, low = stds[name] < std_line, False
            if len(f) < 3:
                line = page if f[-1] - f[0] < 30 else float(np.mean(f))
            else:
                jump, line = largest_gap(f, 2, 255.0)
                if jump < 30 and flat:
                    line = page
                elif jump < 30:
                    low = True
            want[(sheet, name)] = (round(line, 6), low)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["scan_id", "name", "mean_intensity"]))
    got = {
        (r["scan_id"], r["name"]): (round(r["threshold"], 6), r["low_confidence"])
        for r in decode.sheet_thresholds(df).collect()
    }
    assert got == want


def test_measure_known_disks(spark, tmp_path):
    page = np.full((60, 80), 240, np.uint8)
    y, x = np.ogrid[:60, :80]
    page[(y - 20) ** 2 + (x - 20) ** 2 <= 36] = 30
    for i in (1, 2):
        (tmp_path / f"S{i}.pgm").write_bytes(grey_map(page))
    boxes = [("q1", 1, "A", 14, 14, 13, 13), ("q1", 2, "B", 50, 14, 13, 13), ("q1", 3, "C", 74, 50, 13, 13), ("q1", 4, "D", 90, 5, 9, 9)]
    rows = measure.measure(read_rasters(spark, str(tmp_path)), boxes, 120).toPandas()
    assert len(rows) == 8 and sorted(rows.scan_id.unique()) == [1, 2]
    one = rows[rows.scan_id == 1].set_index("opt")
    assert one.loc["A", "fill_ratio"] > 0.8 and one.loc["B", "fill_ratio"] == 0.0
    assert one.loc["B", "mean_intensity"] == 240.0
    assert bool(one.loc["C", "out_of_page"]) and one.loc["D", "mean_intensity"] == 255.0


def test_broken_page_is_an_error_row(spark):
    rows = [(1, 4, 4, bytes(16)), (2, 4, 4, bytes(3))]
    df = spark.createDataFrame(rows, "scan_id bigint, width int, height int, pixels binary")
    out = {r["scan_id"]: r for r in measure.quality(df).collect()}
    assert out[1]["error"] is None and out[1]["contrast"] == 0.0
    assert out[2]["error"] and out[2]["sharpness"] is None


def test_model_decides_and_erased(spark):
    rows = [(True, 0.9, 0.1, 0.5), (True, 0.4, 0.0, 0.5), (False, 0.1, 0.7, 0.9)]
    df = spark.createDataFrame(rows, "marked boolean, model_marked_prob double, model_erased_prob double, confidence double")
    second = decode.model_opinion(df).collect()
    assert [r["model_disagrees"] for r in second] == [False, True, True]
    assert [r["confidence"] for r in second] == [0.8, 0.5, 0.9]
    first = decode.model_opinion(df, decides=True).collect()
    assert [r["marked"] for r in first] == [True, False, False]


def test_zone_flags(spark):
    df = spark.createDataFrame([("12", 0.9, []), ("1x", 0.2, []), ("", 0.0, ["not_found"])], "value string, confidence double, flags array<string>")
    out = decode.finalize_zone(df, r"\d+", empty="?").collect()
    assert [r["flags"] for r in out] == [[], ["low_confidence", "pattern_mismatch"], ["not_found"]]
    assert [r["needs_review"] for r in out] == [False, True, True] and out[2]["value"] == "?"
    assert decode.finalize_zone(df.where(F.col("value") == "12"), None).count() == 1


def test_best_read_of_rows_and_of_arrays(spark):
    rng = np.random.default_rng(5)
    rows = [
        (zone, "z", engine, str(rng.choice(["", "7", "12", "x", "1 2", " 12"])), float(rng.choice([0.2, 0.6, 0.9])))
        for zone in range(200)
        for engine in range(1, 1 + rng.integers(1, 5))
    ]
    reads = spark.createDataFrame(rows, "scan_id int, name string, engine int, text string, confidence double")
    zones = reads.groupBy("scan_id", "name").agg(F.collect_list(F.struct("engine", "text", "confidence")).alias("reads"))

    def order(r):
        return (r[3].isdigit(), r[3] != "", r[4], -r[2])

    every, voted = {}, {}
    for zone in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == zone]
        every[zone] = max(mine, key=order)[3]
        sure = [r for r in mine if r[2] == 1 and r[3].isdigit() and r[4] >= 0.6]
        best = max(sure or mine, key=order)
        texts = {"".join(r[3].split()) for r in (sure or mine)} - {""}
        voted[zone] = (best[3], best[4], best[2], ["empty"] * (best[3] == "") + ["engine_disagree"] * (len(texts) > 1))
    got = zones.select("scan_id", decode.best_read(F.col("reads"), "[0-9]+")["text"].alias("text")).collect()
    assert {r["scan_id"]: r["text"] for r in got} == every
    for out in (decode.vote(reads, "[0-9]+"), decode.vote_zones(zones, "[0-9]+")):
        assert {r["scan_id"]: (r["value"], r["confidence"], r["engine"], r["flags"]) for r in out.collect()} == voted


def test_grid_text_against_loops(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for sheet in range(80):
        text = ""
        for pos in rng.permutation(12)[: rng.integers(1, 12)] + 1:
            fills = [float(x) for x in rng.choice([0.0, 60.0, 100.0, 101.0, 180.0], rng.integers(0, 4), p=[0.4, 0.2, 0.2, 0.1, 0.1])]
            rows.append((sheet, int(pos), fills))
        for _, _, fills in sorted(r for r in rows if r[0] == sheet):
            hits = [v for v, fill in zip(["A", "10", "R"], fills) if fill > 100]
            text += hits[0] if len(hits) == 1 else " " if not hits else "*"
        want[sheet] = text
    fields = spark.createDataFrame(rows, "scan_id int, pos int, fills array<double>")
    got = {r["scan_id"]: r["text"] for r in decode.decode_grid(fields, ["A", "10", "R"], 100).collect()}
    assert got == want and any("10" in text for text in want.values())


def test_fields_given_as_arrays_or_as_rows(spark):
    """Both forms of the sheet frame agree, whose standard deviations are those of Spark; unknown levels are left out."""
    rng = np.random.default_rng(3)
    rows = [
        (sheet, f"q{q}", place, "ABCD"[place - 1], None if rng.random() < 0.05 else float(rng.choice([50, 90, 200, 215, 230]) + rng.integers(9) / 7), 0.5)
        for sheet in range(50)
        for q in range(rng.integers(1, 6))
        for place in range(1, 1 + rng.integers(1, 5))
    ]
    bubbles = spark.createDataFrame(rows, "scan_id int, name string, opt_pos int, opt string, mean_intensity double, fill_ratio double")
    fields = decode.gathered(bubbles, ["opt_pos", "opt", "mean_intensity", "fill_ratio"])
    assert sorted(map(repr, decode.field_thresholds(fields).collect())) == sorted(map(repr, decode.sheet_thresholds(bubbles).collect()))
    assert sorted(map(repr, decode.mark_fields(fields).collect())) == sorted(map(repr, decode.marked_fields(bubbles).collect()))
    std = bubbles.groupBy("scan_id", "name").agg(F.round(F.stddev_pop("mean_intensity"), 2).alias("std"))
    want = {(r["scan_id"], r["name"]): r["std"] for r in std.collect()}
    assert {(r["scan_id"], r["name"]): r["std"] for r in decode.mark_fields(fields).collect()} == want
