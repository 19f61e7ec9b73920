"""Streams that end, replace and compact: the keyed store, the inbox, settling files."""

import math
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlake.streaming import intake
from answerlake.streaming.store import KeyedStore

SCHEMA = StructType().add("id", "string").add("n", "long").add("note", "string")


def rows_of(df):
    return {r["id"]: (r["n"], r["note"]) for r in df.collect()}


def test_store_keeps_the_newest_in_few_sets(spark, tmp_path):
    rng, want, root = random.Random(1), {}, str(tmp_path / "store")
    store = KeyedStore(spark, root, SCHEMA, ["id"], ["n"])
    assert store.read().count() == 0
    for batch in range(50):
        rows = [(rng.choice([None, *"abcdefgh"]), rng.randrange(1000), f"b{batch}") for _ in range(3)]
        rows = [r for i, r in enumerate(rows) if r[:2] not in [x[:2] for x in rows[:i]] and want.get(r[0], (-1,))[0] != r[1]]
        for key, n, note in rows:
            want[key] = max(want.get(key, (-1, "")), (n, note))
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        assert store.add(df, batch)
        assert len(store.sets) <= math.log2(batch + 1) + 1
        if batch % 16 == 7:
            before = rows_of(store.read())
            assert not store.add(df, batch) and not store.add(df, batch - 1)
            # a store opened again goes on from the manifest
            store = KeyedStore(spark, root, SCHEMA, ["id"], ["n"])
            assert store.batch == batch and rows_of(store.read()) == before
    assert rows_of(store.read()) == want


def test_equal_orders_give_one_fixed_row(spark, tmp_path):
    found = set()
    for turn in range(3):
        store = KeyedStore(spark, str(tmp_path / f"s{turn}"), SCHEMA, ["id"], ["n"])
        rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, None)]
        random.Random(turn).shuffle(rows)
        for batch, row in enumerate(rows):
            store.add(spark.createDataFrame([row], SCHEMA), batch)
        found.add(tuple(rows_of(store.read()).items()))
    assert len(found) == 1


def test_counts_and_newest_carry_on(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    for turn in range(3):
        spark.range(turn * 10, turn * 10 + 10).selectExpr("id % 3 AS k", "id AS n").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).parquet(folder)
        counts = {r["k"]: r["n"] for r in intake.live_counts(stream, ["k"], f"{root}/counts").collect()}
        newest = {r["k"]: r["n"] for r in intake.newest_of_each(stream, "k", "n", f"{root}/newest").collect()}
        last = turn * 10 + 9
        assert newest == {k: max(i for i in range(last + 1) if i % 3 == k) for k in range(3)}
        assert counts == {k: sum(i % 3 == k for i in range(last + 1)) for k in range(3)}


def test_a_replaced_file_comes_again(spark, tmp_path):
    folder = tmp_path / "in [1]"
    folder.mkdir()

    def put(name, text, changed):
        (folder / name).write_text(f'{{"v": "{text}"}}\n')
        os.utime(folder / name, (changed, changed))

    put("a.json", "one", 1000)
    put("b*.json", "two", 2000)
    inbox = intake.Inbox(spark, str(folder).replace("[", "\\[").replace("]", "\\]"), "v string", str(tmp_path / "run"), "json", "*.json", most=1)
    assert inbox.rows().count() == 0
    inbox.look_until_empty()
    assert sorted(r["v"] for r in inbox.rows().collect()) == ["one", "two"]
    assert inbox.look() == 0
    put("a.json", "eno", 3000)  # as long as before
    put("c.json", "new", 500)  # older than what was handed over
    inbox.look_until_empty()
    assert sorted(r["v"] for r in inbox.rows().collect()) == ["eno", "new", "one", "two"]
    # a tick repeated after a failure takes the same files and writes the same rows
    tick = inbox.ledger.batch
    inbox._tick(None, tick - 1)
    again = intake.Inbox(spark, inbox.folder, "v string", inbox.root, "json", "*.json")
    assert again.ledger.batch == tick and again.look() == 0
    assert again.rows().count() == 4


HOUR = 3_600_000_000
LOOK = "path string, size long, changed long, complete boolean, at long"


def settle_stream(spark, folder, **patience):
    stream = spark.readStream.schema(LOOK).option("maxFilesPerTrigger", 1).parquet(folder)
    looks = stream.withColumn("changed", F.timestamp_micros("changed")).withColumn("at", F.timestamp_micros("at"))
    out = intake.run_to_files(intake.settle(looks, **patience), "settled")
    return sorted((tuple(r) for r in spark.read.schema(intake.READY).parquet(out).collect()), key=repr)


def plain(rows, settle, give_up, forget):
    """The rules for all looks at once, hour by hour."""
    out, end = [], max(r[4] for r in rows)
    for path in {r[0] for r in rows if r[0]}:
        held = taken = looked = None
        for _, size, changed, whole, at in sorted((r for r in rows if r[0] == path), key=lambda r: (r[4], r[2], r[1], r[3])) + [(None, None, None, None, end)]:
            if held and held["size"] > 0:
                due = max(held["first"] + give_up, held["still"] + settle, held["changed"] + settle)
                if due < at:
                    out.append((path, held["size"], held["changed"], due, not held["whole"]))
                    taken, held, looked = (held["size"], held["changed"]), None, due
            if size is None:
                continue
            if looked is not None and looked + forget < at and not (held and held["size"] > 0):
                held = taken = None
            looked = at
            if taken == (size, changed):
                held = None
            elif held is None or (held["size"], held["changed"]) != (size, changed):
                held = {"size": size, "changed": changed, "still": at, "first": held["first"] if held else at, "whole": whole}
            elif size > 0 and at - held["still"] >= settle and at - changed >= settle and (whole or at - held["first"] >= give_up):
                out.append((path, size, changed, at, not whole))
                taken, held = (size, changed), None
            else:
                held["whole"] = whole
    return sorted(out, key=repr)


def test_settling_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        at = n * HOUR // 4
        rows.append((rng.choice(["a", "b", "c", "rare" if n % 40 == 0 else "d"]), rng.choice([0, 5, 5, 6]), at // (7 * HOUR) * 7 * HOUR, rng.random() < 0.6, at))
    rows += [("left", 9, 0, False, HOUR), (None, 1, 1, True, 1), ("whole", 9, 0, True, 2 * HOUR)]
    rows.sort(key=lambda r: r[4])
    want = plain(rows, HOUR, 12 * HOUR, 30 * HOUR)
    assert ("left", 9, 0, 13 * HOUR, True) in want and ("whole", 9, 0, 14 * HOUR, False) in want
    for cut in (400, 45):
        folder = str(tmp_path / f"cut{cut}")
        for k, start in enumerate(range(0, len(rows), cut)):
            part = spark.createDataFrame(rows[start : start + cut], LOOK).coalesce(1)
            part.write.mode("append").parquet(folder)
            for name in os.listdir(folder):  # file sources take the oldest first
                if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 1e9:
                    os.utime(f"{folder}/{name}", (1000 + k, 1000 + k))
        assert settle_stream(spark, folder, settle_s=3600, give_up_s=12 * 3600, forget_s=30 * 3600) == want
