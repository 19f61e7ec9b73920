"""The toxicity network against a plain forward pass, its gradient against differences, and held-out rows."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from answerlake.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def random_net(seed=1):
    rng = np.random.default_rng(seed)
    net = toxicity.Net(["a", "b"], seed)
    net.table[1:] = rng.normal(0, 1, net.table[1:].shape)
    net.speech[1:] = rng.normal(0, 1, net.speech[1:].shape)
    net.bias = [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.SPANS]
    net.out = rng.normal(0, 1, len(net.out)).astype(np.float32)
    return net


def plain_features(net, text):
    words = (text or "").lower().split()
    x = [net.table[toxicity.buckets(pa.array([w]))[0]].sum(0) for w in words] + [np.zeros(toxicity.WIDTH)] * 3
    pooled = []
    for filters, bias in zip(net.filters, net.bias):
        found = [sum(x[i + j] @ filters[j] for j in range(len(filters))) + bias for i in range(len(words) + 1)]
        pooled += list(np.max(found, axis=0))
    spoken = sum((net.speech[toxicity.buckets(pa.array([w]))[0]].sum(0) for w in words), np.zeros(2))
    return np.array(pooled), spoken


@pytest.mark.parametrize("piece", [13, 1 << 19])
def test_features_are_those_of_plain_loops(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (piece,))
    monkeypatch.setattr(toxicity, "SLICE", 60)
    texts = [None, "", " \n", "word", "One, two; three!", "é ñandú «ok» — 你好 a", "tiny bit of text\nwith lines\tand tabs", "same same same same same"]
    net = random_net()
    pooled, spoken = net.features(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        p, s = plain_features(net, text)
        assert np.allclose(pooled[k], p, atol=1e-4) and np.allclose(spoken[k], s, atol=1e-4), text
    assert net.features(pa.array([], pa.string()))[0].shape == (0, 24)


def test_pieces_put_a_text_together():
    for text in ("", "abc", "a b " * 50, "x" * 200, "one two three four five"):
        parts = list(toxicity.pieces(text, 10))
        assert "".join(parts) == text and all(0 < len(p) <= 10 for p in parts)
    assert list(toxicity.pieces("one two three", 8)) == ["one two ", "three"]


def test_words_share_buckets_with_their_stem():
    whole, more, other, dotted, short = toxicity.buckets(pa.array(["stemme", "stemmed", "zzz", "«stemme»!!", "a"]))
    assert (whole == dotted).all() and (whole[1:] == more[1:]).all() and whole[0] != more[0]
    assert set(whole) & set(other) <= {0} and list(short[1:]) == [0, 0, 0, 0] and short[0]


def test_a_step_lowers_the_loss():
    texts = pa.array(["good words here", "bad thing here now", "good thing", "really bad words", "good good day", "so bad a day"] * 6)
    toxic = np.array([False, True] * 18)
    net = toxicity.Net([])
    hashed, ids, sizes = toxicity.sequences(texts)
    weight = np.ones(len(toxic))
    net.start(hashed, ids, sizes, toxic, weight)

    def loss():
        p = 1 / (1 + np.exp(-net.logit(net.features(texts)[0])))
        return -np.mean(np.log(np.where(toxic, p, 1 - p)))

    before = loss()
    net.fit(hashed, ids, sizes, toxic, weight, epochs=40)
    assert loss() < before / 2


def test_threshold_is_the_best_by_trying_all():
    rng = np.random.default_rng(2)
    for _ in range(30):
        z, toxic, w = np.round(rng.normal(0, 1, 25), 1), rng.random(25) < 0.4, rng.random(25) + 0.1
        t = toxicity.threshold(z, toxic, w)
        f1 = lambda cut: 2 * w[toxic & (z >= cut)].sum() / (w[z >= cut].sum() + w[toxic].sum())
        cuts = np.unique(z)
        if toxic.any() and not toxic.all():
            assert f1(t) == pytest.approx(max(f1(c) for c in cuts[1:]))


def test_held_out_rows(spark):
    found = queries.op12_toxicity(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    yes, no = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in yes for b in no]) >= 0.9
    assert np.mean([s < 0.5 for s in no]) >= 0.95


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, toxic int, score double"
    docs = spark.createDataFrame([(i, t, "en", 1, 0.1) for i, t in enumerate([None, "", "a b", "bad " * 400_000, "a b"])] + [(None, "x", None, 0, 0.0)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, lang string")
    assert toxicity.held_out(docs.limit(0), none).count() == 0
    rows = toxicity.held_out(docs, none).collect()
    assert len(rows) == 6 and {(r["score"], r["predicted"]) for r in rows} == {(0.25, 0)}
    marks = spark.createDataFrame([(i, 1, t, "x") for i, t in [(1, 0), (2, 0), (3, 1), (3, 0), (4, None), (4, 0), (None, 1)]], none.schema)
    rows = toxicity.held_out(docs, marks).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and by_id[0]["score"] == by_id[1]["score"] and by_id[2]["score"] == by_id[4]["score"]
    assert by_id[None]["held_out"] is False and by_id[3]["score"] > by_id[2]["score"]


def test_every_labelled_row_teaches(spark):
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(["one", "two", "three", "four", "five"], 6)) + f" n{i}" for i in range(9000)]
    # the words of a toxic text are rare: few rows of the table hold each
    texts = [f"{t} vile{i // 6}" if i % 2 else t for i, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    rows = toxicity.learnt(docs, marks, toxicity.crc_mod("doc_id", 5) != 0)
    wanted = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(texts)))
    assert rows.agg({"weight": "sum"}).first()[0] == wanted > 2 * 3000
    counts = toxicity._counted(rows, ["en"])
    seen = {r["text"] for r in rows.where("seen").collect()}
    for word in ("vile3", "vile1400", "n8001"):
        bucket = toxicity.buckets(pa.array([word]))[0][0]
        assert counts[bucket, :2].sum() >= sum(word in t.split() for t in seen)
    marked = [r["text"] for r in rows.collect()]
    assert counts[toxicity.buckets(pa.array(["three"]))[0][0], 2] >= sum(t.split().count("three") for t in marked)
