"""The character models: probabilities that sum to one, texts that are rejected, samples without repeats."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlake.llm import contexts, langid, pst
from answerlake.llm.common import table

ROWS = [("a", "the cat sat on the mat and that thin thing"), ("b", "der hund und die katze sind über dem haus"), ("b", "die und das")]


def test_next_characters_sum_to_one_after_every_context():
    models = langid.Models(ROWS)
    characters = sorted(models.alphabet - {" "})
    for context in ("", "t", "th", "the", "und", "ü", "qu", "xq", "zzzz", "thxd"):
        ends = [context] if context else []
        group = [*(context + c for c in characters), context + "Ж", *ends]
        logs, at, total = models.logs_of(group), 0, np.zeros(2)
        for word in group:
            place = at + (len(word) + 1 if word in ends else len(context) + 1)
            total += np.exp(logs[place])
            at += len(word) + 2
        if not context:  # the end of an empty word: what one more boundary after the first costs
            total += np.exp(models.logs_of([""])[1])
        assert np.allclose(total, 1.0), (context, total)


def test_digits_and_number_signs_are_no_letters():
    assert langid.words("12 ² ½ _") == [] and langid.words("Ab²c d_e") == ["ab", "c", "d", "e"]


def test_random_letters_and_another_script_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    models = langid.fit(docs, F.lit(True))
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(120)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*junk, "дом и сад " * 40, None, "", "12 ½"])]
    found = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()
    assert all(r["__rejected"] for r in found)
    assert [(r["__lang"], r["__score"]) for r in found[-3:]] == [("und", 0.0)] * 3
    kept = langid.keep_identified(docs).count()
    assert kept >= 0.99 * docs.count()
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_repeated_texts_count_once(spark):
    rows = [(i, "one two three", "x") for i in range(50)] + [(50, "four five six", "x"), (51, "sieben acht", "y")]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample=2)
    assert models.languages == ["x", "y"] and set("fourivesx") <= models.alphabet


def plain_scores(texts, training, alone, depth, least, gain):
    """log10 probabilities of texts by the word tree, with dictionaries."""
    begin, end = object(), object()
    rows = [[begin, *pst.words(t or ""), end] for t in texts]
    follow = defaultdict(Counter)
    for row, learnt in zip(rows, training):
        for i in range(1, len(row)) if learnt else ():
            for d in range(0, min(depth, i) + 1):
                follow[tuple(row[i - d : i])][row[i]] += 1

    def kept(context):
        n = follow.get(context, Counter())
        total, above = sum(n.values()), follow[context[1:]]
        if total < least:
            return False
        q = {s: above[s] / sum(above.values()) for s in n}
        return sum(c * np.log(c / total) - (c - 1) * np.log(q[s]) for s, c in n.items()) >= gain

    keep = {c for c in list(follow) if c and kept(c)}
    out = []
    for row in rows:
        total = 0.0
        for i in range(1, len(row)):
            p = alone(None if row[i] is end else row[i])
            for d in range(1, min(depth, i) + 1):
                context = tuple(row[i - d : i])
                if context in keep:
                    n = follow[context]
                    p = (n[row[i]] + len(n) * p) / (sum(n.values()) + len(n))
            total += np.log10(p)
        out.append(total)
    return out, keep


@pytest.mark.parametrize("hot", [0, 30])
def test_words_are_predicted_by_the_words_before_them(spark, monkeypatch, hot):
    rng = random.Random(3)
    monkeypatch.setattr(pst, "CHUNK", 400)
    monkeypatch.setattr(contexts, "BUCKET", 300)
    texts = [None, "", "a", *(" ".join(rng.choice(["the red cat sat", "the old dog ran", "a cat", "and so", "x%d" % rng.randint(0, 40)]) for _ in range(rng.randint(1, 12))) for _ in range(150))]
    order = [w for t in texts[3:20] for w in t.split()]
    texts += [" ".join(order), " ".join(rng.sample(order, len(order))), texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    limits = dict(depth=3, least=3, gain=4.0)
    flag = F.coalesce(pst.crc_mod("doc_id", 5) != 1, F.lit(True))
    found = {r["doc_id"]: r["score"] for r in pst.score(docs, flag, **limits, hot=hot).collect()}
    tree = pst.grow(vocabulary_of(spark, texts, training), sum(training))
    counts = Counter(w for t, learnt in zip(texts, training) if learnt for w in [*pst.words(t or ""), None])
    n, kinds = sum(counts.values()), len(counts)

    def alone(word):
        log = tree.end() if word is None else float(tree.scores([word])[0])
        return (counts[word] + kinds * 10**log) / (n + kinds)

    wanted, keep = plain_scores(texts, training, alone, **limits)
    assert {len(c) for c in keep} == {1, 2, 3}
    assert np.allclose([found[i] for i in range(len(texts))], wanted, rtol=1e-9)
    # the same words in another order are less likely
    assert found[len(texts) - 3] > found[len(texts) - 2] + 5


def vocabulary_of(spark, texts, training):
    counts = Counter(w for t, learnt in zip(texts, training) if learnt for w in pst.words(t or ""))
    return spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, c long")


def test_questions_of_a_chunk_take_few_bytes_a_symbol():
    import tracemalloc

    words = np.minimum(np.random.default_rng(1).zipf(1.3, 400_000) - 1, 19_999).astype(np.int64)
    counts = np.bincount(words, minlength=20_000)
    rank = np.empty(20_000, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(20_000)
    counts = np.sort(counts)[::-1]
    firsts = np.flatnonzero(np.diff(counts, prepend=-1))
    facts = contexts.Facts(firsts, counts[firsts], 20_000, 400, 3, 16, 4.0)
    tracemalloc.start()
    text = contexts.Text(facts, np.full(400, 1000), np.ones(400, np.int64), rank[words])
    text.ask()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # every occurrence behind a context that is often enough is counted once
    assert text.seen.sum() == len(text.at) and peak < 80 * len(words)
