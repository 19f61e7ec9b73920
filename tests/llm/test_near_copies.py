"""The near-duplicate stage against brute-force similarity of five-word shingles."""

import random

import corpus_pipeline
from answerlake.llm import simhash
from answerlake.session import hand_over

COLUMNS = "doc_id long, text string, lang string"


def plain_roots(texts):
    """Smallest index of each component of texts with a five-word Jaccard similarity of at least 0.8."""
    sets, root = [], list(range(len(texts)))
    for text in texts:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (both >= 0.8 * (len(a) + len(sets[j]) - both)) if a or sets[j] else True:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return [top(i) for i in range(len(texts))]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = "new" + str(rng.randrange(10**6))
    return " ".join(out)


def test_near_copies_by_five_words(spark):
    rng, texts = random.Random(11), [None, "", "a b", "A  b", "a b c"]
    for size in (30, 60, 90, 150, 400, 2000):
        for _ in range(25):
            words = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(size)]
            texts += [" ".join(words), changed(rng, words, 1), changed(rng, words, max(1, size // 60)), changed(rng, words, size // 25)]
    rng.shuffle(texts)
    roots = plain_roots(texts)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], COLUMNS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(roots)
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_dense_blocks_lose_no_pair(spark):
    rng = random.Random(12)
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = [changed(rng, words, n) for n in (1, 2, 4, 6, 8) for _ in range(60)]
    roots = plain_roots(texts)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], COLUMNS)
    rows = hand_over(simhash.similar_texts(docs, cell=64), "rows").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    wanted = {}
    for i, r in enumerate(roots):
        wanted.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_dense_group_sends_each_pair_once_and_few_pairs_a_text(spark, monkeypatch):
    rng, sent, candidates = random.Random(13), [], simhash._candidates
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = [changed(rng, words, n) for n in (1, 2, 4, 6, 8) for _ in range(60)]

    def kept(*args):
        sent.append(hand_over(candidates(*args), "sent"))
        return sent[-1]

    monkeypatch.setattr(simhash, "_candidates", kept)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], COLUMNS)
    assert simhash.similar_texts(docs).select("root").distinct().count() == len(set(plain_roots(texts)))
    for rows in sent:
        pairs = rows.where("b is not null")
        assert pairs.count() == pairs.select("a", "b").distinct().count()
    assert sent[0].where("b is not null").count() <= len(simhash.bands_for(len(texts), 0.8)) * len(texts)


def test_one_row_of_each_component_stays(spark):
    text, other = "one two three four five six seven", "quite another text with words of its own"
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (2, other, "d"), (None, text, "e"), (None, other + " x y", "f"), (None, "alone", "g"), (None, "alone", "h"), (3, None, "i"), (3, "", "j")]
    kept = simhash.keep_first(spark.createDataFrame(rows, COLUMNS)).collect()
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept)
    assert found == [(0, "alone"), (0, other + " x y"), (1, text), (2, other), (3, "")]
