"""The text operators against plain Python, SQL and odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from answerlake.llm import bpe, decontam, embeddings, extract, langid, pii, pst, queries, sharding, simhash, warc, wordtable
from answerlake.llm.common import components
from tests.oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, fp long, flag boolean, spans string, node long, n_words int"


def docs_of(spark, texts, lang="en"):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, lang, 1, True, "x", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    texts = [None, "", " ", "a", "a  b", "a   b", "x\n \ny", "it's 12 ok", "word " * 3000, "z" * 5000, "é" * 300, "same text here", "same text here"]
    return texts + ["".join(rng.choices("ab1 ,\n\té.", k=rng.randint(0, 40))) for _ in range(60)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(queries.queries()[name](spark, SF))
    expected_columns, expected = sql_rows(connect(SF), queries.oracle_sql()[name])
    assert columns == expected_columns and rows == expected


def test_tokens_are_those_of_the_library(spark, odd):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    docs = docs_of(spark, odd)
    found = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    assert found == {i: library.encode_ordinary(t or "") for i, t in enumerate(odd)}
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(odd)}
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1] * 9000)
    assert (wordtable.unpack(wordtable.pack(numbers)) == numbers).all()


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1, 1), (None, 3)]
    root = list(range(300))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: top(x) for a, b in links if a is not None and a != b for x in (a, b)}


def test_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    near = base[:20] + rng.normal(size=(20, 8)) * 0.02
    rows = [x.tolist() for x in np.concatenate((base, near, base[:3], base[:1] * 1e200, base[:1] * 1e-200))]
    rows += [None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, node string")
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, tile=16).collect()}

    def usable(r):
        return bool(r) and all(x is not None and np.isfinite(x) for x in r) and any(r)

    def close(a, b):
        if len(a) != len(b):
            return False
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95

    links = {i: [j for j in range(len(rows)) if i != j and usable(rows[i]) and usable(rows[j]) and close(rows[i], rows[j])] for i in range(len(rows))}
    assert {i: r["n_links"] for i, r in found.items()} == {i: len(x) for i, x in links.items()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())
    assert all(found[i]["component_id"] == found[j]["component_id"] for i in links for j in links[i])
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_fingerprints_against_all_pairs(spark, odd):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(400)]
    texts = odd + [" ".join(words), " ".join(words).upper(), " ".join(words[:-1]), " ".join(words[:200] + ["new"] + words[200:])] * 2
    found = sorted(simhash.near_duplicates(docs_of(spark, texts)).collect())
    prints = [simhash.fingerprint(t) for t in texts]
    assert [r["fp"] % (1 << 64) for r in found] == prints
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = min(label[i], label[j])
    assert [r["component_id"] for r in found] == label
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_large_blocks_are_cut_into_cells(spark):
    base = random.Random(6).getrandbits(62)
    prints = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(40)} | {base})
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), cell=64)
    assert {r["root"] for r in components(links).collect()} == {min(prints)}


def test_long_items_blocks_of_items_and_removal(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, None), (4, "..."), (2, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    passage = "Alpha, beta gamma-delta epsilon zeta eta theta iota kappa lambda"
    texts = ["clean text only here " * 20, f"before {passage} after " + "more words " * 30, "a SHORT one b", passage, None, "", "alpha beta gamma"]
    docs = docs_of(spark, texts)
    for block in (5, 1000):
        found = sorted(decontam.matches(docs, bench, block_words=block).collect())
        assert [r["__items"] for r in found] == [[], ["1"], ["2"], ["1"], [], [], []]
        assert [[tuple(s) for s in r["__spans"]] for r in found] == [[], [(1, 12)], [(1, 3)], [(0, 11)], [], [], []]
    left = {r["doc_id"]: r["text"] for r in decontam.remove(docs, bench).collect()}
    assert 3 not in left and left[0] == texts[0] and left[4] is None and left[2] == "a  b"
    assert left[1].startswith("before  after more") and decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_archives_round_trip(spark):
    payloads = ["a" * 2000, "a" * 2000, None, "", "x\r\n\r\ny\r\n\r\n" * 300, "\r\r\n\r\n\r\n\n" * 200, "é" * 5000, "a" * 2000, "\r\n\r\n", "z\r\n"]
    frame = spark.createDataFrame([(i, None if i == 3 else f"http://a b/{i}\r\n", t, 1) for i, t in enumerate(payloads)], "page_id long, url string, html string, digest int")
    from answerlake.session import scratch

    path = scratch(spark, "archive")
    warc.write(frame, path, chunk=1001)
    data, last = {}, {}
    for r in sorted(warc.read(spark, path, chunk=500).collect(), key=lambda r: r["chunk_no"]):
        data[r["record_id"]] = data.get(r["record_id"], b"") + bytes(r["data"])
        if r["last"]:
            last[r["record_id"]] = r
    for i, text in enumerate(payloads):
        row, full = last[f"<urn:page:{i}>"], (text or "").encode()
        assert row["stated_digest"] == hashlib.sha1(full).hexdigest() and row["stated_bytes"] == len(full)
        if i in (0, 1):
            assert (row["record_type"], row["refers_to"]) == ("revisit", "<urn:page:7>")
        else:
            assert data[f"<urn:page:{i}>"] == full and row["sha1_so_far"] == row["stated_digest"]
    assert warc.round_trip(frame.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [0, 900])
def test_shards_are_even_and_slots_gapless(spark, odd, copies):
    texts = odd * 3 + ["one hot text of many copies"] * copies
    rows = sharding.assign(docs_of(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    sizes = Counter()
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        sizes[r["shard"]] += r["size"]
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    # no shard is further from the mean than one largest group
    assert max(sizes.values()) - sum(sizes.values()) / 16 <= 3 * 15001
    assert sharding.assign(docs_of(spark, texts).limit(0)).count() == 0


def test_languages_are_told_apart_on_held_out_rows(spark):
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 2 and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd):
    found = {r["doc_id"]: r for r in langid.held_out(docs_of(spark, odd)).collect()}
    for i, text in enumerate(odd):
        assert (found[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    nothing = docs_of(spark, ["abc"], lang=None)
    assert [r["lang_pred"] for r in langid.held_out(nothing).collect()] == ["und"]
    assert langid.keep_identified(docs_of(spark, ["12 34", None, "a plain text"])).columns == docs_of(spark, []).columns


def test_kneser_ney_sums_to_one():
    models = langid.Models([("a", "abab ba abba"), ("b", "cc dd")])
    total = sum(np.exp(-models.costs([w])[0, 0]) for w in ("a", "b"))
    assert 0 < total < 1 and models.languages == ["a", "b"]


def test_pattern_spans_against_plain_patterns():
    import re

    rng = random.Random(8)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choices("a1.@- +2%", k=rng.randint(0, 40)))
        spans = pii.base_spans(text)
        assert [s[1:] for s in spans if s[0] == 0] == [m.span() for m in email.finditer(text)]
        wanted = [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[1:] for s in spans if s[0] == 1] == wanted


def test_network_finds_held_out_spans():
    network, hit, whole = pii.trained(), 0, 0
    for text, spans in pii.labelled_texts(150, seed=77):
        every = list(pii.find([text], network))[0][1]
        hit += sum((s, e) in {x[1:] for x in every} for _, s, e in spans)
        whole += len(spans)
    assert hit >= 0.8 * whole


def test_personal_data_of_odd_rows(spark):
    texts = [None, "", "mail bob.1@x.example.com now", "4111 1111 1111 1111", "+1 (017) 555-7713", "1.2.3.4 and 1.2.3.999", "no data " * 3000 + "5.6.7.8"]
    rows = sorted(pii.report(docs_of(spark, texts)).collect())
    assert [tuple(r[1:5]) for r in rows] == [(0,) * 4, (0,) * 4, (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 1, 0, 0), (0, 1, 0, 0)]
    masked = [r["text"] for r in sorted(pii.mask(docs_of(spark, texts)).collect())]
    assert masked[:5] == [None, "", "mail [EMAIL] now", "[CARD]", "[PHONE]"] and masked[6].endswith("[IP]")


def test_main_text_of_made_pages(spark):
    field, made = extract.trained(), extract.labelled_pages(80, seed=99)
    assert sum(extract.main_text(p, field) == "\n\n".join(t) for p, t in made) >= 0.85 * len(made)
    page = '<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two.<script>var t="</p>";</script><p>Three</article><footer>&copy; x</footer>'
    frame = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p", "x")], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r["text"] for r in extract.extract(frame).collect()}
    assert found == {1: "A & B\n\nOne two.\n\nThree", 2: "", 3: "", 4: ""}


def test_word_scores_against_plain_counts(spark, odd):
    found = {r["doc_id"]: r for r in pst.held_out(docs_of(spark, odd)).collect()}
    train = [t for i, t in enumerate(odd) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*pst.words(t or ""), None])
    n, kinds = sum(counts.values()), len(counts)
    for i, text in enumerate(odd):
        words = [*pst.words(text or ""), None]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in words)
        row = found[i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(row["base_score"] - base) < 1e-9 * abs(base) and row["score"] < 0
    assert pst.held_out(docs_of(spark, odd).limit(0)).count() == 0
