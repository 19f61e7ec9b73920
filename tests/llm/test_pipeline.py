"""The pipeline against its stages' plain forms."""

import hashlib

import corpus_pipeline
from answerlake.llm import langid, pii
from answerlake.llm.common import table
from answerlake.session import hand_over
from tests.llm.test_near_copies import plain_roots

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = before = table(spark, SF, "documents")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = hand_over(stage(spark, docs, SF), name)
        results.append(docs)
    assert all(r.columns == before.columns for r in results[:-1])
    kept = {r["doc_id"]: r["text"] for r in results[0].collect()}
    assert len(kept) >= 0.99 * before.count()
    # the stage's rule: five-word shingles, similarity of at least 0.8, compared pair by pair
    order = sorted(kept)
    first = {order[r] for r in plain_roots([kept[i] for i in order])}
    single = {r["doc_id"]: r["text"] for r in results[1].collect()}
    assert set(single) == first
    clean = {r["doc_id"]: r["text"] for r in results[2].collect()}
    masked = {r["doc_id"]: r["text"] for r in results[3].collect()}
    ids = sorted(clean)
    wanted = [pii.masked(clean[i], every) for i, (_, every) in zip(ids, pii.find([clean[i] for i in ids], pii.trained()))]
    assert [masked[i] for i in ids] == wanted
    last = {r["doc_id"]: r["decoded_sha256"] for r in results[4].collect()}
    assert last == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in masked.items()}
    assert langid.ORDER == 4 and corpus_pipeline.run(spark, SF).count() == len(last)
