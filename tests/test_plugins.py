"""Plug-in models: loaded once a worker, called in batches, and what searches make of them."""

from __future__ import annotations

from collections import Counter

import numpy as np

from vantarow.operators import plugins
from vantarow.operators.plugins import Dense, Encoder, Fused, HashedWords, Lexical, PairScorer, Plugin, Reranked, SharedWords

WORDS = Plugin("vantarow.operators.plugins:HashedWords", {"dimensions": 64})
SHARED = Plugin("vantarow.operators.plugins:SharedWords")


def tables(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", f"disk full on node {i} " + "pad " * (i % 5) + ("quota exceeded" if i % 3 == 0 else "")) for i in range(40)] + [("c90", None), ("c91", "")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "disk quota exceeded on node 9"), (2, "pad"), (3, ""), (4, None)], "query_id long, query string")
    return chunks.repartition(5), queries


def test_protocols():
    assert isinstance(WORDS.load(), Encoder) and isinstance(SHARED.load(), PairScorer) and not isinstance(SHARED.load(), Encoder)
    assert Plugin("vantarow.operators.plugins:HashedWords", {"dimensions": 64}).load() is WORDS.load()


def test_encoding_in_batches(spark):
    chunks, _ = tables(spark)
    got = {r.chunk_id: np.array(r.v, np.float32) for r in plugins.encode(chunks, "text", "v", WORDS, batch=3).collect()}
    want = {r.chunk_id: HashedWords(64).encode([r.text or ""])[0] for r in chunks.collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want) and not got["c90"].any()


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")
    hits = spark.createDataFrame([(q, f"c{i}", "a b", f"a {i}") for q in range(20) for i in range(30)], "query_id long, chunk_id string, query string, text string").repartition(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for _ in range(2):
            assert plugins.rerank(hits, 30, Plugin("vantarow.operators.plugins:SharedWords", {"log": log}), batch=4).count() == 600
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loads = Counter(open(log, encoding="utf-8").read().split())
    assert set(loads.values()) == {1}  # one line for each process, over 32 tasks and many batches


def test_reranking_equals_a_plain_one(spark):
    chunks, queries = tables(spark)
    hits = queries.crossJoin(chunks)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in plugins.rerank(hits, 5, SHARED).collect()}
    model, want = SharedWords(), {}
    for q in queries.collect():
        scored = sorted(((-round(float(model.score([(q.query or "", c.text or "")])[0]), 9), c.chunk_id) for c in chunks.collect()))
        for rank, (score, c) in enumerate(scored[:5], 1):
            want[(q.query_id, rank)] = (c, -score)
    assert got == want


def test_searches_compose(spark):
    chunks, queries = tables(spark)
    lexical = {(r.query_id, r.chunk_id) for r in Lexical().search(chunks, queries, 3).collect()}
    assert (1, "c09") in lexical and all(q in (1, 2) for q, _ in lexical)
    found = Reranked(Fused((Lexical(), Dense(WORDS)), 20), SHARED, 20).search(chunks, queries.where("query_id = 1"), 2).orderBy("rank").collect()
    assert found[0].chunk_id == "c09" and found[0].score == 1.0 and [r.rank for r in found] == [1, 2]


def test_words_are_hashed_once_while_remembered(monkeypatch):
    import hashlib
    import re

    texts = [f"Disk {i} full, quota-{i % 7} exceeded {'pad ' * (i % 5)}" for i in range(90)] + ["", "café Kelvin"]
    want = np.zeros((len(texts), 48), np.float32)
    for i, t in enumerate(texts):
        for word in re.findall("[a-z0-9]+", t.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            want[i, h % 48] += 1 if h >> 63 else -1
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norm, out=want, where=norm > 0)
    asked, plain = [], hashlib.blake2b
    monkeypatch.setattr(plugins.hashlib, "blake2b", lambda x, **more: asked.append(x) or plain(x, **more))
    for most in (1 << 18, 20):
        monkeypatch.setattr(plugins, "MAX_WORDS", most)
        model = HashedWords(48)
        asked.clear()
        for _ in range(2):
            assert np.array_equal(model.encode(texts), want)
            if most > 20:
                assert len(asked) == len(set(asked))
