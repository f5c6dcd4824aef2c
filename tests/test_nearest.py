"""Searches as products: the rows of plain formulas, whatever blocks and bounds they are made by."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantarow.operators import nearest, retrieval


def crossed(vectors, queries, k):
    """Each pair's products summed from first to last, by a join of all with all."""
    dot = F.aggregate(F.zip_with("embedding", "__q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = vectors.crossJoin(queries.select("query_id", F.col("embedding").alias("__q"))).select("query_id", "vec_id", F.round(dot, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shown(df):
    return sorted((r.query_id, r.rank, r.vec_id, str(r.score if r.score is None else float(f"{r.score:.12g}"))) for r in df.collect())


def test_dense_search_joins_nothing_and_equals_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(i, [0.5, 0.25, 0.0, 0.0, 1.0, -0.5]) for i in range(300, 420)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [1.0, 2.0]), (503, []), (504, [float("nan")] + [1.0] * 5), (505, [float("inf")] + [0.5] * 5), (506, [-float("inf")] + [0.5] * 5), (507, [1e200] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = vectors.where("vec_id % 20 = 0 or vec_id >= 500").select(F.col("vec_id").alias("query_id"), "embedding")
    want = shown(crossed(vectors, queries, 130))
    for slice_, most in ((1 << 21, 10_000), (64 * 20, 7)):
        monkeypatch.setattr(nearest, "SLICE", slice_)
        monkeypatch.setattr(retrieval, "MAX_QUERIES", most)
        found = retrieval.dense_search(vectors, queries, 130)
        assert "Join" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
        assert shown(found) == want


def test_halves_round_as_in_sql():
    import duckdb
    import numpy as np

    x = np.array([0.0000005, -0.0000005, 2.5e-6, 0.1234565, 1.0000005, -3.0000015, 1e300, math.inf, 123456789012.1234567])
    want = [r[0] for r in duckdb.connect().execute("select round(x, 6) from (select unnest(?) as x)", [x.tolist()]).fetchall()]
    assert nearest.rounded(x, 1e6).tolist() == want


def test_whole_texts_as_queries(spark, monkeypatch):
    """Frequent terms go by the dense product, rare ones by postings; copies tie, a null text counts as an empty one."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words[: r.choice((6, 60))]) for _ in range(r.randint(1, 80))) for _ in range(150)]
    docs = spark.createDataFrame([(i, texts[i % 120]) for i in range(300)] + [(300, None), (301, "")], "vec_id long, text string").repartition(6)
    queries = docs.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("text").alias("query"))
    split = [(t or "").split() for t in ([texts[i % 120] for i in range(300)] + [None, ""])]
    n, average = len(split), sum(map(len, split)) / len(split)
    df = {w: sum(w in t for t in split) for w in words}
    want = set()
    for q in range(0, 301, 7):
        scored = []
        for d, t in enumerate(split):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in sorted(set(split[q])) if w in t)
            scored += [(-round(s, 7), d)] if s > 0 else []
        want |= {(q, d, k) for k, (_, d) in enumerate(sorted(scored)[:20], 1)}
    for slice_, size, handed_on in ((1 << 21, 1 << 23, 4_000_000), (3_000, 2_000, 0)):
        monkeypatch.setattr(nearest, "SLICE", slice_)
        monkeypatch.setattr(nearest, "BYTES", size)
        monkeypatch.setattr(retrieval, "MAX_HANDED_ON", handed_on)
        found = retrieval.bm25_search(docs, queries, 20, "vec_id")
        assert {(x.query_id, x.vec_id, x.rank) for x in found.collect()} == want


def test_words_of_batches_are_the_tokens_of_texts(spark):
    import pyarrow as pa

    from vantarow.functions import text
    from vantarow.functions.words import words

    texts = ["The  Quick-brown fox7", None, "", "caf\u00e9s \u212aelvin \u0130stanbul \u00c5x", "end", "begin", " - ", "a\nB\t\u4e2dC9", "\u00fc"]
    want = [r.t or [] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(text.tokens(F.col("x")).alias("t")).collect()]
    for column in (pa.array(texts), pa.array(["pad", *texts])[1:], pa.array([], pa.string()), pa.array([None, None], pa.string())):
        found, counts = words(column)
        found, cuts = found.to_pylist(), [0, *counts.cumsum().tolist()]
        assert [found[a:b] for a, b in zip(cuts, cuts[1:])] == (want if len(column) == len(texts) else [[]] * len(column))


def test_grams_in_bulk_are_those_of_each_text(monkeypatch):
    import hashlib

    r = random.Random(1)
    texts = ["", "a", "ab", "abc ", "中文 text", "x\U0001f600yz", "\x00nul\x00", *("".join(r.choice("abcdefgh 0123é") for _ in range(r.randint(0, 200))) for _ in range(60))]
    for dimensions, gram in ((64, 4), (32, 2), (16, 6)):
        grams, want = retrieval._Grams(dimensions, gram), []
        for t in texts:
            padded, row = f" {t.lower()} ", [0.0] * dimensions
            for i in range(len(padded) - gram + 1):
                row[int.from_bytes(hashlib.blake2b(padded[i : i + gram].encode(), digest_size=4).digest(), "little") % dimensions] += 1
            want.append(row)
        for _ in range(2):  # of new grams and of known ones
            assert grams.counts(texts).tolist() == want and [grams.counts([t]).tolist()[0] for t in texts] == want


def test_one_search_for_each_ranking_and_one_pass_of_texts(spark, tmp_path, monkeypatch):
    """What metrics and intervals read again is read from tables: neither texts nor vectors are gone through for them."""
    docs = spark.createDataFrame([(i, f"x one two word{i} three four y") for i in range(20)] + [(50, "zz"), (51, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two word7 three four"), (2, "zz"), (3, "never there at all"), (4, None), (5, "two word7 three")], "query_id long, query string")
    relevant = retrieval.holding(docs, asked)
    assert "Join" not in relevant._jdf.queryExecution().toString() and sorted(map(tuple, relevant.collect())) == [(1, 7), (2, 50), (5, 7)]
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    assert sorted(map(tuple, retrieval.holding(docs, asked).collect())) == [(1, 7), (2, 50), (5, 7)]
    hits = spark.createDataFrame([(1, 7, 1), (2, 1, 1), (2, 50, 2)], "query_id long, doc_id long, rank int").repartition(3)
    row = retrieval.ablation({"a": hits, "b": hits}, relevant, (1, 3), replicates=20)
    assert "MapInArrow" not in row._jdf.queryExecution().toString() and row.first().mrr == 0.5


def test_totals_of_words_move_no_posting(spark):
    docs = spark.createDataFrame([(f"c{i}", " ".join(f"w{i % j}" for j in range(1, 12)) * (1 + i % 3)) for i in range(40)] + [("n", None), ("e", "")], "chunk_id string, text string").repartition(3)
    found = retrieval.bm25_totals(docs)
    assert "chunk_id" not in str(found._jdf.queryExecution().optimizedPlan()).split("MapInArrow")[0]
    got = {r.term: (r.df, r.total) for r in found.collect()}
    weights = retrieval.bm25_weights(docs).collect()
    split = {r.chunk_id: (r.text or "").split() for r in docs.collect()}
    average, n = sum(map(len, split.values())) / len(split), len(split)
    df = {w: sum(w in t for t in split.values()) for w in {w for t in split.values() for w in t}}
    want = {(c, w): math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for c, t in split.items() for w in set(t)}
    assert len(weights) == len(want) and all(abs(r.weight - want[r.chunk_id, r.term]) < 1e-9 for r in weights)
    assert set(got) == set(df) and all(got[w][0] == df[w] and abs(got[w][1] - sum(v for (_, x), v in want.items() if x == w)) < 1e-9 for w in df)
