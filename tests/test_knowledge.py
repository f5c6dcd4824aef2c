from __future__ import annotations

from pyspark.sql import functions as F

from vantarow.functions import text
from vantarow.operators import response, retrieval, windows
from vantarow.sources import telemetry


def stripped(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    return [r.page for r in retrieval.strip_html(rows, "page").orderBy("i").collect()]


def test_markup(spark):
    pairs = [
        ("one<script async>do(this)</script><style>b{}</style><!-- not\nseen -->two<template><p>x</p></template>", "onetwo"),
        ("<table><tr><th>Key</th><th>Value</th></tr><tr><td>cpu</td><td>4</td></tr></table>", "\n\n | Key | Value\n\n | cpu | 4\n\n"),
        ('See <em>the</em> <a title="1 > 0" href=\'x\'>manual</a>.', "See the manual."),
        ("run it on <host-name> or <zone>", "run it on <host-name> or <zone>"),
        ("<p>5 &lt; 6 &amp; caf&eacute; &#8364;&#x20AC; &nosuch; &#128;</p>", "\n5 &lt; 6 &amp; café €€ &nosuch; €\n"),
        ("a &nbsp; b  \n\n\n\n", "a &nbsp; b  \n\n\n\n"),
        ("<b>x</b>  \n\n\n\ny", "x\n\ny"),
        ("<BR/>a<unknown title=\"<p>\">b", "\na<unknown title=\"<p>\">b"),
        ("say ``` in a line <b>here</b>", "say ``` in a line here"),
        (None, None), ("", ""),
    ]
    assert stripped(spark, *[p for p, _ in pairs]) == [w for _, w in pairs]


def test_fences_stay(spark):
    code = "```text\n<div>kept</div>\n```"
    pages = [code, f"<p>before</p>\n{code}", f"{code}\n<i>after</i>", f"<i>a</i>\n{code}\n{code}\n\n<i>b</i>", "<i>x</i>\n~~~\n<i>never closed</i>\n"]
    assert stripped(spark, *pages) == [code, f"\nbefore\n\n{code}", f"{code}\nafter", f"a\n{code}\n{code}\n\nb", "x\n~~~\n<i>never closed</i>\n"]


def test_chunks_follow_headings(spark):
    text = "intro " * 30 + "\n## First part\n" + "word " * 300 + "\n#### Second\n" + "<script>track()</script>" + "tail " * 40 + "\n# not a part\n## Short\nx"
    rows = spark.createDataFrame([(7, text, "url")], "doc_id long, text string, url string")
    got = retrieval.chunk_documents(rows).orderBy("offset").collect()
    assert [r.heading for r in got] == ["", "First part", "First part", "Second"] and {r.url for r in got} == {"url"}
    assert not any("track" in r.piece for r in got) and "# not a part" in got[-1].piece
    import hashlib

    assert all(r.chunk_id == hashlib.sha1(f"7:{r.offset}".encode()).hexdigest()[:16] for r in got)


def test_search_of_blocks_of_queries(spark, monkeypatch):
    """Scores of the product of matrices equal postings joined and summed, whatever the block of queries."""
    import random

    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(99, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(r.choice("abcdefghz") * r.randint(1, 3) for _ in range(6))) for i in range(12)] + [(50, ""), (51, "zzz")], "query_id long, query string")
    weights = retrieval.bm25_weights(docs)
    terms = asked.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))
    summed = weights.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("weight"), 9).alias("score"))
    want = sorted(map(tuple, retrieval.top_k(summed, 5, "chunk_id").collect()))
    for most in (10_000, 5):
        monkeypatch.setattr(retrieval, "MAX_QUERIES", most)
        got = sorted(map(tuple, retrieval.bm25_search(docs, asked, 5).collect()))
        assert [(q, c, k) for q, c, _, k in got] == [(q, c, k) for q, c, _, k in want]
        assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, want))


def test_hash_embedding(spark):
    import hashlib
    import math

    rows = spark.createDataFrame([(1, "Ab cab cab"), (2, ""), (3, None)], "i int, t string").select("i", retrieval.hash_embedding(64)("t").alias("e")).collect()
    want = [0.0] * 64
    padded = " ab cab cab "
    for i in range(len(padded) - 3):
        want[int.from_bytes(hashlib.blake2b(padded[i : i + 4].encode(), digest_size=4).digest(), "little") % 64] += 1
    norm = math.sqrt(sum(x * x for x in want))
    got = {r.i: r.e for r in rows}
    assert all(abs(a - b / norm) < 1e-6 for a, b in zip(got[1], want)) and sum(got[2]) == sum(got[3]) == 0


def test_passages_and_intervals(spark):
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "one two four"), (3, "zz")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four"), (2, "zz")], "query_id long, query string")
    relevant = retrieval.holding(docs, asked)
    assert sorted(map(tuple, relevant.collect())) == [(1, 1), (2, 3)]
    hits = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 3, 2)], "query_id long, doc_id long, rank int")
    row = retrieval.ablation({"a": hits}, relevant, (1, 3), replicates=50).first()
    assert (row.mrr, row.hit_1, row.hit_3) == (0.75, 0.5, 1.0) and row.hit_1_low <= 0.5 <= row.hit_1_high and row.hit_3_low == 1.0


def test_markdown_and_title(spark):
    t = "---\ntitle: \"My page\"\n---\n{{< note >}}\n# Head\n\n\n\nText<!-- gone -->"
    r = spark.createDataFrame([(t,), ("# Only head\nx",)], "t string").select(text.clean_markdown(F.col("t")).alias("c"), text.title(F.col("t")).alias("h")).collect()
    assert (r[0].c, r[0].h, r[1].h) == ("# Head\n\nText", "My page", "Only head")


def test_chunks_overlap(spark):
    body = " ".join(f"word{i:04d}" for i in range(300))
    rows = spark.createDataFrame([(1, body, 0), (2, "short", 0)], "doc_id long, body string, offset int")
    got = retrieval.chunks(rows).orderBy("offset").collect()
    assert {r.doc_id for r in got} == {1} and len(got) == 3 and all(len(r.piece) <= 1200 for r in got)
    assert [r.offset for r in got] == [0, 1000, 2000]


def test_bm25_and_rerank(spark):
    docs = spark.createDataFrame([("memory", "memory leak limit"), ("rollout", "rollout restart of a deployment rollout"), ("network", "packet loss")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "rollout restart"), (2, "zzz")], "query_id int, query string")
    hits = retrieval.bm25_search(docs, q, 3).collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in hits] == [(1, "rollout", 1)]


def test_groundedness(spark):
    rows = spark.createDataFrame([(1, "Memory limit reached container. ", "memory limit reached container"), (2, "", "x"), (3, "Disk pressure evicted pods everywhere.", "memory")], "answer_id int, answer string, context string")
    got = {r.answer_id: r.score for r in retrieval.groundedness_report(rows).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}


def test_audit_chain_finds_edits_removals_and_rewrites(spark):
    names = ("principal", "decision")
    entries = spark.createDataFrame([(1, i, f"p{i}", "yes") for i in range(5)], "log_id int, seq int, principal string, decision string")
    log = response.build_chain(entries, names).cache()
    assert response.verify_chain(log, names).first().first_broken is None
    assert response.verify_chain(log.withColumn("decision", F.when(F.col("seq") == 2, "no").otherwise("yes")), names).first().first_broken == 2
    assert response.verify_chain(log.where("seq != 1"), names).first().first_broken == 2
    head = response.verify_chain(log, names)
    rewritten = response.build_chain(entries.withColumn("decision", F.lit("no")), names)
    anchors = spark.createDataFrame([(1, 5, head.first().head)], "log_id int, n int, hash string")
    assert response.verify_chain(rewritten, names).first().first_broken is None
    assert not response.check_anchors(response.verify_chain(rewritten, names), rewritten, anchors).first().anchored
    assert response.check_anchors(head, log, anchors).first().anchored


def test_rate_limit_ignores_refused(spark):
    rows = spark.createDataFrame([(1, float(t), i) for i, t in enumerate((0, 10, 20, 30, 61, 62))], "caller long, at double, request_id long")
    got = [r.admitted for r in response.rate_limit(rows, per_caller=2).orderBy("request_id").collect()]
    assert got == [True, True, False, False, True, False]


def test_annotations(spark):
    lines = spark.createDataFrame([("10-20:3,1",), ("",), ("nothing",), ("5-9:2",)], "value string")
    assert [(r.start, r.end, r.dims) for r in telemetry.parse_annotations(lines).collect()] == [(10, 20, [1, 3]), (5, 9, [2])]
    assert telemetry.read_annotations(spark, "/tmp/there/is/no/such/file").count() == 0


def test_matrix_keeps_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("".join(f"{i},{i * 2}\n" for i in range(50)))
    got = telemetry.read_matrix(spark, str(tmp_path / "m.csv"), ["a", "b"]).orderBy("t").collect()
    assert [(r.t, r.a, r.b) for r in got] == [(i, float(i), 2.0 * i) for i in range(50)]


def test_quarantine(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0, 2.0]]), (3, [[1.0], [1.0, 2.0]]), (4, [[1.0, float("nan")], [1.0, 1.0]]), (5, None)]
    got = {r.window_id: r.reason for r in windows.quarantine(spark.createDataFrame(rows, "window_id int, values array<array<double>>"), 2, 2).collect()}
    assert got == {1: None, 2: "too_few_rows", 3: "not_rectangular", 4: "not_finite", 5: "too_few_rows"}


def test_json_payload(spark):
    rows = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('say {"a": {"b": 2}} end',), (" plain ",)], "t string")
    assert [r[0] for r in rows.select(text.json_payload(F.col("t"))).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', "plain"]
