"""Every operator on nulls, empty and very long texts, repeated rows, ties, an empty table and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vantarow.llm import decontaminate, licence, lm_score, ngram_join, packing, pii, quality, secrets, substring_dedup, url_filter

#: Columns that operators make themselves come in beside the two that count.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, signature string, words string, found string, rule string, host string, path string, target string, notice string, gram long"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def long_text(seed=3, size=3_000_000):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out, n = [], 0
    while n < size:
        out.append(r.choice(words))
        n += len(out[-1]) + 1
    return " ".join(out)


LONG = long_text()
TEXTS = [
    (0, "one two three four five six seven. Released under the MIT License."), (1, ""), (2, None), (3, LONG), (4, " \t\n "), (5, f"x {ITEM} y"), (None, "no id but text me at bob@example.com"), (None, None), (6, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\""),
    (0, "one two three four five six seven. Released under the MIT License."), (7, "one two three four five six seven. Released under the MIT License."), (3, LONG), (1, ""),
]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(d, t, "en", "s", 1, 2, "s", "w", "f", "r", "h", "p", "t", "n", 3) for d, t in texts], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1, 0, "x"), (3, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def bench(spark):
    return spark.createDataFrame([(0, ITEM), (0, ITEM), (1, None), (None, ITEM), (2, "")], "item_id long, text string")


OPERATORS = {
    "op1": lambda df: licence.scan_licences(df, F.col("source")),
    "op2": lambda df: ngram_join.ngram_components(df),
    "op4": lambda df: quality.judge(df, labels(df.sparkSession)),
    "op5": lambda df: lm_score.score(df, labels(df.sparkSession)),
    "op6": lambda df: substring_dedup.remove_repeats(df),
    "op8": lambda df: pii.personal_data(df),
}
#: Which of them give rows with a null doc_id back; the others ignore those, as their docstrings say.
WITH_NULLS = {"op4", "op8"}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, name):
    """Repeated rows come out as often as they go in; null and empty texts have a row; null ids as documented."""
    got = Counter(r.doc_id for r in OPERATORS[name](documents(spark)).select("doc_id").collect())
    assert got == Counter(d for d, _ in TEXTS if d is not None or name in WITH_NULLS)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    rows = [(None, None), (0, None), (1, None)]
    got = Counter(r.doc_id for r in OPERATORS[name](documents(spark, rows)).select("doc_id").collect())
    assert got == Counter(d for d, _ in rows if d is not None or name in WITH_NULLS)


def test_long_and_repeated_texts_are_seen_whole(spark):
    df, n = documents(spark), len(LONG.split())
    stats = {r.doc_id: r for r in quality.text_stats(df).where("doc_id in (0, 3)").collect()}
    assert stats[3].n_words == n and stats[3].n_chars == len(LONG)
    shingles = len({tuple(w) for w in zip(*(LONG.split()[k:] for k in range(5)))})
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert linked[3] == (shingles, 3) and linked[7] == (linked[0][0], 0) and linked[1] == (0, 1)
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df, texts=False).collect()}
    assert left[3] == (n, n) and left[0] == left[7] == (12, 0)
    tokens = {r.doc_id: r.n_tokens for r in lm_score.score(df, labels(spark)).collect()}
    assert tokens[3] == n and tokens[2] == 0


def test_packing(spark):
    rows = packing.pack(documents(spark), packing.tokenizer_path(), size=512).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d for d, _ in TEXTS)
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 3)
    assert long[0][0] == 0 and sum(n for _, n in long) > 2 * len(LONG.split())
    bins = Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 512
    assert packing.pack(documents(spark, []), packing.tokenizer_path()).count() == 0


def test_decontamination(spark):
    found = decontaminate.leaks(documents(spark), bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(5, 0)}
    assert Counter(r.doc_id for r in decontaminate.clean_ones(documents(spark), bench(spark)).collect()) == Counter(d for d, _ in TEXTS if d != 5)
    assert decontaminate.leaks(documents(spark, []), bench(spark)).count() == 0


def test_secrets(spark):
    rows = secrets.find_secrets(documents(spark), F.col("source")).collect()
    assert Counter(r.doc_id for r in rows) == Counter({6: 1})
    assert secrets.find_secrets(documents(spark, []), F.col("source")).count() == 0


def test_urls(spark):
    pages = [(1, "http://example.com/en/", "", "h"), (1, "http://example.com/en/", "", "h"), (2, None, None, "h"), (None, "http://a.net/es/" + "x" * 1_000_000, "<p>" * 300_000, "h"), (3, "", None, "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = Counter((r.page_id, r.verdict) for r in url_filter.filter_urls(df).collect())
    assert got == Counter({(1, "block"): 2, (2, "allow"): 1, (None, "block"): 1, (3, "allow"): 1})
    assert url_filter.filter_urls(df.where("false")).count() == 0


def test_ties(spark):
    """Of equal candidates the documented one counts: the first template, the longer span, the least doc_id; equal lengths pack alike."""
    twice = documents(spark, [(9, "Released under the MIT License. Released under the MIT License."), (8, "Released under the MIT License."), (4, "Released under the MIT License.")])
    assert {r.doc_id: (r.licence, r.n_notices) for r in licence.scan_licences(twice, F.col("source")).collect()} == {9: ("MIT", 2), 8: ("MIT", 1), 4: ("MIT", 1)}
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(twice).collect()}[8] == 4
    assert [x[2:4] for x in pii.find("my ssn 123-45-6789 here")[1]] == [("ssn", 18)]
    assert packing.complete({5: 4}, 10) in ([((5, 5), 2)], [((5, 5), 1), ((5, 5), 1)])


def test_filters_keep_all_columns(spark):
    df = documents(spark)
    one = ngram_join.one_of_each(df)
    assert one.columns == df.columns and Counter(r.doc_id for r in one.collect()) == Counter(d for d, _ in TEXTS if d != 7)
    good = quality.good_ones(df, labels(spark))
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} <= {None, 3}
    red = pii.redact(df)
    texts = [r.text for r in red.collect()]
    assert red.columns == df.columns and len(texts) == len(TEXTS) and "no id but text me at [EMAIL]" in texts and texts.count(None) == 2
    for keep in (ngram_join.one_of_each, pii.redact, lambda x: quality.good_ones(x, labels(spark))):
        assert keep(documents(spark, [])).count() == 0


def test_pipeline_of_nothing_and_of_oddities(spark, tmp_path):
    for name, texts in (("none", []), ("odd", TEXTS)):
        where = tmp_path / name
        documents(spark, texts).write.parquet(str(where / "documents.parquet"))
        labels(spark).write.parquet(str(where / "labels.parquet"))
        bench(spark).write.parquet(str(where / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(where)).collect()
        assert {r.doc_id for r in rows} == ({None, 3} if texts else set())  # rows without an id can't be named as rejected, they stay
