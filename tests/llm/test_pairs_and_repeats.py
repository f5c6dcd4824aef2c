"""N-gram join, substring dedup and decontamination against brute force, with nulls, ties and hot groups."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vantarow.llm import decontaminate, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, n int, signature string, prefix string, head string, spans string, target string"


def corpus(seed=0, n=60, words=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.3:
            w = r.choice(texts).split()
            for _ in range(r.choice((0, 1, 2, 6))):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.choice((1, 4, 5, 40, 90)))))
    passage = " ".join(r.choice(vocabulary) for _ in range(50))
    texts += [f"{' '.join(r.choice(vocabulary) for _ in range(30))} {passage}" for _ in range(6)]
    return texts + ["", "  \t ", None, "Ab CD ef gh ij kl", "ab cd EF gh ij kl", "Éa b c d e f"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i, "x", "y", "z", "s", "t") for i, t in enumerate(texts)], SCHEMA)


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def got_components(spark, texts, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts), **settings).collect()}


def test_components(spark):
    texts = corpus()
    assert got_components(spark, texts) == brute_components(texts)


def test_components_of_dense_columns(spark):
    """Every column counts as dense: neighbours are linked first, and what stays apart is compared again."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for k in range(24):
        w = list(base)
        for j in r.sample(range(100), r.choice((0, 1, 2))):
            w[j] = f"x{k}_{j}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:80] + [f"y{k}_{i}" for i in range(30)]) for k in range(5)]
    for settings in ({"dense": 2}, {"dense": 3, "least": 2, "everywhere": 3}):
        assert got_components(spark, texts, **settings) == brute_components(texts)


def near_copies(n, words=60, seed=8):
    """Copies of one text with one to three words changed, many of them below the threshold to each other, among others that share a passage."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for k in range(n):
        w = list(base)
        for j in r.sample(range(words), r.choice((1, 1, 2, 3))):
            w[j] = f"x{k}_{j}"
        texts.append(" ".join(w))
    return texts + [" ".join(base[: words // 2] + [f"y{k}_{i}" for i in range(words // 2)]) for k in range(n // 8)]


def test_large_groups_of_near_copies_stay_linear(spark, monkeypatch):
    """No step puts out more than a few rows for each place of a document in the matrix, though nearly all pairs are near."""
    texts = near_copies(500)
    steps: dict[str, list[int]] = {}
    kept = ngram_join.keep

    def counted(df, name):
        out = kept(df, name)
        steps.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    assert got_components(spark, texts) == brute_components(texts)
    assert max(steps["cells"]) <= 12 * len(texts)
    assert max(max(steps[k]) for k in ("forest", "candidates", "keyed", "wanted", "links")) <= 4 * len(texts)


def test_columns_with_equal_rows_are_one(spark, monkeypatch):
    """Pairs of near copies share dozens of columns that hold these two rows alone: one of them is used, and no link is lost."""
    r = random.Random(12)
    texts = []
    for k in range(150):
        w = [f"p{k}_{i}" for i in range(200)]
        v = list(w)
        for j in r.sample(range(200), r.choice((1, 2, 3, 4, 5))):
            v[j] = f"q{k}_{j}"
        texts += [" ".join(w), " ".join(v)]
    cells, kept = [], ngram_join.keep

    def counted(df, name):
        out = kept(df, name)
        if name == "cells":
            cells.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    assert got_components(spark, texts) == brute_components(texts)
    assert max(cells) <= 2 * len(texts)


def test_the_first_of_columns_with_equal_rows_stays(spark):
    """The one with the least places; columns over the bound (with a name of their own) all stay, as do parts of one."""
    columns = [
        (50, None, 0, 1, [1, 2, 3], [9, 9, 8], [4, 3, 1]), (60, None, 0, 1, [1, 2, 3], [9, 9, 8], [2, 1, 0]), (40, None, 0, 1, [1, 2, 3], [9, 9, 8], [3, 2, 1]),
        (70, None, 0, 1, [1, 2], [9, 9], [5, 5]),
        (80, 80, 0, 2, [1, 2, 3], [9, 9, 8], [6, 6, 3]), (80, 80, 1, 2, [1, 2, 3], [9, 9, 8], [6, 6, 3]), (90, 90, 0, 1, [1, 2, 3], [9, 9, 8], [7, 7, 4]),
    ]
    got = sorted(tuple(r) for r in ngram_join._unlike(spark.createDataFrame(columns, ngram_join._COLUMNS)).collect())
    assert got == sorted((g, part, parts, *cell) for k, (g, _, part, parts, *lists) in enumerate(columns) if k not in (0, 2) for cell in zip(*lists))


def test_pairs_at_the_threshold(spark):
    """Similarities of the threshold and just below it."""
    r = random.Random(13)
    texts = []
    for k in range(80):
        n = r.randrange(40, 90)
        shared = [f"s{k}_{i}" for i in range(n + 4)]
        own = n // 4 + r.choice((-1, 0, 0, 1, 2))
        left = r.randrange(own + 1)
        texts += [" ".join([f"l{k}_{i}" for i in range(left)] + shared), " ".join(shared + [f"r{k}_{i}" for i in range(own - left)])]
    want = brute_components(texts)
    assert 0.2 * len(texts) < sum(c != i for i, (_, c) in want.items()) < 0.45 * len(texts)
    for settings in ({}, {"dense": 2}, {"column": 2, "everywhere": 2}):
        assert got_components(spark, texts, **settings) == want


def test_components_of_cut_columns(spark):
    """Columns of over eight rows are cut into parts; what lies outside the largest component meets every part."""
    texts = near_copies(60)
    assert got_components(spark, texts, column=8, everywhere=4) == brute_components(texts)


def test_parts_of_cut_columns_stay_linear(spark, monkeypatch):
    """Short pages of one template with a word of their own: no two can reach the threshold, so no row is sent to other parts."""
    rows = {}
    for n in (500, 1000, 2000):
        made = []
        meet = ngram_join._meet_parts
        monkeypatch.setattr(ngram_join, "_meet_parts", lambda *a, made=made, meet=meet: made.append(meet(*a)) or made[-1])
        texts = [f"the page you asked for own{k} is not here any more" for k in range(n)]
        got = got_components(spark, texts, column=64, everywhere=4)
        assert all(c == k for k, (_, c) in got.items())
        rows[n] = made[0].count() if made else 0
        monkeypatch.setattr(ngram_join, "_meet_parts", meet)
    assert rows[1000] <= 2.2 * max(rows[500], 500) and rows[2000] <= 2.2 * max(rows[1000], 1000)


def test_components_of_repeated_rows(spark):
    """A repeated row comes out as often as it goes in; its copies are one document."""
    texts = corpus(3, n=20)
    want = brute_components(texts)
    rows = frame(spark, texts).unionByName(frame(spark, texts[:9]))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(rows).collect()]
    assert sorted(got) == sorted([(k, *v) for k, v in want.items()] + [(k, *want[k]) for k in range(9)])


def test_components_of_nothing(spark):
    assert got_components(spark, []) == {}
    assert got_components(spark, [None, ""]) == {0: (0, 0), 1: (0, 1)}


def test_repeats(spark):
    texts = corpus(1) + [corpus(1)[0] or "a", " ".join(["a"] * 80), "b " * 36]
    for length in (35, 6):
        counts, words = Counter(), [(t or "").encode().split() for t in texts]
        for w in words:
            counts.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
        want = {}
        for k, w in enumerate(words):
            gone = set()
            for i in range(len(w) - length + 1):
                if counts[tuple(w[i : i + length])] > 1:
                    gone.update(range(i, i + length))
            kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
            want[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup.remove_repeats(frame(spark, texts), length).collect()}
        assert got == want
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_shuffle_joins_take_the_place_of_broadcasts(spark, monkeypatch):
    texts = corpus(2, n=30)
    want = got_components(spark, texts)
    kept = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(frame(spark, texts), 6).collect()}
    monkeypatch.setattr(ngram_join, "MAX_IDS", 0)
    monkeypatch.setattr(substring_dedup, "MAX_BROADCAST", 0)
    assert got_components(spark, texts) == want
    assert {r.doc_id: r.kept for r in substring_dedup.remove_repeats(frame(spark, texts), 6).collect()} == kept


def brute_tiles(text, item, least):
    free_text, free_item, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and free_text[i + n] and free_item[j + n] and text[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < least:
            return out
        out.append((i, j, n))
        for k in range(n):
            free_text[i + k] = free_item[j + k] = False


def test_tiles():
    r = random.Random(3)
    for _ in range(200):
        text = [r.randint(1, r.choice((2, 8))) for _ in range(r.randint(0, 50))]
        item = [r.randint(1, 8) for _ in range(r.randint(1, 20))]
        text[10:10] = item[len(item) // 2 :] + item[: len(item) // 2]
        least = min(r.choice((1, 2, 3, 5)), len(item))
        assert decontaminate.tiles(np.array(text, np.uint64), np.array(item, np.uint64), least, 8) == brute_tiles(text, item, least)


def test_leaks(spark, monkeypatch):
    r = random.Random(4)
    items = [" ".join(f"q{k}_{r.randint(0, 30)}" for _ in range(30)) for k in range(6)] + ["one two three", "", None]
    w = items[0].split()
    texts = [f"x y z {items[0]} tail", items[0].upper().replace(" ", ", "), " ".join(w[15:] + ["between"] * 9 + w[:15]), " ".join(w[:10]), "nothing at all", "", None, "say one two three now", items[1] + " " + items[2]]
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)] + [(0, items[0], "c")], "item_id long, text string, doc_id string")
    want = {(0, 0), (1, 0), (2, 0), (7, 6), (8, 1), (8, 2)}
    for size in (decontaminate.BLOCK_CHARS, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, texts), bench).collect()} == want
    left = {x.doc_id for x in decontaminate.clean_ones(frame(spark, texts), bench).collect()}
    assert left == {3, 4, 5, 6}
    assert decontaminate.leaks(frame(spark, texts), bench.where(F.lit(False))).count() == 0
