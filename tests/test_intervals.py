"""Interval joins and last values by buckets against loops over all pairs."""

from __future__ import annotations

import random

import pytest

from vantarow.operators import intervals


def spans(r, n, longest):
    out = []
    for i in range(n):
        start = r.randrange(-20, 200)
        out.append((r.choice("ab"), i, start, start + r.randrange(0, longest)))
    return out


@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_overlaps_equal_all_pairs(spark, width):
    r = random.Random(width)
    left, right = spans(r, 60, 50), spans(r, 40, 90)
    a = spark.createDataFrame(left, "k string, i int, start int, end int")
    b = spark.createDataFrame(right, "k string, j int, o_start int, o_end int")
    got = sorted((x.i, x.j) for x in intervals.overlaps(a, b, "k", width).collect())
    want = sorted((i, j) for k, i, s, e in left for m, j, c, d in right if k == m and s < e and c < d and s < d and c < e)
    assert got == want


@pytest.mark.parametrize("width", [1, 10, 500])
def test_last_before_equals_a_search(spark, width):
    r = random.Random(width)
    rows = [(r.choice("ab"), t, t % 3) for t in sorted(r.sample(range(300), 60))]
    points = [(i, r.choice("abc"), r.randrange(-10, 320)) for i in range(80)]
    p = spark.createDataFrame(points, "__id int, k string, upto int")
    got = {x["__id"]: x.found for x in intervals.last_before(p, spark.createDataFrame(rows, "k string, t int, v int"), "k", width, "t", "v", "upto", "found").collect()}
    assert got == {i: next((v for m, t, v in reversed(rows) if m == k and t <= upto), None) for i, k, upto in points}
