"""Machines in one scan: many files and blocks, pruned metrics and machines, event ids over all machines."""

from __future__ import annotations

import pytest

from vantarow.sources import machines


def layout(root, sizes, width=3):
    """Files of numbered rows; every 7th test step is labelled, and the step after it."""
    for part in machines.PARTS:
        (root / part).mkdir()
    for k, (name, n) in enumerate(sizes.items()):
        rows = [[k * 1000 + t + j / 10 for j in range(width)] for t in range(n)]
        text = "\n".join(",".join(map(str, r)) for r in rows)
        (root / f"train/{name}.txt").write_text(text + "\n")
        (root / f"test/{name}.txt").write_text(text)
        (root / f"test_label/{name}.txt").write_text("\n".join(str(int(t % 7 in (3, 4))) for t in range(n)) + "\n")
        (root / f"interpretation_label/{name}.txt").write_text("2-4:3,1\n\nnothing\n4-11:2\n")


SIZES = {"m-2": 900, "m-1": 15, "m-10": 400}


def test_rows_keep_their_numbers_over_blocks(spark, tmp_path):
    layout(tmp_path, SIZES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = machines.read_machines(spark, str(tmp_path), ["a", "b", "c"])
        got = {(r.series_id, r.t): (r.a, r.c, r.point_label) for r in found.points.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for k, (name, n) in enumerate(SIZES.items()):
        for t in range(n):
            want[(f"{name}/train", t)] = (k * 1000.0 + t, k * 1000 + t + 0.2, 0)
            want[(f"{name}/test", t)] = (k * 1000.0 + t, k * 1000 + t + 0.2, int(t % 7 in (3, 4)))
    assert got == want


def test_event_ids_follow_the_order_of_machines(spark, tmp_path):
    layout(tmp_path, SIZES)
    for order in (None, ["m-2", "m-10"]):
        found = machines.read_machines(spark, str(tmp_path), ["a", "b", "c"], order)
        rows = found.incidents.orderBy("event_id").collect()
        want = [(m, t, t + 2 if t + 1 < SIZES[m] else t + 1) for m in (order or sorted(SIZES)) for t in range(3, SIZES[m], 7)]
        assert [(r.series_id.removesuffix("/test"), r.start, r.end) for r in rows] == want and [r.event_id for r in rows] == list(range(len(want)))
        first = {r.start: r.dims for r in rows if r.series_id == "m-2/test"}
        assert first[3] == [1, 2, 3] and first[10] == [2] and first[17] == []
        assert {r.series_id for r in found.points.select("series_id").distinct().collect()} == {f"{m}/{s}" for m in (order or SIZES) for s in ("train", "test")}


def test_only_wanted_files_and_metrics_are_read(spark, tmp_path):
    layout(tmp_path, SIZES)
    (tmp_path / "test/m-2.txt").write_text("this would fail to parse\n")
    found = machines.read_machines(spark, str(tmp_path), ["a", "b", "c"], ["m-1"], ["b"])
    assert found.points.columns == ["series_id", "split", "t", "b", "point_label"] and found.points.count() == 30


def test_wrong_files(spark, tmp_path):
    layout(tmp_path, {"m": 10})
    with pytest.raises(FileNotFoundError, match="other"):
        machines.read_machines(spark, str(tmp_path), ["a", "b", "c"], ["m", "other"])
    with pytest.raises(Exception, match="another width"):
        machines.read_machines(spark, str(tmp_path), ["a", "b"])
    (tmp_path / "test_label/m.txt").write_text("0\n1\n")
    with pytest.raises(ValueError, match="m: 10 rows and 2 labels"):
        machines.read_machines(spark, str(tmp_path), ["a", "b", "c"])
