from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vantarow.operators import agents, classify, evaluate, response, series
from vantarow.sinks import store
from vantarow.sources import files


def test_answers_are_validated_and_asked_for_once_more(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "first bad"), (3, "never")], "i int, prompt string")

    def provider(prompt):
        return F.when(prompt.startswith("ok") | (prompt.startswith("first") & prompt.contains("could not be used")), '{"rating": "low", "more": 1}').when(prompt.startswith("first"), "{}").otherwise('{"rating": "none"}')

    got = {r.i: r for r in agents.answered(rows, provider, agents.RATING).collect()}
    assert [got[i].attempts for i in (1, 2, 3)] == [1, 2, 2]
    assert got[1].value.rating == got[2].value.rating == "low" and got[3].value is None and "none" in got[3].error


def test_providers_in_turn_and_unavailable(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,)], "turn int").withColumn("prompt", F.lit("p"))
    got = rows.select(agents.in_turn(["a", "b"], F.col("turn"))(F.col("prompt")).alias("r"), agents.unavailable(F.col("prompt")).alias("u")).collect()
    assert [r.r for r in got] == ["a", "b", None] and {r.u for r in got} == {None}


def test_triage_and_plans_degrade(spark):
    windows = spark.createDataFrame([(1, None, 0.5), (2, None, 2.0), (3, "not_finite", 9.0), (4, None, 1.0), (5, None, None)], "window_id int, reason string, score double")
    causes = spark.createDataFrame([(1, "x", 0.9), (4, "y", 0.8)], "window_id int, cause string, probability double")
    got = {r.window_id: (r.status, r.cause) for r in agents.triage(windows, F.lit(1.0), causes).collect()}
    assert got == {1: ("calm", None), 2: ("incident", None), 3: ("rejected", None), 4: ("incident", "y"), 5: ("rejected", None)}
    plan = agents.remediate(spark.createDataFrame([(1, "c", "e", None)], "incident_id int, cause string, explanation string, passages string"), agents.unavailable).first()
    assert (plan.action, plan.risk_level, plan.degraded) == (None, "high", True)


def test_decisions_resume_once(spark):
    states = spark.createDataFrame([(1, 1, "awaiting_approval"), (2, 1, "awaiting_approval"), (3, 1, "complete")], "thread_id int, version int, status string")
    decisions = spark.createDataFrame([(1, "reject", "b", 20), (1, "approve", "a", 10), (3, "reject", "a", 5)], "thread_id int, decision string, principal string, at int").withColumn("claimed_at", F.timestamp_seconds("at"))
    got = {r.thread_id: (r.version, r.status, r.principal) for r in agents.resume(states, decisions).collect()}
    assert got == {1: (2, "complete", "a"), 2: (1, "awaiting_approval", None), 3: (1, "complete", None)}


def test_json_strings_are_those_of_python(spark):
    texts = ["plain", 'q"b\\', "line\nret\rtab\tbell\x07\x08\x0c\x7f", "é € 😀", "", "a/b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", response.json_string(F.col("t")).alias("j")).collect()
    assert {r.i: r.j for r in rows} == {i: json.dumps(t) for i, t in enumerate(texts)}


def test_series_scaler_and_states_are_read_as_written(spark, tmp_path):
    points = spark.createDataFrame([("a", "train", 0, 1.0), ("a", "test", 0, 2.0)], "series_id string, split string, t int, x double")
    incidents = spark.createDataFrame([(0, "a", "test", 0, 1)], "event_id int, series_id string, split string, start int, end int")
    store.write_series(points, incidents, str(tmp_path / "s"))
    kept, found = store.read_series(spark, str(tmp_path / "s"), "test")
    assert [r.x for r in kept.collect()] == [2.0] and found.count() == 1
    old = spark.createDataFrame([("b", 1.0, 2.0), ("a", 0.0, 1.0)], "metric string, mean double, std double")
    old.write.parquet(str(tmp_path / "old"))
    assert [(r.position, r.metric) for r in store.load_scaler(spark, str(tmp_path / "old")).orderBy("position").collect()] == [(0, "a"), (1, "b")]
    for version in (1, 3, 2):
        store.write_checkpoints(spark.createDataFrame([("t", version)], "thread_id string, version int"), str(tmp_path / "c"))
    assert store.latest_states(spark.read.parquet(str(tmp_path / "c"))).first().version == 3


def test_updates_of_a_stream_are_written_by_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"node": "triage"}\n{"node": "report"}\n')
    stream = spark.readStream.schema("node string").json(str(source))
    store.stream_updates(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.node for r in spark.read.json(str(tmp_path / "out")).collect()) == ["report", "triage"]


def test_pages_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("bm25", 0.5, None)], "name string, hit double, note string")
    table = store.markdown_table(rows, ["name", "hit", "note"])
    assert table == "| name | hit | note |\n|---|---|---|\n| bm25 | 0.500 |  |"
    store.write_page(spark, "Report", table, str(tmp_path / "page"))
    assert [r.value for r in spark.read.text(str(tmp_path / "page")).collect()][0] == "# Report"


def test_machines(spark, tmp_path):
    for name in ("train", "test", "test_label", "interpretation_label"):
        (tmp_path / name).mkdir()
    (tmp_path / "train/m.txt").write_text("1,2\n3,4\n")
    (tmp_path / "test/m.txt").write_text("5,6\n7,8\n9,10\n")
    (tmp_path / "test_label/m.txt").write_text("0\n1\n0\n")
    (tmp_path / "interpretation_label/m.txt").write_text("1-2:2,1\n")
    points, spans = files.load_machines(spark, str(tmp_path), ["m"], ["a", "b"])
    assert sorted((r.series_id, r.t, r.a, r.point_label) for r in points.collect()) == [("m/test", 0, 5.0, 0), ("m/test", 1, 7.0, 1), ("m/test", 2, 9.0, 0), ("m/train", 0, 1.0, 0), ("m/train", 1, 3.0, 0)]
    assert spans.first().dims == [1, 2]
    (tmp_path / "test_label/m.txt").write_text("0\n")
    with pytest.raises(ValueError):
        files.load_machine(spark, str(tmp_path), "m", ["a", "b"])


def test_selection(spark):
    runs = spark.createDataFrame([(1, e, x) for e, x in enumerate([5.0, 3.0, 4.0, 3.0, 2.0])], "run int, epoch int, error double")
    assert [(r.best, r.waited) for r in evaluate.patience(runs).orderBy("epoch").collect()] == [(5.0, 0), (3.0, 0), (3.0, 1), (3.0, 2), (2.0, 0)]
    for bad in ((0.9, 0.2), (0.0, 0.5), (0.5, 1.0)):
        with pytest.raises(ValueError):
            series.checked_fractions(*bad)
    votes = spark.createDataFrame([(i, "a" if i % 2 else "b", "a" if i % 2 else "b") for i in range(10)], "key int, truth string, predicted string")
    assert tuple(classify.macro_f1_interval(votes, 20).first()) == (1.0, 1.0)
    assert files.settings(spark, {"threshold": "0.5"}) == {"threshold": "0.5"}


def test_no_event_is_left_out_of_the_clusters(spark):
    """Signatures beyond the fit's bound join the nearest cluster."""
    rows = spark.createDataFrame([(i, [1, 1, 0, 0]) for i in range(5)] + [(i, [0, 0, 1, 1]) for i in range(5, 9)] + [(9, [1, 0, 0, 0]), (10, [0, 0, 0, 1])], "event_id int, signature array<int>")
    for limit in (2, 5000):
        got = {r.event_id: r.cluster for r in classify.archetype_clusters(rows, 2, limit).collect()}
        assert len(got) == 11 and got[9] == got[0] != got[5] == got[10]


def test_classes_default_and_seeds_have_families(spark):
    rows = classify.with_class(spark.createDataFrame([(1,), (2,)], "event_id int"), spark.createDataFrame([(1, "disk")], "event_id int, label string"))
    assert {r.event_id: r.cause for r in rows.collect()} == {1: "disk", 2: "other"}
    reports = spark.createDataFrame([("a[s1]", 0.5, 0.1, 0.5, 0.0, 9.0), ("a[s2]", 0.7, 0.0, 0.5, 0.6, None), ("b", 0.7, 0.3, 0.0, 0.0, 3.0)], "detector string, curve_auc double, pre_alarmed_share double, detection_rate double, worst_duty double, median_minutes double")
    spread = evaluate.seed_spread(reports).collect()
    assert [(r.family, r.runs, round(r.mean_auc, 6), round(r.spread, 6)) for r in spread] == [("a", 2, 0.6, 0.2)]
    assert [r.detector for r in evaluate.standing_alarms(reports).collect()] == ["a[s2]"] and evaluate.chosen_detector(reports).first().detector == "b"


def test_command_line(spark, tmp_path, capsys):
    from vantarow.__main__ import main

    main(["--list"])
    assert "triage" in capsys.readouterr().out.split()
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "event_type string, value double").write.parquet(str(tmp_path / "t/events.parquet"))
    main(["event_counters", str(tmp_path / "t"), "--out", str(tmp_path / "out")])
    assert {(r.name, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(SystemExit):
        main(["event_counters"])
