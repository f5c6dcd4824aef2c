"""Models on disk with a specification that a load checks: features in order, classes, geometry of the windows, layout version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from vantarow.operators.boosting import Booster
from vantarow.operators.series import Geometry

VERSION = 1


class Mismatch(ValueError):
    """A saved model isn't the one that the caller expects."""


def _write(spark: SparkSession, path: str, spec: dict, body: str) -> None:
    rows = spark.createDataFrame([("spec", json.dumps(spec, sort_keys=True)), ("model", body)], "part string, value string")
    rows.coalesce(1).write.parquet(path)


def read_spec(spark: SparkSession, path: str) -> tuple[dict, str]:
    parts = {r["part"]: r["value"] for r in spark.read.parquet(path).collect()}
    return json.loads(parts["spec"]), parts["model"]


def check(spec: dict, kind: str, features: list[str] | None, geometry: Geometry | None, labels: list[str] | None) -> None:
    """Raise :class:`Mismatch` that names the first thing that differs."""
    if spec.get("version") != VERSION:
        raise Mismatch(f"layout {spec.get('version')} of the model isn't {VERSION}")
    if spec["kind"] != kind:
        raise Mismatch(f"a {spec['kind']} model, not {kind}")
    if features is not None and list(features) != spec["features"]:
        given = list(features)
        at = next((i for i, (a, b) in enumerate(zip(given, spec["features"])) if a != b), min(len(given), len(spec["features"])))
        raise Mismatch(f"features differ from place {at} on: the model has {spec['features'][at : at + 1]}, the caller {given[at : at + 1]}")
    if geometry is not None and spec["geometry"] != [geometry.window, geometry.stride]:
        raise Mismatch(f"fitted on windows of {spec['geometry']}, not of {[geometry.window, geometry.stride]}")
    if labels is not None and sorted(labels) != sorted(spec["labels"]):
        raise Mismatch(f"classes {spec['labels']} aren't {sorted(labels)}")


def save_booster(spark: SparkSession, model: Booster, path: str, geometry: Geometry) -> None:
    spec = {"version": VERSION, "kind": "boosted_trees", "features": list(model.columns), "labels": list(model.labels), "geometry": [geometry.window, geometry.stride]}
    _write(spark, path, spec, json.dumps(model.to_dict()))


def load_booster(spark: SparkSession, path: str, features: list[str] | None = None, geometry: Geometry | None = None, labels: list[str] | None = None) -> Booster:
    """A saved model; features in another order or of other names, other windows or other classes are refused."""
    spec, body = read_spec(spark, path)
    check(spec, "boosted_trees", features, geometry, labels)
    model = Booster.from_dict(json.loads(body))
    if list(model.columns) != spec["features"] or list(model.labels) != spec["labels"]:
        raise Mismatch("the model's own features or classes aren't those of its specification")
    return model


def save_pipeline(model, path: str, features: list[str], labels: list[str], geometry: Geometry) -> None:
    """A fitted Spark ML pipeline and its specification, in two folders under ``path``."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/pipeline")
    _write(spark, f"{path}/spec", {"version": VERSION, "kind": "pipeline", "features": list(features), "labels": list(labels), "geometry": [geometry.window, geometry.stride]}, "")


def load_pipeline(spark: SparkSession, path: str, features: list[str] | None = None, geometry: Geometry | None = None, labels: list[str] | None = None):
    from pyspark.ml import PipelineModel

    spec, _ = read_spec(spark, f"{path}/spec")
    check(spec, "pipeline", features, geometry, labels)
    return PipelineModel.load(f"{path}/pipeline")


def save_arrays(spark: SparkSession, path: str, kind: str, features: list[str], geometry: Geometry, body: dict, history: DataFrame | None = None) -> None:
    """A model of plain numbers (a network's weights), with the history of its fit as a table beside it."""
    _write(spark, f"{path}/model", {"version": VERSION, "kind": kind, "features": list(features), "labels": [], "geometry": [geometry.window, geometry.stride]}, json.dumps(body))
    if history is not None:
        history.write.parquet(f"{path}/history")


def load_arrays(spark: SparkSession, path: str, kind: str, features: list[str] | None = None, geometry: Geometry | None = None) -> dict:
    spec, body = read_spec(spark, f"{path}/model")
    check(spec, kind, features, geometry, None)
    return json.loads(body)
