"""Connected components as DataFrame plans: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first()
    return tuple(row)


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round. Large star: larger neighbours of a node go to its least one; small star: smaller ones do."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if small:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = moved.where(F.col("u") != F.col("v"))
    return moved.distinct() if small else moved


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least reachable node of every node that an edge names.

    ``edges``: columns u and v of one orderable type; direction, order, repeats, loops and nulls don't
    matter (rows with a null are ignored, loops give their node's own component). Returns node, component.
    Each round is written to the shared folder; a group's size never meets in one task but as a minimum.
    """
    named = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = named.select(F.col("u").alias("node")).unionByName(named.select(F.col("v").alias("node"))).distinct()
    now = keep(named.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = keep(_stars(_stars(now, small=False), small=True), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components didn't settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").groupBy("node").agg(
        F.least(F.coalesce(F.min("c"), F.first("node")), F.first("node")).alias("component")
    )
