"""Manifest of a dataset as a Merkle tree: a node store of sorted Parquet levels, proofs by coordinate, verification."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.llm.common import keep, shared_dir
from vantarow.llm.order import counted, sums_before

#: Nodes that become one of the next level, and bytes of a digest.
FANOUT, WIDTH = 16, 32
PATH = "array<struct<left: binary, right: binary>>"


def _text(digest: Column) -> Column:
    """Digests enter other digests as lowercase hex text."""
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    """A value so that no two sequences of values concatenate alike: ``-`` if null, else its bytes' number, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """The leaf of a row: SHA-256 (binary) of its values in order."""
    return _hash(F.concat(*[field(v) for v in values]))


@dataclass
class Manifest:
    """A written tree of trees: ``levels`` of the groups' trees, ``tops`` of the tree over groups, and its ``root``."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame
    root: str | None


def _levels(nodes: DataFrame, payload: list[str], most: int, where: str) -> list[DataFrame]:
    """Write the levels above ``nodes`` (tree, pos, n: nodes of the tree, digest, payload) under ``where``; ``most``: largest n.

    A row of level k is a node: its place, its digest, and ``kids``, the nodes of the level below that it covers (their
    payload in level 1 only), with their digests as one value, ``row``. A tree ends at the level where it has one node.
    """
    spark, levels = nodes.sparkSession, []
    while True:
        kid = F.struct("pos", "digest", *(payload if not levels else []))
        grouped = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos"), "n").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        row = F.unhex(F.array_join(F.transform("kids", lambda k: F.hex(k["digest"])), ""))
        above = grouped.withColumn("row", row).withColumn("lone", F.col("n") == 1)
        above = above.withColumn("digest", F.when(F.col("lone"), F.col("row")).otherwise(_hash(_text(F.col("row")))))
        above = above.withColumn("n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}"))
        path = f"{where}/level={len(levels) + 1}"
        above.sortWithinPartitions("tree", "pos").write.parquet(path)
        levels.append(spark.read.schema(above.schema).parquet(path))
        most = -(-most // FANOUT)
        if most <= 1:
            return levels
        nodes = levels[-1].where("n > 1").select("tree", "pos", "n", "digest")


def _roots(levels: list[DataFrame]) -> DataFrame:
    """The last node of each tree and its level."""
    found = [t.where("n = 1").select("tree", F.lit(k).alias("level"), "digest") for k, t in enumerate(levels, 1)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def build(leaves: DataFrame, payload: tuple[str, ...] = ()) -> Manifest:
    """Write the tree of ``leaves``: doc_id (long), source (string), leaf (binary) and the columns of ``payload``.

    Leaves of a source ascend by doc_id (null first, rows that tie by leaf); sources ascend bytewise, null first.
    Every ``FANOUT`` consecutive nodes become the digest of their digests, until one remains. Sorting runs over ranges
    of (source, doc_id), so a source of any share is dealt over many tasks; levels are read one after the other.
    """
    spark = leaves.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/merkle-{uuid.uuid4().hex}"
    named = leaves.select("doc_id", "source", "leaf", *payload, F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("given"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("given").asc()]
    ranked = sums_before(named, order, ("one",), "runs").withColumn("tree", field(F.col("source")))
    sizes = keep(ranked.groupBy("tree").agg(F.min("one_before").alias("first"), F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "trees")
    most, trees = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    if not trees:
        return Manifest([], [], spark.createDataFrame([], "tree string, level int, digest binary"), None)
    nodes = ranked.join(counted(sizes.select("tree", "first", "n")), "tree")
    nodes = nodes.select("tree", (F.col("one_before") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", *payload)
    levels = _levels(nodes, ["doc_id", *payload], most, f"{where}/leaves")
    subroots = keep(_roots(levels), "subroots")
    place = sums_before(sizes.select("tree", "source", F.lit(1).cast("long").alias("one")), [F.col("source").asc_nulls_first()], ("one",), "places")
    over = subroots.join(place, "tree").select(F.lit("").alias("tree"), F.col("one_before").alias("pos"), F.lit(trees).cast("long").alias("n"), "digest", F.col("tree").alias("name"))
    tops = _levels(over, ["name"], trees, f"{where}/sources")
    root = bytes(_roots(tops).first()["digest"]).hex()
    return Manifest(levels, tops, subroots, root)


def _descend(levels: list[DataFrame], known: DataFrame) -> DataFrame:
    """Bring the siblings of every node down to the lowest level; ``known``: tree, level, subroot, path of the last nodes.

    Level by level a node meets its row by coordinate (a merge join of two tables sorted by tree and pos); the row's kids
    get their siblings in front of the path of the row.
    """
    now = None
    for k in range(len(levels), 0, -1):
        own = known.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "path")
        now = own if now is None else now.select(*own.columns).unionByName(own)
        held = levels[k - 1].select("tree", "pos", "lone", "kids", "row").hint("merge").join(now, ["tree", "pos"])
        each = held.select("tree", "lone", "subroot", "path", "row", F.posexplode("kids").alias("i", "kid"))
        beside = F.struct(F.expr(f"substring(row, 1, {WIDTH} * i)").alias("left"), F.expr(f"substring(row, {WIDTH} * (i + 1) + 1)").alias("right"))
        longer = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(beside), F.col("path"))).alias("path")
        now = each.select("tree", "kid.*", "subroot", longer)
    return now


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its payload, its source's ``subroot`` and its ``path``: the siblings left and right of it, per level up to the root.

    Returns tree, pos, digest, doc_id, payload, subroot, path (digests are binary).
    """
    spark = manifest.subroots.sparkSession
    start = spark.createDataFrame([("", len(manifest.tops), bytes.fromhex(manifest.root), [])], f"tree string, level int, subroot binary, path {PATH}")
    over = _descend(manifest.tops, start).select(F.col("name").alias("tree"), "path")
    known = keep(manifest.subroots.withColumnRenamed("digest", "subroot").join(over, "tree"), "paths")
    return _descend(manifest.levels, known)


def siblings(path: Column) -> Column:
    """All siblings of a path as text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(_text(x["left"]), _text(x["right"]))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (binary) and its path lead to."""
    return F.aggregate(path, _text(leaf), lambda below, x: F.sha2(F.concat(_text(x["left"]), below, _text(x["right"])), 256))


def verify(documents: DataFrame, claimed: Column) -> DataFrame:
    """Build the manifest of ``documents`` and check, for every row, the proof of its text against another, ``claimed`` one.

    ``documents``: doc_id, source, lang, n_chars, text; other columns are ignored, whatever their names. Nulls in any column
    enter the leaf as ``-``, empty texts as ``0:``; rows with a null doc_id are leaves too, first of their source; repeated
    rows are a leaf each; an empty table gives an empty result. ``claimed``: expression over those five columns (null where
    nothing is claimed: the text itself counts). Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"),
    )
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claim = F.when(claimed.isNotNull(), digest(*rest, claimed))
    leaves = keep(docs.select("doc_id", "source", digest(*rest, F.col("text")).alias("leaf"), claim.alias("claim")), "leaves")
    manifest = build(leaves, ("claim",))
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    found = proofs(manifest).select(
        "doc_id", _text(F.col("digest")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), F.lit(manifest.root).alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("claim", "digest"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``; a fifth of the ids claims its text in lower case; see :func:`verify`."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.when(chosen, lowered))


def _sql(levels: int) -> str:
    """DuckDB SQL for trees of at most FANOUT ** ``levels`` nodes."""
    value = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({value('doc_id')} || {value('source')} || {value('lang')} || {value('n_chars')} || {text})"
    lowered = value("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    # bit by bit: a number of 0 to 255 enters a byte, -1 stands for a step
    bits = "list_concat([4294967295], flatten(list_transform(range(1, 1 + length(doc_id::varchar)), lambda i: [ascii(substr(doc_id::varchar, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}::bigint[], lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
    parts = [
        f"docs as (select doc_id, source, {leaf(value('text'))} as d, case when {crc} % 5 = 0 then {leaf(lowered)} end as claim from documents)",
        "t0 as (select source as tree, doc_id, claim, d, row_number() over (partition by source order by doc_id nulls first, d) - 1 as pos, count(*) over (partition by source) as n from docs)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            run = "partition by tree, pos // 16 order by pos rows between"
            parts.append(
                f"{name}s{k} as (select *, case when n = 1 then '' else coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') end as l, "
                f"case when n = 1 then '' else coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') end as r from {name}{k})"
            )
            parts.append(f"{name}{k + 1} as (select tree, pos // 16 as pos, (any_value(n) + 15) // 16 as n, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by pos)) end as d from {name}{k} group by tree, pos // 16)")

    climb("t")
    parts.append(f"u0 as (select 0 as tree, tree as name, d, row_number() over (order by tree nulls first) - 1 as pos, count(*) over () as n from t{levels})")
    climb("u")
    steps = [f"ts{k}" for k in range(levels)] + [f"us{k}" for k in range(levels)]
    joins, fold_, beside = "ts0", "coalesce(ts0.claim, ts0.d)", []
    for k, s in enumerate(steps):
        if s == "us0":
            joins += " join us0 on us0.name is not distinct from ts0.tree"
        elif k:
            base, j = s[0] + "s0", int(s[2:])
            joins += f" join {s} on {s}.tree is not distinct from {base}.tree and {s}.pos = {base}.pos // {FANOUT**j}"
        beside.append(f"{s}.l || {s}.r")
        fold_ = f"case when {s}.n = 1 then {fold_} else sha256({s}.l || {fold_} || {s}.r) end"
    # nested cases double at every step, so folds are columns one after the other
    chain = [f"f0 as (select ts0.doc_id, ts0.d as leaf, us0.d as subroot, sha256({' || '.join(beside)}) as proof_sha256, coalesce(ts0.claim, ts0.d) as f, [{', '.join(f'{{n: {s}.n, l: {s}.l, r: {s}.r}}' for s in steps)}] as path from {joins})"]
    for k in range(len(steps)):
        chain.append(f"f{k + 1} as (select * replace (case when path[{k + 1}].n = 1 then f else sha256(path[{k + 1}].l || f || path[{k + 1}].r) end as f) from f{k})")
    final = f"select doc_id, leaf, subroot, u{levels}.d as root, proof_sha256, f as folded_root, f = u{levels}.d as verified from f{len(steps)}, u{levels}"
    return "with " + ", ".join(parts + chain) + " " + final


ORACLE = _sql(3)
