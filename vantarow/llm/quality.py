"""Quality rules: statistics of each text, and a decision list learned from labelled ones.

Statistics and verdicts are DataFrame expressions alone. The list is grown by sequential covering on a
bounded, hash-chosen sample of labelled statistics: each rule is a conjunction of thresholds, grown by
information gain on one part and pruned on the other, and becomes a branch of one CASE expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import keep

_SPACE = " \t\n\x0b\f\r"
#: The most labelled rows that a list is fitted on; statistics and verdicts always cover all rows.
MAX_LABELLED = 20_000
#: The most ids that are broadcast to drop rejected documents; beyond, a shuffle join takes their place.
MAX_IDS = 4_000_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_chars")


def text_stats(documents: DataFrame, mask: int = -1) -> DataFrame:
    """doc_id and the statistics of every text. Null and empty texts have none of anything.

    ``mask``: bits of a window's hash that are used; the counts are exact with any, fewer only cost time.
    """
    rows = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    inner = F.btrim("text", F.lit(_SPACE))
    rows = rows.select(
        "doc_id",
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length("text").cast("long").alias("n_chars"),
    )
    rows = rows.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.bin(F.size("words").cast("long"))).alias("bits"),
    ).drop("lines")
    # hash of each three-word window above, its place below: equal windows are neighbours once sorted
    windows = F.expr(
        "CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, size(words) - 3), i -> "
        f"shiftleft(xxhash64(get(hashes, i), get(hashes, i + 1), get(hashes, i + 2)) & {mask}L, bits) | cast(i AS bigint))) ELSE array() END"
    ).cast("array<bigint>")
    rows = rows.select("*", windows.alias("sorted")).drop("hashes")
    near = "(shiftright({a}, bits) = shiftright({b}, bits))"
    same = (
        f"({near} AND "
        + " AND ".join(f"get(words, cast({{a}} & (shiftleft(1L, bits) - 1L) AS int) + {k}) = get(words, cast({{b}} & (shiftleft(1L, bits) - 1L) AS int) + {k})" for k in range(3))
        + ")"
    )
    # a neighbour of equal hash and other words means that hashes collide: only then all windows are compared
    sides = ("get(sorted, k - 1)", "get(sorted, k + 1)")
    beside = " OR ".join(f"coalesce({same.format(a='x', b=side)}, false)" for side in sides)
    collide = " OR ".join(f"coalesce({near.format(a='x', b=side)}, false)" for side in sides)
    again = F.expr(f"filter(sorted, (x, k) -> ({collide}) AND ({beside} OR exists(sorted, y -> y != x AND {same.format(a='x', b='y')})))")
    rows = rows.select(*[c for c in rows.columns if c not in ("sorted", "words")], again.alias("again"))
    covered = F.expr(
        "aggregate(sort_array(transform(again, x -> x & (shiftleft(1L, bits) - 1L))), "
        "named_struct('last', -3L, 'total', 0L), (a, x) -> named_struct('last', x, 'total', a.total + least(3L, x - a.last)), a -> a.total)"
    )
    return rows.select("doc_id", covered.alias("n_repeat_words"), *[c for c in STATS if c != "n_repeat_words"])


def _share(of: str, by: str) -> Column:
    return F.coalesce(F.try_divide(F.col(of).cast("double"), F.col(by).cast("double")), F.lit(0.0))



def features() -> dict[str, Column]:
    """What rules are about: name and expression over statistics."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "upper": _share("n_upper", "word_chars"),
        "line_words": _share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, bool, float]


def learn_rules(rows: list[tuple[list[float], bool, bool]], names: list[str], precision: float = 0.97, support: int = 8, most: int = 16, cuts: int = 48) -> list[list[Condition]]:
    """Sequential covering. ``rows``: features, bad (to reject), prune (else grow).

    Returns rules as lists of (feature, above, threshold). A rule stands if, after pruning, at least
    ``precision`` of what it covers in each part is bad and it covers ``support`` bad rows; learning ends with
    the first that doesn't, or after ``most``. No rows, or none of a class, give no rules.
    """
    import numpy as np

    if not rows:
        return []
    x = np.array([r[0] for r in rows], float)
    bad = np.array([r[1] for r in rows], bool)
    prune = np.array([r[2] for r in rows], bool)
    left = np.ones(len(rows), bool)
    rules: list[list[Condition]] = []

    def covers(rule: list[Condition]) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for name, above, at in rule:
            column = x[:, names.index(name)]
            out &= (column > at) if above else (column <= at)
        return out

    while len(rules) < most and (left & bad).any():
        grow = left & ~prune
        rule: list[Condition] = []
        inside = grow.copy()
        while (inside & ~bad).any() and len(rule) < 4:
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p:
                break
            info, best = math.log2(p / (p + n)), (1e-9, None)
            for j, name in enumerate(names):
                values = np.unique(x[inside, j])
                if len(values) > cuts:
                    values = np.unique(np.quantile(x[inside, j], np.linspace(0, 1, cuts + 2)[1:-1]))
                for at in values:
                    for above in (True, False):
                        now = inside & ((x[:, j] > at) if above else (x[:, j] <= at))
                        p1 = int((now & bad).sum())
                        if p1:
                            gain = p1 * (math.log2(p1 / int(now.sum())) - info)
                            if gain > best[0]:
                                best = (gain, (name, above, float(at)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= covers(rule)
        if not rule:
            break

        def worth(some: list[Condition]) -> float:
            seen = covers(some) & left & prune
            return (int((seen & bad).sum()) - int((seen & ~bad).sum())) / max(1, int(seen.sum()))

        pruned = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        seen = covers(pruned) & left
        parts = [(int((seen & bad & q).sum()), int((seen & q).sum())) for q in (prune, ~prune)]
        if sum(p for p, _ in parts) < support or any(p < precision * n for p, n in parts):
            break
        rules.append(pruned)
        left &= ~seen
    return rules


def as_expression(rules: list[list[Condition]]) -> Column:
    """Index of the first rule that a row meets, null if none."""
    have, out = features(), None
    for i, rule in enumerate(rules):
        met = F.lit(True)
        for name, above, at in rule:
            met = met & ((have[name] > F.lit(at)) if above else (have[name] <= F.lit(at)))
        out = F.when(met, F.lit(i)) if out is None else out.when(met, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def fitted(stats: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, **settings) -> list[list[Condition]]:
    """The decision list for labels (doc_id, quality: 1 good, 0 bad); null labels are left out, of several the worst counts."""
    marked = labels.select(F.col("doc_id").cast("long").alias("__doc"), F.col("quality").cast("int").alias("__quality")).where("__doc is not null and __quality is not null")
    marked = marked.groupBy("__doc").agg(F.min("__quality").alias("__quality"))
    have = features()
    # the share that gives about the limit goes on, so that what is ordered and collected stays bounded
    share = int(min(1.0, 1.25 * limit / max(1, marked.count())) * (1 << 31))
    marked = marked.where(F.pmod(F.xxhash64("__doc"), F.lit(1 << 31)) < share)
    sample = (
        stats.where(~base_failed()).join(marked, stats["doc_id"].cast("long") == marked["__doc"])
        .select("__doc", "__quality", *[c.alias(k) for k, c in have.items()])
        .orderBy(F.pmod(F.xxhash64("__doc"), F.lit(1 << 31)), "__doc").limit(limit)
    )
    rows = [([float(r[k]) for k in have], r["__quality"] == 0, r["__doc"] * 2654435761 % 2**32 < 2**32 // 3) for r in sample.collect()]
    return learn_rules(rows, list(have), **settings)


def judge(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Statistics and verdict of every document.

    ``documents``: doc_id and text; ``labels``: doc_id and quality; other columns are ignored, whatever their
    names. Null and empty texts have zero statistics and fail the base; without usable labels only the base
    rejects; repeated rows get a row each; an empty table gives an empty result. Returns doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (index of the rule that
    rejected), and the other statistics.
    """
    stats = keep(text_stats(documents), "stats")
    rule = as_expression(fitted(stats, labels, **settings))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rule))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "rule", *STATS[5:])


def good_ones(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that aren't rejected; all columns stay, and so do rows with a null doc_id."""
    verdicts = keep(judge(documents, labels, **settings).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__rejected")).distinct(), "rejected")
    gone = F.broadcast(verdicts) if verdicts.count() <= MAX_IDS else verdicts
    return documents.join(gone, documents["doc_id"] == gone["__rejected"], "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of ``documents``; see :func:`judge`."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
