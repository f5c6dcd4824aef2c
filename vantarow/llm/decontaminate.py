"""Benchmark decontamination by greedy string tiling.

Tokens are case-folded runs of letters and digits. Runs of ``seed`` tokens that a text shares with a test item
are found by one rolling hash against an index of the items; around them, running Karp-Rabin repeatedly
marks the longest matches that overlap no earlier one. An item is leaked where its tiles, in whatever
order the text has them, cover enough of its tokens.

The items are the stated query set: they are indexed in blocks of bounded size, and every document is held
against every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import hashed_docs, keep, lean, mix, rolling, window_rows

#: Characters of items in one block, which every task receives whole.
BLOCK_CHARS = 8_000_000
#: The most ids that are broadcast to drop leaking documents; beyond, a shuffle join takes their place.
MAX_IDS = 4_000_000


class Items:
    """Tokens of test items and an index of their seeds; an item shorter than a seed is one seed of its own length."""

    def __init__(self, ids: list[int], texts: list[str], seed: int) -> None:
        self.seed, self.ids, self.tokens = seed, [], []
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        if ids:
            for a, b, hashes, offs in hashed_docs(_folded(pa.array(texts, pa.string())), kind="alnum"):
                for i in range(b - a):
                    part = hashes[offs[i] : offs[i + 1]]
                    if len(part):
                        width = min(seed, len(part))
                        grams = mix(rolling(part, width))
                        seeds.setdefault(width, []).append((grams, np.full(len(grams), len(self.ids), np.int32), np.arange(len(grams), dtype=np.int32)))
                        self.ids.append(ids[a + i])
                        self.tokens.append(part)
        self.index = {}
        for width, parts in seeds.items():
            grams, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams, kind="stable")
            rough = np.zeros(1 << 20, bool)
            rough[(grams >> np.uint64(44)).astype(np.int64)] = True
            self.index[width] = (grams[order], item[order], place[order], rough)


def _folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.string()) if not pa.types.is_large_string(column.type) else column)


def tiles(text: np.ndarray, item: np.ndarray, least: int, first: int = 32) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in text, place in item, length), longest first.

    Of equal matches, the one first in the item, then first in the text, is marked.
    """
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(first, len(item)))

    def windows(tokens: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(tokens) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.r_[0, np.cumsum(~free)]
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, rolling(tokens, n)[at]

    def extent(i: int, j: int, n: int) -> int:
        room = min(len(text) - i, len(item) - j)
        while n < room and free_text[i + n] and free_item[j + n] and text[i + n] == item[j + n]:
            n += 1
        return n

    while True:
        at_item, keys = windows(item, free_item, length)
        table: dict[int, list[int]] = {}
        for j, key in zip(at_item.tolist(), keys.tolist()):
            table.setdefault(key, []).append(j)
        found: list[tuple[int, int, int]] = []
        at_text, keys = windows(text, free_text, length)
        some = np.isin(keys, np.array(list(table), np.uint64)) if table else np.zeros(len(keys), bool)
        for i, key in zip(at_text[some].tolist(), keys[some].tolist()):
            for j in table[key]:
                if np.array_equal(text[i : i + length], item[j : j + length]):
                    found.append((extent(i, j, length), j, i))
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for n, j, i in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not (free_text[i : i + n].all() and free_item[j : j + n].all()):
                break  # an earlier tile has cut this match: what is left of it is measured anew
            free_text[i : i + n] = free_item[j : j + n] = False
            out.append((i, j, n))
        if found:
            continue
        if length == least:
            return out
        length = max(least, length // 2)


@lean
def _leaks(batches: Iterator[pa.RecordBatch], items, num: int, den: int) -> Iterator[pa.RecordBatch]:
    items: Items = items.value
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "n_tokens", "n_covered", "n_tiles")}
        for a, b, hashes, offs in hashed_docs(_folded(batch.column(1)), kind="alnum"):
            meets: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
            for width, (grams, item, place, rough) in items.index.items():
                starts, rows = window_rows(offs, width)
                if not len(starts):
                    continue
                values = mix(rolling(hashes, width)[starts])
                maybe = np.flatnonzero(rough[(values >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(grams, values[maybe], "left"), np.searchsorted(grams, values[maybe], "right")
                hit = np.flatnonzero(hi > lo)
                n = hi[hit] - lo[hit]
                at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = np.repeat(maybe[hit], n)
                key = rows[where].astype(np.int64) * len(items.ids) + item[at]
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True]) if len(order) else []
                for x, y in zip(cuts[:-1], cuts[1:]):
                    mine = order[x:y]
                    covered = np.zeros(len(items.tokens[item[at[mine[0]]]]), bool)
                    for k in range(width):
                        covered[place[at[mine]] + k] = True
                    # the seeds' cover bounds that of the tiles
                    if covered.sum() * den >= num * len(covered):
                        meets.setdefault((int(rows[where[mine[0]]]), int(item[at[mine[0]]])), []).append((starts[where[mine]], width))
            for (row, which), seeds in meets.items():
                token = items.tokens[which]
                width = seeds[0][1]
                near = np.unique(np.concatenate([s[:, None] + np.arange(w) for s, w in seeds]).ravel())
                # tiles lie within shared seeds; a gap stands for what is left out between them
                gaps = np.flatnonzero(np.diff(near) > 1) + 1
                text = np.insert(hashes[near], gaps, ~hashes[near[gaps]] if len(gaps) else np.empty(0, np.uint64))
                found = tiles(text, token, width)
                covered = sum(n for _, _, n in found)
                if covered * den >= num * len(token):
                    for name, value in zip(out, (ids[a + row], items.ids[which], len(token), covered, len(found))):
                        out[name].append(value)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def leaks(documents: DataFrame, benchmark: DataFrame, seed: int = 5, num: int = 50, den: int = 100) -> DataFrame:
    """Pairs of a document and a test item of which its tiles cover at least num/den of the tokens.

    ``documents``: doc_id and text; ``benchmark``: item_id and text; other columns are ignored, whatever their
    names. Null and empty texts and items leak nothing; repeated items count once, repeated documents each;
    an empty table gives an empty result. ``seed``: tokens of the shortest tile. Returns doc_id, item_id,
    n_tokens, n_covered, n_tiles.
    """
    spark = documents.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = tests.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_CHARS))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = []
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        items = spark.sparkContext.broadcast(Items(rows.column(0).to_pylist(), rows.column(1).to_pylist(), seed))
        out.append(docs.mapInArrow(partial(_leaks, items=items, num=num, den=den), "doc_id long, item_id long, n_tokens long, n_covered long, n_tiles long"))
    return reduce(DataFrame.unionByName, out)


def clean_ones(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that leak no test item; all columns stay, and so do rows with a null doc_id."""
    gone = keep(leaks(documents, benchmark, **settings).where("doc_id is not null").select(F.col("doc_id").alias("__leaks")).distinct(), "leaks")
    gone = F.broadcast(gone) if gone.count() <= MAX_IDS else gone
    return documents.join(gone, documents["doc_id"].cast("long") == gone["__leaks"], "left_anti")


def op3(spark, sf_dir: str) -> DataFrame:
    """Leaks of ``benchmark`` in ``documents``; see :func:`leaks`."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
