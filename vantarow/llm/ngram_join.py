"""N-gram Jaccard join: a blocked sparse matrix product with size-derived bounds.

Documents are rows of a sparse incidence matrix, hashed word n-grams its columns. The product of the
matrix with its transpose is taken block of columns by block of columns, over the part of each row that
a size bound leaves: to reach the threshold, two sets must meet within the first
``n - ceil(t * n) + 1`` grams of one common order. Pairs whose overlap can't reach what their two sizes
require are discarded inside the block (:mod:`vantarow.llm.proposals`), the overlap counts of the others
are completed over whole sets and compared with what the sizes require.

Groups don't expand into all pairs: documents with equal sets are one row (the class representative), and
a block puts forward a spanning forest of the pairs that no bound excludes. Where a count refutes an edge,
its tree is looked at again, without that pair, until no tree has a refuted edge. A column that a large
share of all rows holds is cut into parts; rows outside the component that most of a column belongs to
then meet every part. Of columns with equal rows, as near copies have them by the dozen, one is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import even_keys, hashed_docs, ints, keep, lean, mix, most_frequent, owned, owners, packed, partitions, remove, rolling, thick, thin, window_rows, written
from vantarow.llm.graph import connected_components
from vantarow.llm.proposals import WIDER, propose, sketch

#: Columns counted often within one task are put last in the order of grams. At most this many are sent
#: to all tasks; any order is correct, so the limit bounds memory and never changes results.
MAX_FREQUENT = 1_000_000
#: Ids are broadcast up to this many, and joined by a shuffle beyond.
MAX_IDS = 1_000_000
#: Rows of a column that stand in one task; a column with more is cut into parts.
MAX_COLUMN = 16_384
#: Rows of a column that stand in one list; a longer column is several lists.
PIECE = 1_024


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of documents: first row, sorted distinct grams of all, offsets of rows."""
    for a, b, hashes, offs in hashed_docs(column, lower=True):
        starts, rows = window_rows(offs, words)
        windows = rolling(hashes, words)
        grams, rows = mix(windows[starts]) if len(starts) else np.empty(0, np.uint64), rows
        counts = np.diff(offs)
        for i in np.flatnonzero((counts > 0) & (counts < words)):
            whole = rolling(hashes[offs[i] : offs[i + 1]], int(counts[i])) + np.uint64(counts[i])
            grams, rows = np.append(grams, mix(whole)), np.append(rows, i)
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        if len(grams):
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
            grams, rows = grams[new], rows[new]
        yield a, grams, np.searchsorted(rows, np.arange(b - a + 1), "left")


@lean
def _frequent(batches: Iterator[pa.RecordBatch], words: int, least: int, every: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, n, seen = [], 0, set()

    def out() -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= least
        return pa.RecordBatch.from_pydict({"gram": grams[often].view(np.int64), "n": counts[often]})

    for batch in batches:
        for _, grams, offs in _sets(batch.column(1), words):
            for i in range(len(offs) - 1):
                part = grams[offs[i] : offs[i + 1]]
                key = xxhash.xxh3_64_intdigest(packed(part))
                if key not in seen:
                    seen.add(key)
                    held.append(part)
                    n += len(part)
            if n >= every:
                yield out()
                held, n, seen = [], 0, set()
    if held:
        yield out()


@lean
def _prefixes(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, frequent) -> Iterator[pa.RecordBatch]:
    often = frequent.value[0] if frequent is not None else np.empty(0, np.uint64)
    rough = np.zeros(1 << 20, bool)
    rough[(often >> np.uint64(44)).astype(np.int64)] = True
    for batch in batches:
        ids = batch.column(0)
        for a, grams, offs in _sets(batch.column(1), words):
            last = rough[(grams >> np.uint64(44)).astype(np.int64)]
            maybe = np.flatnonzero(last)
            if len(maybe):
                at = np.searchsorted(often, grams[maybe])
                last[maybe] = often[np.minimum(at, len(often) - 1)] == grams[maybe]
            sizes = np.diff(offs)
            signatures, prefixes, sketches, wide = [], [], [], []
            for i, n in enumerate(sizes):
                part, late = grams[offs[i] : offs[i + 1]], last[offs[i] : offs[i + 1]]
                signatures.append(xxhash.xxh3_128_digest(packed(part)) if n else None)
                want = int(n) - (num * int(n) + den - 1) // den + 1
                head = part[~late][:want]
                prefixes.append(packed(head if len(head) == want else np.concatenate([head, part[late][: want - len(head)]])) if n else None)
                sketches.append(sketch(part) if n else None)
                wide.append(sketch(part, WIDER) if n else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids.slice(a, len(sizes)), "n": sizes.astype(np.int64), "signature": pa.array(signatures, pa.binary()),
                    "prefix": pa.array(prefixes, pa.binary()), "sketch": pa.array(sketches, pa.binary()), "wide": pa.array(wide, pa.binary()),
                }
            )


def _part(grams: np.ndarray, docs: np.ndarray, hot) -> tuple[np.ndarray, np.ndarray]:
    """Of each nonzero: the part of its column it belongs to, and how many parts the column has."""
    part, parts = np.zeros(len(grams), np.int64), np.ones(len(grams), np.int64)
    if hot is not None and len(hot.value[0]):
        names, many = hot.value
        at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
        hit = np.flatnonzero(names[at] == grams)
        parts[hit] = many[at[hit]]
        part[hit] = (mix(docs[hit].astype(np.int64).view(np.uint64)) % parts[hit].astype(np.uint64)).astype(np.int64)
    return part, parts


_DEALT = "block long, grams binary, rows binary, docs binary, counts binary, sizes binary, places binary"


@lean
def _deal(batches: Iterator[pa.RecordBatch], keys: np.ndarray, hot=None, every: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Pack the nonzeros of the matrix by block of columns: grams and places as they are, rows as counts by document."""
    docs, sizes, grams, n = [], [], [], 0
    blocks = np.uint64(len(keys))

    def out() -> pa.RecordBatch:
        g, lengths = np.concatenate(grams), np.array([len(x) for x in grams])
        names, size = np.array(docs, np.int64), np.array(sizes, np.int32)
        who = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(g)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        part, _ = _part(g, names[who], hot)
        block = (((g >> np.uint64(40)) + mix(part.view(np.uint64)) * (part > 0)) % blocks).astype(np.int64)
        order = np.argsort(block, kind="stable")
        g, who, block, place = g[order], who[order], block[order], place[order]
        cuts = np.searchsorted(block, np.arange(len(keys) + 1))
        made = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[k], cuts[k + 1])
            made.append((int(keys[k]), packed(g[mine]), *owners(who[mine], names), thin(size[np.unique(who[mine])]), thin(place[mine].astype(np.uint32))))
        columns = list(zip(*made))
        return pa.RecordBatch.from_pydict({"block": pa.array(columns[0], pa.int64()), **{k: pa.array(c, pa.binary()) for k, c in zip(("grams", "rows", "docs", "counts", "sizes", "places"), columns[1:])}})

    for batch in batches:
        for d, s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            docs.append(d)
            sizes.append(s)
            grams.append(np.frombuffer(p, np.uint64))
            n += len(grams[-1])
            if n >= every:
                yield out()
                docs, sizes, grams, n = [], [], [], 0
    if n:
        yield out()


@lean
def _meet(batches: Iterator[pa.RecordBatch], num: int, den: int, dense: int, hot=None) -> Iterator[pa.RecordBatch]:
    """Columns of one block, each with the rows that meet another one within the size bounds; those of cut columns all stay.

    ``own`` tells a column of over ``dense`` rows, or a part of a cut one, from all others; it comes in pieces.
    """
    grams, docs, sizes, places = [], [], [], []
    for batch in batches:
        for _, g, rows, named, counts, size, place in zip(*(c.to_pylist() for c in batch.columns)):
            _, named, counts = owned(rows, named, counts)
            grams.append(g)
            docs.append(np.repeat(named, counts))
            sizes.append(np.repeat(thick(size, np.int32), counts))
            places.append(thick(place, np.uint32))
    if not grams:
        return
    g, doc, size, place = ints(grams, "u8"), np.concatenate(docs), np.concatenate(sizes).astype(np.int64), np.concatenate(places).astype(np.int64)
    del grams, docs, sizes, places
    order = np.argsort(g, kind="stable")
    g = g[order]
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    same[:-1] |= same[1:]
    part, parts = _part(g, doc[order], hot)
    same |= parts > 1
    order, g, part, parts = order[same], g[same], part[same], parts[same]
    doc, size, place = doc[order], size[order], place[order]
    order = np.lexsort((size, part, g))
    g, part, parts, doc, size, place = (x[order] for x in (g, part, parts, doc, size, place))
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])]) if len(g) else np.empty(0, np.int64)
    length = np.diff(np.r_[start, len(g)])
    run, end = np.repeat(length, length), np.repeat(start + length, length)
    long = (parts > 1) | (run > dense)
    meets = long.copy()
    where = np.flatnonzero(run <= dense)
    for r in range(1, dense):
        where = where[where + r < end[where]]
        if not len(where):
            break
        i, j = where, where + r
        need = -(-num * (size[i] + size[j]) // (num + den))
        fits = (doc[i] != doc[j]) & (size[i] * den >= size[j] * num) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= need)
        meets[i[fits]] = meets[j[fits]] = True
    m = np.flatnonzero(meets)
    m = m[np.lexsort((doc[m], part[m], g[m]))]
    g, part, parts, doc, size, place, long = (x[m] for x in (g, part, parts, doc, size, place, long))
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])]) if len(g) else np.empty(0, np.int64)
    length = np.diff(np.r_[start, len(g)])
    start = np.sort(np.concatenate([start, *(np.arange(s + PIECE, s + n, PIECE) for s, n in zip(start[length > PIECE], length[length > PIECE]))]))
    for a in range(0, len(start), 4096):
        s = start[a : a + 4096]
        to = int(start[a + 4096]) if a + 4096 < len(start) else len(g)
        offsets = pa.array(np.r_[s, to] - s[0], pa.int32())
        lists = {k: pa.ListArray.from_arrays(offsets, pa.array(x[s[0] : to].astype(kind))) for k, x, kind in (("docs", doc, np.int64), ("sizes", size, np.int32), ("places", place, np.int32))}
        name = g[s].view(np.int64)
        yield pa.RecordBatch.from_pydict({"gram": name, "own": pa.array(name, mask=~long[s]), "part": part[s], "parts": parts[s], **lists})


_COLUMNS = "gram long, own long, part long, parts long, docs array<long>, sizes array<int>, places array<int>"


def _unlike(columns: DataFrame) -> DataFrame:
    """Cells of the columns, of those with equal rows the first in the order of grams.

    A pair is bounded by the column that it meets first in. An earlier one with the same rows would be an earlier
    meeting, so that column is never the one left out.
    """
    first = columns.groupBy("own", "part", "parts", "docs", "sizes").agg(F.min(F.struct("places", "gram")).alias("first"))
    cells = first.select("first.gram", "part", "parts", F.inline(F.arrays_zip("docs", "sizes", "first.places")).alias("doc", "n", "place"))
    return cells.select("gram", "part", "parts", "doc", F.col("n").cast("long"), F.col("place").cast("long"))


@lean
def _exact(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each group that reach the threshold; rows come by group, its texts before its pairs.

    A pair that earlier links of the group connect already needs no comparison: components are the same.
    """
    group: tuple | None = None
    sets: dict[int, np.ndarray] = {}
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        comp, lo, hi, a, b = (batch.column(k).to_pylist() for k in range(5))
        good: tuple[list, list] = ([], [])
        for first, grams, offs in _sets(batch.column(5), words):
            for i in range(len(offs) - 1):
                k = first + i
                if (comp[k], lo[k], hi[k]) != group:
                    group, sets, above = (comp[k], lo[k], hi[k]), {}, {}
                if b[k] is None:
                    sets[a[k]] = grams[offs[i] : offs[i + 1]].copy()
                    continue
                u, v = top(a[k]), top(b[k])
                if u == v:
                    continue
                x, y = sets[a[k]], sets[b[k]]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if shared * den >= num * (len(x) + len(y) - shared):
                    above[u] = v
                    good[0].append(a[k])
                    good[1].append(b[k])
        yield pa.RecordBatch.from_pydict({"u": pa.array(good[0], pa.int64()), "v": pa.array(good[1], pa.int64())})


def _linked(pairs: DataFrame, documents: DataFrame, words: int, num: int, den: int, together: int = 256) -> DataFrame:
    """Links among candidate pairs (a, b; c: the larger, the likelier) that make the same components as all links.

    Pairs whose documents share a least partner are compared in one group, so that a text moves once for
    many pairs. A group of more than ``together`` documents is cut into parts, and each two parts that
    candidates name are a group: on average none has more than twice as many documents.
    """
    pairs = keep(pairs.select("a", "b", "c"), "candidates")
    # the least partner names a group: near copies mostly share one, and any naming gives the same links
    ends = pairs.select(F.col("a").alias("node"), F.col("a").alias("least")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("least")))
    named = ends.groupBy("node").agg(F.min("least").alias("least"))
    keyed = pairs.join(named.select(F.col("node").alias("a"), F.col("least").alias("component")), "a")
    members = keyed.select("component", F.col("a").alias("m")).unionByName(keyed.select("component", F.col("b").alias("m"))).distinct()
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / together).cast("long").alias("parts"))
    part_a, part_b = F.pmod(F.xxhash64("a"), F.col("parts")), F.pmod(F.xxhash64("b"), F.col("parts"))
    keyed = keyed.join(sizes, "component")
    keyed = keep(keyed.select("component", F.least(part_a, part_b).alias("lo"), F.greatest(part_a, part_b).alias("hi"), "a", "b", "c"), "keyed")
    key = ["component", "lo", "hi"]
    wanted = keep(keyed.select(*key, F.col("a").alias("doc_id")).unionByName(keyed.select(*key, F.col("b").alias("doc_id"))).distinct(), "wanted")
    texts = documents.join(_few(wanted), "doc_id").select(*key, F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text", F.lit(None).cast("long").alias("c"))
    rows = texts.unionByName(keyed.select(*key, "a", "b", F.lit(None).cast("string").alias("text"), "c"))
    dealt = rows.repartition(partitions(documents.sparkSession), *key).sortWithinPartitions(*key, F.col("c").desc_nulls_first(), "a", "b")
    return dealt.select(*key, "a", "b", "text").mapInArrow(partial(_exact, words=words, num=num, den=den), "u long, v long")


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast ids behind a count of them; beyond the bound they are a side of a shuffle join."""
    return F.broadcast(ids) if ids.count() <= MAX_IDS else ids


def _settle(cells: DataFrame, labels: DataFrame | None, sketches: DataFrame, documents: DataFrame, words: int, num: int, den: int, dense: int) -> DataFrame | None:
    """Labels (node, component) after all pairs that meet in ``cells`` (gram, part, doc, n, place, home) are settled.

    Every round counts the edges that the blocks put forward. A tree all of whose edges hold is one
    component; the rows of the others come again, without the refuted pairs, with wide sketches and more edges a row.
    """
    spark = documents.sparkSession
    refuted, forests, now = None, 1, cells
    while True:
        if labels is None:
            now = now.withColumn("comp", F.col("doc"))
        else:
            named = labels.select(F.col("node").alias("doc"), F.col("component").alias("comp"))
            now = now.drop("comp").join(named, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        now = now if refuted is None and labels is None else keep(now, "cells")
        shown = sketches.select("doc", F.col("sketch" if refuted is None else "wide").alias("sketch"))
        rows = now.join(shown, "doc").select("gram", "part", "doc", "n", "place", "comp", "home", "sketch", F.lit(None).cast("long").alias("other"))
        if refuted is not None:
            gone = refuted.select("gram", "part", F.col("a").alias("doc"), *(F.lit(0).cast("long").alias(c) for c in ("n", "place", "comp")), F.lit(False).alias("home"), F.lit(None).cast("binary").alias("sketch"), F.col("b").alias("other"))
            rows = rows.unionByName(gone)
        dealt = rows.repartition(partitions(spark), "gram", "part").sortWithinPartitions("gram", "part", "n", "doc")
        forest = keep(dealt.mapInArrow(partial(propose, num=num, den=den, dense=dense, forests=forests), "gram long, part long, task long, tree long, a long, b long, apart long"), "forest")
        if forest.isEmpty():
            return labels
        links = keep(_linked(forest.groupBy("a", "b").agg((-F.min("apart")).alias("c")), documents, words, num, den), "links")
        before = labels
        edges = links if labels is None else links.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
        labels = keep(connected_components(edges), "labels")
        named = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        judged = forest.join(named("a"), "a", "left").join(named("b"), "b", "left").withColumn("fails", F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        judged = keep(judged.select("gram", "part", "task", "tree", "a", "b", "fails"), "judged")
        wrong = judged.where("fails").select("gram", "part", "a", "b")
        if wrong.isEmpty():
            return labels
        trees = judged.where("fails").select("task", "tree").distinct()
        again = judged.join(trees, ["task", "tree"], "left_semi")
        again = again.select(F.col("a").alias("doc")).unionByName(again.select(F.col("b").alias("doc"))).distinct()
        if before is not None:
            again = again.join(before.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc", "left").select(F.coalesce("comp", "doc").alias("comp")).distinct()
        else:
            again = again.select(F.col("doc").alias("comp"))
        now = now.join(again, "comp", "left_semi")
        refuted = wrong if refuted is None else refuted.unionByName(wrong)
        forests *= 4 if forests == 1 else 16


def _meet_parts(cells: DataFrame, labels: DataFrame | None, num: int = 80, den: int = 100) -> DataFrame:
    """Cells of cut columns, each row outside the most common component of its column repeated for the parts it can meet.

    A part holds nothing for a row if none of its sizes is near enough, or if what is left of both rows after the column
    falls short of the overlap that their sizes require: then the row isn't sent there.
    """
    if labels is None:
        named = cells.withColumn("comp", F.col("doc"))
    else:
        named = cells.join(labels.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    counts = named.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("rows"))
    most = counts.groupBy("gram").agg(F.max_by("comp", F.struct("rows", "comp")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    held = named.groupBy("gram", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("rest"))
    shapes = held.groupBy("gram").agg(F.collect_list(F.struct("part", "low", "high", "rest")).alias("shapes"))
    size, rest = F.col("n"), F.col("n") - F.col("place")

    def meets(shape: Column) -> Column:
        low = F.greatest(shape["low"], F.ceil(size * num / den).cast("long"))
        need = F.ceil((size + low) * num / (num + den)).cast("long")
        return (shape["part"] == F.col("part")) | ((low <= shape["high"]) & (low * num <= size * den) & (rest >= need) & (shape["rest"] >= need))

    outside = F.col("comp") != F.col("most")
    to = F.explode(F.when(outside, F.transform(F.filter("shapes", meets), lambda x: x["part"])).otherwise(F.array("part")))
    met = named.join(most.join(shapes, "gram"), "gram").select("gram", "part", "doc", "n", "place", to.alias("to"))
    return met.select("gram", F.col("to").alias("part"), "doc", "n", "place", (F.col("to") == F.col("part")).alias("home"))


def ngram_components(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, dense: int = 64, least: int = 2, everywhere: int = 24, column: int = MAX_COLUMN) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least num/den of their word n-gram sets.

    ``documents``: doc_id (long, one text for each) and text; other columns are ignored, whatever their names.
    A document with fewer than ``words`` words is one gram, its whole sequence; one without words (or a null
    text) has an empty set, links with nothing and is its own component. Repeated texts share a class; a
    repeated row is returned as often as it comes. Rows with a null doc_id are ignored. Returns doc_id,
    n_shingles, class_id (least doc_id with the same set), component_id (least doc_id reachable). An empty
    table gives an empty result. ``dense``: rows of a column from which not all of its pairs are looked at
    while one component holds most of them; ``least`` and ``everywhere``: counts, in a task and in all, from
    which a column is put last in the order; ``column``: rows from which a column is cut into parts.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    counts = docs.mapInArrow(partial(_frequent, words=words, least=least), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= everywhere)
    table = most_frequent(keep(counts, "frequent"), MAX_FREQUENT).select("gram", "n").toArrow()
    often, times = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(often)
    often, times = often[order], times[order]
    shared = spark.sparkContext.broadcast((often,)) if len(often) else None
    large = times > column
    hot = spark.sparkContext.broadcast((often[large], -(-times[large] // column))) if large.any() else None
    rows, prefixes = written(docs.mapInArrow(partial(_prefixes, words=words, num=num, den=den, frequent=shared), "doc_id long, n long, signature binary, prefix binary, sketch binary, wide binary"), "prefixes")
    classes = keep(rows.where("n > 0").groupBy("signature").agg(F.min("doc_id").alias("class_id")), "classes")
    copies = keep(rows.select("doc_id", "signature").join(classes, "signature").where("doc_id != class_id").select("doc_id", "class_id").distinct(), "copies")
    heads = rows.where("n > 0").join(_few(copies.select("doc_id")), "doc_id", "left_anti")
    dealt = heads.select("doc_id", "n", "prefix").mapInArrow(partial(_deal, keys=even_keys(spark, partitions(spark)), hot=hot), _DEALT)
    columns = dealt.repartition(partitions(spark), "block").mapInArrow(partial(_meet, num=num, den=den, dense=dense, hot=hot), _COLUMNS)
    cells = keep(_unlike(columns), "cells")
    sketches = rows.where("n > 0").join(_few(cells.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "sketch", "wide")
    sketches = keep(sketches.dropDuplicates(["doc"]), "sketches")
    rows = keep(rows.select("doc_id", "n"), "sizes")
    remove(spark, prefixes)
    own = cells.select("gram", "part", "doc", "n", "place", F.lit(True).alias("home"))
    labels = _settle(own, None, sketches, docs, words, num, den, dense)
    if hot is not None:
        cut = cells.where("parts > 1").select("gram", "part", "parts", "doc", "n", "place")
        labels = _settle(_meet_parts(cut, labels, num, den), labels, sketches, docs, words, num, den, dense)
    # only documents that are a copy or linked have another name than their own: these few, not all rows, are joined
    final = copies.select("doc_id", "class_id")
    if labels is not None:
        moved = labels.where("node != component").select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
        final = final.join(moved, "class_id", "left").select("doc_id", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
        final = final.unionByName(moved.select(F.col("class_id").alias("doc_id"), "class_id", "component_id"))
    else:
        final = final.withColumn("component_id", F.col("class_id"))
    final = keep(final, "named")
    named = rows.select("doc_id", F.col("n").alias("n_shingles")).join(_few(final), "doc_id", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(documents: DataFrame, **settings) -> DataFrame:
    """The rows whose doc_id stands for their component; all columns stay. Rows with a null doc_id stay too."""
    found = ngram_components(documents, **settings).select(F.col("doc_id").alias("__doc"), F.col("component_id").alias("__component"))
    gone = found.where("__doc != __component").select(F.col("__doc").alias("doc_id"))
    gone = _few(keep(gone, "gone"))
    return documents.join(gone, documents["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op2(spark, sf_dir: str) -> DataFrame:
    """Class of every document of ``documents``; see :func:`ngram_components`."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
