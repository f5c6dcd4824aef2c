"""Cross-entropy difference of two matched bigram models.

The target model is trained on the target documents, the background model on all others. Both have one
vocabulary (every word of the documents), one order, one smoothing and one size: the counts of the larger
are scaled to the tokens of the smaller, which is what a sample of that size holds on average, without
leaving a document out. A document is scored without its own counts (its own occurrences are taken out
of the model it belongs to), so no text is nearer to a model for being in it:
p(w|v) = (n(v w) + mu * p(w)) / (n(v) + mu).

Words are counted over all documents. The most frequent have ids and counts at every worker. Pairs of the
``dense`` most frequent words are counted in a table of fixed size and scored where the text is; all other
pairs meet in blocks by hash, packed, once a document, and are counted and scored there. Words without an id
go by their 64-bit hash: all pairs that end in one meet in its block, where they make up its count. A pair
outside the table has a word that is rarer than 1 in ``dense``, which bounds what one key can bring to a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import even_keys, flush_name, hashed_docs, keep, lean, mix, most_frequent, owned, owners, packed, partitions, thick, thin

#: Words with ids; pairs of ids then fit 32 bits. All other words go by hash.
MAX_VOCABULARY = 60_000
#: Ids of target documents up to this many are broadcast; beyond, a shuffle join takes their place.
MAX_IDS = 4_000_000
#: Entries that are packed at once.
EVERY = 700_000
UNKNOWN, START = 0, 1
#: Stands for the start of a text where words go by hash.
_START_HASH = np.uint64(0x8F1BBCDCCA62C1D6)


def _texts(documents: DataFrame, target: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ids = keep(target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True)), "target")
    small = ids.count() <= MAX_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, target flags, word hashes and offsets of groups of documents."""
    for batch in batches:
        ids, flags = batch.column(0), np.array(batch.column(2).to_pylist(), bool)
        for a, b, hashes, offs in hashed_docs(batch.column(1), lower=True, kind="alnum"):
            yield ids.slice(a, b - a).to_pylist(), flags[a:b], hashes, offs


@lean
def _words(batches: Iterator[pa.RecordBatch], every: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    flags: list[np.ndarray] = []
    n = 0

    def out() -> pa.RecordBatch:
        words, inverse = np.unique(np.concatenate(held), return_inverse=True)
        flag = np.concatenate(flags)
        return pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": np.bincount(inverse), "t": np.bincount(inverse[flag], minlength=len(words))})

    for _, flag, hashes, offs in _rows(batches):
        if len(hashes):
            held.append(hashes)
            flags.append(np.repeat(flag, np.diff(offs)))
            n += len(hashes)
        if n >= every:
            yield out()
            held, flags, n = [], [], 0
    if n:
        yield out()


class Vocabulary:
    """Ids of the most frequent words by rank, from 2; 0 is a word without id, 1 the start of a text. Counts of both models.

    ``n``, ``totals``, ``starts``: by model (background, target) counts of words, tokens and texts; ``distinct``:
    different words of all documents.
    """

    def __init__(self, words: np.ndarray, n: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], starts: tuple[int, int], distinct: int, mu: float) -> None:
        order = np.argsort(words)
        self.words, self.ids = words[order], (order + 2).astype(np.uint32)
        self.rough = np.zeros(1 << 20, bool)
        self.rough[(words >> np.uint64(44)).astype(np.int64)] = True
        self.n = [np.r_[0.0, start, known].astype(float) for known, start in zip(n, starts)]
        self.totals, self.mu = totals, mu
        least = min(totals)
        self.weight = [least / total if least else 1.0 for total in totals]
        # each word, and one never seen, once more than seen, so that none has probability 0; starts are never predicted
        self.kinds = distinct + 1.0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint32)
        maybe = np.flatnonzero(self.rough[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            known = self.words[at] == hashes[maybe]
            out[maybe[known]] = self.ids[at[known]]
        return out

    def room(self, model: int, first: np.ndarray, own_first: np.ndarray) -> np.ndarray:
        """Logarithm of what a word as the first of a pair is divided by; ``own_first``: its count in the document, 0 if of the other model."""
        return np.log(self.weight[model] * (first - own_first) + self.mu)

    def hits(self, model: int, pair: np.ndarray, word: np.ndarray, own_pair: np.ndarray, own_word: np.ndarray, own_tokens: np.ndarray) -> np.ndarray:
        """Logarithm of the numerator of a pair."""
        w = self.weight[model]
        p = (w * (word - own_word) + 1.0) / (w * (self.totals[model] - own_tokens) + self.kinds)
        return np.log(w * (pair - own_pair) + self.mu * p)


class _Pairs:
    """Pairs of words of a group of documents, each once a document: ids and hashes, and counts in the document."""

    def __init__(self, vocabulary: Vocabulary, hashes: np.ndarray, offs: np.ndarray) -> None:
        tokens = np.diff(offs)
        row = np.repeat(np.arange(len(tokens)), tokens)
        some = offs[:-1][tokens > 0]
        first = np.empty_like(hashes)
        first[1:] = hashes[:-1]
        first[some] = _START_HASH
        salt = mix(row.astype(np.uint64) + np.uint64(1))
        _, inverse, counts = np.unique(mix(hashes ^ salt), return_inverse=True, return_counts=True)
        own_word = counts[inverse]
        own_first = np.empty_like(own_word)
        own_first[1:] = own_word[:-1]
        own_first[some] = 1
        _, at, inverse, own_pair = np.unique(mix(_pair_key(first, hashes) ^ salt), return_index=True, return_inverse=True, return_counts=True)
        # how often the pair's second word is the first of another: always but at the end of the text
        follows = own_pair.copy()
        np.subtract.at(follows, inverse[offs[1:][tokens > 0] - 1], 1)
        ids = vocabulary.of(hashes)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[some] = START
        self.row, self.tokens = row[at], tokens[row[at]]
        self.first, self.second, self.before, self.word = first[at], hashes[at], before[at], ids[at]
        self.own_pair, self.own_first, self.own_word, self.follows = own_pair, own_first[at], own_word[at], follows


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + second)


def _inside(before: np.ndarray, word: np.ndarray, dense: int) -> np.ndarray:
    return (before < dense) & (word < dense) & (before != UNKNOWN) & (word != UNKNOWN)


@lean
def _dense_counts(batches: Iterator[pa.RecordBatch], vocabulary, dense: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, dense * dense), np.int64)
    for _, flag, hashes, offs in _rows(batches):
        if len(hashes):
            word = vocabulary.value.of(hashes)
            before = np.empty_like(word)
            before[1:] = word[:-1]
            before[offs[:-1][np.diff(offs) > 0]] = START
            inside = _inside(before, word, dense)
            key = before[inside].astype(np.int64) * dense + word[inside]
            target = np.repeat(flag, np.diff(offs))[inside]
            counts[0] += np.bincount(key[~target], minlength=dense * dense)
            counts[1] += np.bincount(key[target], minlength=dense * dense)
    some = np.flatnonzero(counts.any(axis=0))
    if len(some):
        yield pa.RecordBatch.from_pydict({"pair": some, "n": counts[0][some], "t": counts[1][some]})


_DEALT = pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("flush", "rows", "docs", "counts", "tokens", "word", "first", "own", "sums"))])


class _Flush:
    """Entries of documents until they are packed by block."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.entries: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}
        self.rows = self.n = 0

    def add(self, docs: np.ndarray, tokens: np.ndarray, sums: np.ndarray) -> None:
        self.docs.append(docs)
        self.tokens.append(tokens)
        self.sums.append(sums)
        self.rows += len(docs)

    def put(self, by_hash: bool, block: np.ndarray, row: np.ndarray, word: np.ndarray, first: np.ndarray, own: np.ndarray) -> None:
        """``row`` counts from the group that is added next; ``own`` has three counts of each entry."""
        self.entries[by_hash].append((block, row + self.rows, word, first, own))
        self.n += len(row)

    def out(self, keys: np.ndarray, number: int) -> pa.RecordBatch:
        docs, tokens = np.concatenate(self.docs), np.concatenate(self.tokens)
        flush = flush_name(docs, number)
        made = [(int(keys[int.from_bytes(flush[:4], "little") % len(keys)]), flush, None, thin(np.diff(docs, prepend=np.int64(0))), None, None, None, None, None, packed(np.concatenate(self.sums, axis=1)))]
        for by_hash, entries in self.entries.items():
            if not entries:
                continue
            block, row, word, first, own = (np.concatenate(x) for x in zip(*entries))
            order = np.lexsort((row, block))
            block, row, word, first, own = block[order], row[order], word[order], first[order], own[order]
            cuts = np.searchsorted(block, np.arange(len(keys) + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                some = slice(cuts[k], cuts[k + 1])
                made.append((int(keys[k]), flush, *owners(row[some], docs), thin(tokens[np.unique(row[some])].astype(np.uint32)), packed(word[some]), packed(first[some]) if by_hash else None, thin(own[some].T.astype(np.uint32)), None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _DEALT)], schema=_DEALT)


@lean
def _deal(batches: Iterator[pa.RecordBatch], vocabulary, table, dense: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cold pairs by block, of ids and of hashes; and for each flush one row of what is known already: tokens and losses."""
    known, seen, blocks = vocabulary.value, table.value, np.uint64(len(keys))
    flush, number = _Flush(), 0

    def block_of(key: np.ndarray) -> np.ndarray:
        return (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % blocks).astype(np.int64)

    for ids, flag, hashes, offs in _rows(batches):
        x = _Pairs(known, hashes, offs)
        target = flag[x.row]
        inside = _inside(x.before, x.word, dense)
        by_hash = (x.before == UNKNOWN) | (x.word == UNKNOWN)
        # what a word with an id brings as the first of a pair is known here
        led = by_hash & (x.before != UNKNOWN)
        sums = [np.diff(offs).astype(float)]
        for m in (0, 1):
            own = target == bool(m)
            loss = np.zeros(len(x.row))
            cell = x.before[inside].astype(np.int64) * dense + x.word[inside]
            some = own[inside]
            loss[inside] = known.room(m, known.n[m][x.before[inside]], some * x.own_first[inside]) - known.hits(m, seen[m][cell], known.n[m][x.word[inside]], some * x.own_pair[inside], some * x.own_word[inside], some * x.tokens[inside])
            loss[led] = known.room(m, known.n[m][x.before[led]], own[led] * x.own_first[led])
            sums.append(np.bincount(x.row, weights=loss * x.own_pair, minlength=len(ids)))
        by_id = ~inside & ~by_hash
        pair = (x.before[by_id] << np.uint32(16)) | x.word[by_id]
        flush.put(False, block_of(pair.astype(np.uint64)), x.row[by_id], pair, np.empty(len(pair), np.uint64), np.column_stack([x.own_pair[by_id], x.own_word[by_id], x.own_first[by_id]]))
        first, second = x.first[by_hash], x.second[by_hash]
        block = block_of(np.where(x.word[by_hash] == UNKNOWN, second, _pair_key(first, second)))
        flush.put(True, block, x.row[by_hash], second, first, np.column_stack([x.own_pair[by_hash], x.own_word[by_hash], x.follows[by_hash]]))
        flush.add(np.array(ids, np.int64) * 2 + flag, np.diff(offs), np.stack(sums))
        if flush.n >= EVERY:
            yield flush.out(keys, number)
            flush, number = _Flush(), number + 1
    if flush.docs:
        yield flush.out(keys, number)


def _id_losses(known: Vocabulary, pair: np.ndarray, own: np.ndarray, target: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Losses of pairs of ids under both models, for all their occurrences in a document."""
    kinds, inverse = np.unique(pair, return_inverse=True)
    before, word = (pair >> np.uint32(16)).astype(np.int64), (pair & np.uint32(0xFFFF)).astype(np.int64)
    out = []
    for m in (0, 1):
        mine = target == bool(m)
        seen = np.bincount(inverse, weights=own[0] * mine, minlength=len(kinds))[inverse]
        out.append(own[0] * (known.room(m, known.n[m][before], mine * own[2]) - known.hits(m, seen, known.n[m][word], mine * own[0], mine * own[1], mine * tokens)))
    return out


def _hash_losses(known: Vocabulary, second: np.ndarray, first: np.ndarray, own: np.ndarray, target: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Losses of pairs by hash, without what their first words bring; with what their second bring as the next pair's first."""
    pairs, inverse = np.unique(_pair_key(first, second), return_inverse=True)
    words, of = np.unique(second, return_inverse=True)
    ids = known.of(words)
    out = []
    for m in (0, 1):
        mine = target == bool(m)
        seen = np.bincount(inverse, weights=own[0] * mine, minlength=len(pairs))[inverse]
        # all pairs that end in a word without id are here, so they make up its count
        count = np.where(ids == UNKNOWN, np.bincount(of, weights=own[0] * mine, minlength=len(words)), known.n[m][ids])[of]
        led = np.where(ids[of] == UNKNOWN, own[2] * known.room(m, count, mine * own[1]), 0.0)
        out.append(led - own[0] * known.hits(m, seen, count, mine * own[0], mine * own[1], mine * tokens))
    return out


@lean
def _score(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Count the pairs that meet in one partition and hand every flush the losses of its documents."""
    by_id: list[tuple] = []
    by_hash: list[tuple] = []
    for batch in batches:
        for _, flush, rows, docs, counts, tokens, word, first, own, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if sums is not None:
                yield pa.RecordBatch.from_pydict({"flush": [flush], "rows": pa.array([None], pa.binary()), "docs": [docs], "sums": [sums]})
                continue
            _, named, counts = owned(rows, docs, counts)
            (by_id if first is None else by_hash).append((flush, rows, named & 1, counts, thick(tokens, np.uint32), word, first, thick(own, np.uint32).reshape(3, -1)))
    for rows in (by_id, by_hash):
        if not rows:
            continue
        target = np.concatenate([np.repeat(r[2].astype(bool), r[3]) for r in rows])
        tokens = np.concatenate([np.repeat(r[4], r[3]) for r in rows]).astype(float)
        own = np.concatenate([r[7] for r in rows], axis=1).astype(float)
        word = np.frombuffer(b"".join(r[5] for r in rows), np.uint32 if rows is by_id else np.uint64)
        if rows is by_id:
            loss = _id_losses(vocabulary.value, word, own, target, tokens)
        else:
            loss = _hash_losses(vocabulary.value, word, np.frombuffer(b"".join(r[6] for r in rows), np.uint64), own, target, tokens)
        at = 0
        for flush, who, _, counts, *_ in rows:
            ends = at + np.cumsum(counts)
            sums = np.stack([np.add.reduceat(loss[m][at : ends[-1]], ends - counts - at) for m in (0, 1)])
            at = int(ends[-1])
            yield pa.RecordBatch.from_pydict({"flush": [flush], "rows": [who], "docs": pa.array([None], pa.binary()), "sums": [packed(sums)]})


@lean
def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flushes: dict[bytes, list] = {}
    for batch in batches:
        for flush, rows, docs, sums in zip(*(c.to_pylist() for c in batch.columns)):
            flushes.setdefault(flush, []).append((rows, docs, sums))
    for parts in flushes.values():
        named, sums = next((docs, np.frombuffer(sums, float).reshape(3, -1).copy()) for rows, docs, sums in parts if rows is None)
        for rows, _, more in parts:
            if rows is not None:
                # a row occurs once in each part
                sums[1:, np.cumsum(thick(rows, np.uint32)).astype(np.int64)] += np.frombuffer(more, float).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"doc_id": np.cumsum(thick(named, np.int64)) >> 1, "n_tokens": sums[0].astype(np.int64), "background": sums[1], "target": sums[2]})


def vocabulary_of(rows: DataFrame, size: int, mu: float) -> Vocabulary:
    """Count the words of all documents; the most frequent, at most ``size`` and whole classes of equal count, get ids."""
    counts = keep(rows.mapInArrow(_words, "word long, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0)), F.count(F.lit(1))).first()
    starts = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("target").cast("long")), F.lit(0))).first()
    top = most_frequent(counts, size).toArrow()
    columns = [c.to_numpy() for c in top.columns]
    order = np.lexsort((columns[0], -columns[1]))
    words, n, t = (c[order] for c in columns)
    return Vocabulary(words.view(np.uint64), (n - t, t), (totals[0] - totals[1], totals[1]), (starts[0] - starts[1], starts[1]), totals[2], mu)


def score(documents: DataFrame, target: DataFrame, size: int = 50_000, mu: float = 20.0, dense: int = 512) -> DataFrame:
    """Losses per token of every document under both models, and their difference (lower is nearer the target).

    ``documents``: doc_id (long) and text; ``target``: doc_id of the documents that the target model is trained
    on; the background model is trained on all others. Other columns are ignored, whatever their names. A
    repeated row is a document beside the other: each counts, and each is scored without itself alone.
    ``size`` words get ids, all others go by hash; the scores don't depend on it.
    Tokens are runs of ASCII letters and digits and non-ASCII characters, A-Z folded. Texts without tokens
    (null ones too) have 0 tokens and null losses; rows with a null doc_id are ignored; a model without
    documents knows no word, and then sizes aren't matched; an empty table gives an empty result.
    Returns doc_id, n_tokens, target_loss, background_loss, difference (natural logarithms).
    """
    if not 2 < dense <= size + 2 <= MAX_VOCABULARY:
        raise ValueError("size must fit 16-bit ids, and dense be less")
    spark = documents.sparkSession
    rows = _texts(documents, target)
    known = vocabulary_of(rows, size, mu)
    shared = spark.sparkContext.broadcast(known)
    dense = min(dense, len(known.words) + 2)
    counted = rows.mapInArrow(partial(_dense_counts, vocabulary=shared, dense=dense), "pair long, n long, t long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    pair, *counts = (c.to_numpy() for c in counted.columns)
    table = np.zeros((2, dense * dense))
    for m in (0, 1):
        table[m][pair] = counts[m]
    parts = partitions(spark)
    dealt = rows.mapInArrow(
        partial(_deal, vocabulary=shared, table=spark.sparkContext.broadcast(table), dense=dense, keys=even_keys(spark, parts)),
        "block long, flush binary, rows binary, docs binary, counts binary, tokens binary, word binary, first binary, own binary, sums binary",
    )
    scored = dealt.repartition(parts, "block").mapInArrow(partial(_score, vocabulary=shared), "flush binary, rows binary, docs binary, sums binary")
    sums = scored.repartition(parts, "flush").mapInArrow(_total, "doc_id long, n_tokens long, background double, target double")

    def each(name: str):
        return F.try_divide(F.col(name), F.col("n_tokens").cast("double"))

    return sums.select("doc_id", "n_tokens", each("target").alias("target_loss"), each("background").alias("background_loss"), (each("target") - each("background")).alias("difference"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Scores of every document of ``documents``; the target are those labelled good and not toxic. See :func:`score`."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0")
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
