"""Substring dedup by fixed-block anchors.

A repeat of ``length`` words holds one whole aligned block of ``(length + 1) // 2`` words in each of its
places. The aligned, non-overlapping blocks of every document are the index; every rolling window of that
many words probes it. Hits are extended to the windows of full length around them, whose exact repeats
(any start, any document) unite to the maximal exact repeats that are removed.

Index and probes meet in column blocks by hash, as packed arrays. No pair of places is ever made, so a
passage in a million documents costs a million entries. Hashes have 64 bits in the deciding step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import even_keys, flush_name, hashed_docs, keep, lean, mix, owned, owners, packed, partitions, rolling, texts_of, thick, thin, window_rows

#: Up to this many bytes of ids or marks are broadcast; beyond, a shuffle join takes their place.
MAX_BROADCAST = 48 << 20
#: Entries that are packed at once.
EVERY = 1_000_000
_DEALT = "block long, flush binary, rows binary, docs binary, counts binary, grams binary, places binary"


@lean
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, offs in hashed_docs(batch.column(1)):
            signs = [xxhash.xxh3_128_digest(packed(hashes[offs[i] : offs[i + 1]])) for i in range(b - a)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n": np.diff(offs), "signature": pa.array(signs, pa.binary())})


def _probes(offs: np.ndarray, hashes: np.ndarray, length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling windows of documents that can hold a repeat: start, row, hash; the rest has none."""
    counts = np.diff(offs)
    starts, rows = window_rows(offs, block)
    fit = counts[rows] >= length
    starts, rows = starts[fit], rows[fit]
    return starts, rows, mix(rolling(hashes, block)[starts]) if len(starts) else np.empty(0, np.uint64)


class _Dealer:
    """Collects entries of documents and packs them by block of hash values."""

    def __init__(self, keys: np.ndarray, every: int, places: bool) -> None:
        self.keys, self.blocks, self.every, self.places = keys, len(keys), every, places
        self.number = 0
        self.clear()

    def clear(self) -> None:
        self.docs, self.counts, self.block, self.gram, self.place, self.n = [], [], [], [], [], 0

    def add(self, docs: list, counts: np.ndarray, block: np.ndarray, gram: np.ndarray, place: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        self.docs.extend(docs)
        self.counts.append(counts)
        self.block.append(block)
        self.gram.append(gram)
        if place is not None:
            self.place.append(place)
        self.n += len(gram)
        if self.n >= self.every:
            yield self.out()

    def out(self) -> pa.RecordBatch:
        docs, counts = np.array(self.docs, np.int64), np.concatenate(self.counts)
        block, gram = np.concatenate(self.block), np.concatenate(self.gram)
        who = np.repeat(np.arange(len(docs)), counts)
        order = np.argsort(block, kind="stable")
        block, gram, who = block[order], gram[order], who[order]
        place = np.concatenate(self.place)[order] if self.places else None
        cuts = np.searchsorted(block, np.arange(self.blocks + 1))
        flush = flush_name(docs, self.number)
        self.number += 1
        made = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[k], cuts[k + 1])
            made.append((int(self.keys[k]), flush, *owners(who[mine], docs), packed(gram[mine]), packed(place[mine]) if self.places else None))
        columns = list(zip(*made)) or [()] * 7
        self.clear()
        return pa.RecordBatch.from_pydict({"block": pa.array(columns[0], pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in zip(("flush", "rows", "docs", "counts", "grams", "places"), columns[1:])}})


@lean
def _deal_probes(batches: Iterator[pa.RecordBatch], length: int, block: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = len(keys)
    dealer = _Dealer(keys, EVERY, False)
    for batch in batches:
        ids = batch.column(0)
        for a, b, hashes, offs in hashed_docs(batch.column(1)):
            starts, rows, grams = _probes(offs, hashes, length, block)
            if len(starts):
                anchor = (starts - offs[:-1][rows]) % block == 0
                yield from dealer.add(
                    ids.slice(a, b - a).to_pylist(), np.bincount(rows, minlength=b - a), (grams >> np.uint64(33)) % np.uint64(blocks),
                    ((grams.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | anchor), None,
                )
    if dealer.n:
        yield dealer.out()


@lean
def _match(batches: Iterator[pa.RecordBatch], anchors: bool) -> Iterator[pa.RecordBatch]:
    """Marks what meets in one partition: with ``anchors``, values that an aligned block and another place have; else values of two places."""
    rows: list[tuple] = []
    for batch in batches:
        rows.extend(zip(*(c.to_pylist() for c in batch.columns)))
    if not rows:
        return
    kind = np.uint32 if anchors else np.uint64
    sizes = np.array([len(r[5]) // kind().itemsize for r in rows])
    grams = np.frombuffer(b"".join(r[5] for r in rows), kind)
    if anchors:
        # the block is part of the value: entries of other blocks in this partition mustn't meet
        key = (np.repeat(np.array([r[0] for r in rows], np.uint64), sizes) << np.uint64(32)) | grams
        order = np.argsort(key, kind="stable")
        value = key[order] >> np.uint64(1)
    else:
        order = np.argsort(grams, kind="stable")
        value = grams[order]
    cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    length = np.diff(np.r_[cuts, len(value)])
    good = length > 1
    if anchors:
        good &= np.add.reduceat((grams[order] & np.uint32(1)).astype(np.int64), cuts) > 0
    hit = np.empty(len(grams), bool)
    hit[order] = np.repeat(good, length)
    at = 0
    for (block, flush, who, docs, counts, _, places), n in zip(rows, sizes):
        mine = hit[at : at + n]
        at += n
        if mine.any():
            marks = packed(np.frombuffer(places, np.uint32)[mine]) if places is not None else packed(np.packbits(mine))
            if places is not None:
                each = thick(counts, np.uint32).astype(np.int64)
                counts = thin(np.add.reduceat(mine.astype(np.int64), np.cumsum(each) - each).astype(np.uint32))
            yield pa.RecordBatch.from_pydict({"block": [block], "flush": [flush], "rows": [who], "docs": [docs], "counts": [counts], "marks": [marks]})


_MARKED = "block long, flush binary, rows binary, docs binary, counts binary, marks binary"


@lean
def _by_doc(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    """Gather the marks of each flush and hand every document those of its own."""
    flushes: dict[bytes, list[tuple]] = {}
    for batch in batches:
        for block, flush, who, docs, counts, marks in zip(*(c.to_pylist() for c in batch.columns)):
            flushes.setdefault(flush, []).append((block, who, docs, counts, marks))
    for rows in flushes.values():
        rows.sort(key=lambda r: r[0])
        yield make([(block, *owned(who, docs, counts), marks) for block, who, docs, counts, marks in rows])


def _bitmaps(rows: list[tuple]) -> pa.RecordBatch:
    """Per document, the keys of blocks with hits and the bits of its entries there."""
    out: dict[int, list] = {}
    names: dict[int, int] = {}
    for block, who, docs, counts, marks in rows:
        bits = np.unpackbits(np.frombuffer(marks, np.uint8))[: counts.sum()]
        ends = np.cumsum(counts)
        some = np.add.reduceat(bits.astype(np.int64), ends - counts)
        for i in np.flatnonzero(some).tolist():
            names[int(who[i])] = int(docs[i])
            out.setdefault(int(who[i]), []).append((block, np.packbits(bits[ends[i] - counts[i] : ends[i]])))
    ids = sorted(out)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([names[i] for i in ids], pa.int64()),
            "blocks": pa.array([packed(np.array([b for b, _ in out[i]], np.int64)) for i in ids], pa.binary()),
            "bits": pa.array([b"".join(packed(x) for _, x in out[i]) for i in ids], pa.binary()),
        }
    )


def _spans(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Per document, the word spans that repeated windows cover."""
    who = np.concatenate([np.repeat(r[1], r[3]) for r in rows])
    name = np.concatenate([np.repeat(r[2], r[3]) for r in rows])
    at = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]).astype(np.int64)
    order = np.lexsort((at, who))
    who, at, name = who[order], at[order], name[order]
    begin = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] > at[:-1] + length)])
    end = np.r_[begin[1:], len(at)] - 1
    spans = np.column_stack([at[begin], at[end] + length]).astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, who[begin][1:] != who[begin][:-1], True])
    return pa.RecordBatch.from_pydict({"doc_id": name[begin][cuts[:-1]], "spans": pa.array([packed(spans[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _hit_places(grams: np.ndarray, named: bytes, bits: bytes, blocks: int, number: dict[int, int]) -> np.ndarray:
    """Invert the packing for one document: which of its rolling windows hit."""
    block = ((grams >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    hit = np.zeros(len(grams), bool)
    raw, at = np.frombuffer(bits, np.uint8), 0
    for key in np.frombuffer(named, np.int64).tolist():
        k = number[key]
        mine = order[cuts[k] : cuts[k + 1]]
        size = (len(mine) + 7) // 8
        hit[mine] = np.unpackbits(raw[at : at + size])[: len(mine)].astype(bool)
        at += size
    return hit


@lean
def _deal_windows(batches: Iterator[pa.RecordBatch], length: int, block: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Extend hits: every window of full length whose own aligned block was hit."""
    blocks, number = len(keys), {int(k): i for i, k in enumerate(keys)}
    dealer = _Dealer(keys, EVERY, True)
    for batch in batches:
        ids, named, bits = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for a, b, hashes, offs in hashed_docs(batch.column(1)):
            short, full = rolling(hashes, block), rolling(hashes, length)
            for i in range(a, b):
                lo, hi = offs[i - a], offs[i - a + 1]
                n = int(hi - lo)
                if n < length or bits[i] is None:
                    continue
                hit = _hit_places(mix(short[lo : hi - block + 1]), named[i], bits[i], blocks, number)
                start = np.arange(n - length + 1)
                aligned = (start + block - 1) // block * block
                start = start[hit[aligned]]
                if len(start):
                    grams = mix(full[lo + start])
                    yield from dealer.add([ids[i]], np.array([len(start)]), (grams >> np.uint64(33)) % np.uint64(blocks), grams, start.astype(np.uint32))
    if dealer.n:
        yield dealer.out()


@lean
def _cut(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
        ids, spans, whole = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        data, offs = texts_of(batch.column(1))
        raw = data.tobytes()
        n_words, n_removed, kept, digests = [], [], [], []
        for i, (span, all_of_it) in enumerate(zip(spans, whole)):
            words = raw[offs[i] : offs[i + 1]].split()
            n_words.append(len(words))
            if all_of_it and len(words) >= length:
                rest = []
            elif span is None:
                rest = words
            else:
                rest, at = [], 0
                for x, y in np.frombuffer(span, np.uint32).reshape(-1, 2).tolist():
                    rest += words[at:x]
                    at = y
                rest += words[at:]
            n_removed.append(len(words) - len(rest))
            out = b" ".join(rest)
            digests.append(hashlib.sha256(out).hexdigest())
            if texts:
                kept.append(out)
        columns = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if texts else {}))


def _small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast behind a check of the size, else a plain side of a shuffle join."""
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def remove_repeats(documents: DataFrame, length: int = 35, texts: bool = True) -> DataFrame:
    """Remove every word that a window of ``length`` words covers whose word sequence also starts elsewhere.

    ``documents``: doc_id (long, one text for each) and text; other columns are ignored, whatever their names.
    Words are runs of anything but ASCII white space. All copies of a repeat go; windows are judged on the
    input. Null and empty texts have no words; rows with a null doc_id are ignored; an empty table gives an
    empty result. A repeated row is a document beside the other: both come out, and both lose every window.
    Returns doc_id, n_words, n_removed, kept_sha256 and kept (kept words joined by one space), without ``kept``
    if ``texts`` is false: then the texts don't leave the workers.
    """
    spark = documents.sparkSession
    block = (length + 1) // 2
    parts = partitions(spark)
    keys = even_keys(spark, parts)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signs = keep(docs.mapInArrow(_signatures, "doc_id long, n long, signature binary"), "signatures")
    classes = keep(signs.where(F.col("n") >= length).groupBy("signature").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "classes")
    copies = keep(signs.join(classes, "signature").select("doc_id", "head").distinct(), "copies")
    n_copies = copies.count()
    others = _small(copies.where("doc_id != head").select("doc_id"), 16 * n_copies)
    heads = docs.join(others, "doc_id", "left_anti")
    if 16 * n_copies > MAX_BROADCAST:
        heads = heads.sortWithinPartitions("doc_id")
    dealt = heads.mapInArrow(partial(_deal_probes, length=length, block=block, keys=keys), _DEALT).repartition(parts, "block")
    marked = dealt.mapInArrow(partial(_match, anchors=True), _MARKED).repartition(parts, "flush")
    hits = keep(marked.mapInArrow(partial(_by_doc, make=_bitmaps), "doc_id long, blocks binary, bits binary").dropDuplicates(["doc_id"]), "hits")
    size = hits.agg(F.coalesce(F.sum(F.length("bits") + F.length("blocks") + 24), F.lit(0))).first()[0]
    around = docs.join(_small(hits, size), "doc_id").select("doc_id", "text", "blocks", "bits")
    if size > MAX_BROADCAST:
        around = around.sortWithinPartitions("doc_id")
    windows = around.mapInArrow(partial(_deal_windows, length=length, block=block, keys=keys), _DEALT).repartition(parts, "block")
    again = windows.mapInArrow(partial(_match, anchors=False), _MARKED).repartition(parts, "flush")
    spans = keep(again.mapInArrow(partial(_by_doc, make=partial(_spans, length=length)), "doc_id long, spans binary").dropDuplicates(["doc_id"]), "spans")
    marks = keep(spans.join(copies.select("doc_id", F.lit(True).alias("whole")), "doc_id", "full").select("doc_id", "spans", F.coalesce("whole", F.lit(False)).alias("whole")), "marks")
    size = marks.agg(F.coalesce(F.sum(F.coalesce(F.length("spans"), F.lit(0)) + 32), F.lit(0))).first()[0]
    return docs.join(_small(marks, size), "doc_id", "left").select("doc_id", "text", "spans", "whole").mapInArrow(
        partial(_cut, length=length, texts=texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """What remains of every document of ``documents``, as digests; see :func:`remove_repeats`."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
