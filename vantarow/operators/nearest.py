"""Exact searches as products: blocks of rows meet all queries of a block, and a task keeps the best k of each as rows stream by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vantarow.functions.words import words

#: Scores, or products of postings and queries, that a task holds at a time; bytes of texts that it cuts into words at a time.
SLICE, BYTES = 1 << 21, 1 << 22
#: A term goes by the dense product where the shares of rows and of queries that hold it multiply to this much.
DENSE = 0.005
#: Scores are compared as numbers: what ranks above all of them (NaN), infinities inside, and what has none below.
_MOST = np.finfo(float).max


def rounded(x: np.ndarray, scale: float) -> np.ndarray:
    """Rounded as DuckDB rounds: halves of the scaled number away from zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * scale
        whole = np.rint(y)
        half = np.abs(y - np.trunc(y)) == 0.5
        whole[half] = np.trunc(y[half]) + np.sign(y[half])
        out = whole / scale + 0.0
    return np.where(np.isfinite(out), out, x)


class Best:
    """The best k of n queries over blocks of scores, by score (rounded to ``unit``), then key.

    A score below the k-th best so far is left out at once. ``lowest``: the least score that counts; ``least``: what the
    k-th best is known to reach.
    """

    def __init__(self, n: int, k: int, unit: float, lowest: float, least: np.ndarray | None = None) -> None:
        self.n, self.k, self.unit, self.lowest = n, k, unit, lowest
        self.least = np.full(n, -np.inf) if least is None else least.copy()
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys: list[pa.Array] = []
        self.held = self.rows = 0

    def _below(self, score: np.ndarray, slack) -> np.ndarray:
        """A bound under all that may round to ``score``."""
        bound = np.where(np.abs(score) < _MOST, score - self.unit - 1e-12 * np.abs(np.clip(score, -_MOST, _MOST)) - slack, score)
        return np.maximum(bound, self.lowest)

    def add(self, scores: np.ndarray, keys: pa.Array, exact, slack=0.0) -> None:
        """``scores``: rows by queries, wrong by ``slack`` at most; ``exact`` gives those of (row, query) rounded."""
        cut = self._below(self.least, slack)
        hit = scores >= cut
        if len(scores) > self.k and np.count_nonzero(hit) > 4 * self.k * self.n:
            place = len(scores) - self.k
            hit = scores >= np.maximum(cut, self._below(np.partition(scores, place, axis=0)[place], 2 * slack))
        row, query = np.nonzero(hit)
        if not len(row):
            return
        value = exact(row, query, scores[row, query])
        used, row = np.unique(row, return_inverse=True)
        self.entries.append((query.astype(np.int32), row + self.rows, value))
        self.keys.append(keys.take(pa.array(used)))
        self.held += len(row)
        self.rows += len(used)
        if self.held > max(2 * self.k * self.n, SLICE // 4):
            self._settle()

    def _settle(self) -> None:
        query, row, value = (np.concatenate(x) for x in zip(*self.entries))
        keys = pa.concat_arrays(self.keys)
        rank = np.empty(len(keys), np.int64)
        rank[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
        order = np.lexsort((rank[row], -value, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], np.arange(self.n))[query[order]]
        last, keep = order[place == self.k - 1], order[place < self.k]
        self.least[query[last]] = np.maximum(self.least[query[last]], value[last])
        used, at = np.unique(row[keep], return_inverse=True)
        self.entries, self.keys, self.held, self.rows = [(query[keep], at, value[keep])], [keys.take(pa.array(used))], len(keep), len(used)

    def batches(self, ids: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        """Rows query_id, key, score of what is kept."""
        if not self.entries:
            return
        self._settle()
        (query, row, value), keys = self.entries[0], self.keys[0]
        none = value == -np.inf
        value = np.select([value == np.inf, value == _MOST, value == -_MOST], [np.nan, np.inf, -np.inf], value)
        for a in range(0, len(row), 50_000):
            b = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[b])), keys.take(pa.array(row[b])), pa.array(value[b], mask=none[b])], names=["query_id", name, "score"])


class _Vectors:
    """A column of lists as flat numbers; the length of a null, or of one that holds a null, is -1."""

    def __init__(self, column: pa.Array) -> None:
        self.length = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        there = np.maximum(self.length, 0)
        self.start = np.cumsum(there) - there
        flat = column.flatten()
        self.values = flat.to_numpy(zero_copy_only=False).astype(float)
        if flat.null_count:
            self.length[np.repeat(np.arange(len(there)), there)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and matrix of the vectors of a length."""
        at = np.flatnonzero(self.length == length)
        whole = len(at) == len(self.length) and len(self.values) == len(at) * length
        return at, self.values.reshape(len(at), length) if whole else self.values[self.start[at, None] + np.arange(length)]


class Dots:
    """Inner products of rows (key, vector) with queries, to six places, each the sum of double products from first to last.

    A vector of another length than the query's, a null and one with a null in it have no score and rank last, as in SQL.
    """

    def __init__(self, queries: pa.Array, ids: pa.Array, k: int) -> None:
        self.queries, self.ids, self.k = queries, ids, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, asked, name = len(self.ids), _Vectors(self.queries), ""
        groups = {x: asked.of(x) for x in sorted(set(asked.length.tolist()) - {-1})}
        norm = np.zeros(n)
        with np.errstate(over="ignore", invalid="ignore"):
            for at, q in groups.values():
                norm[at] = np.sqrt((q * q).sum(1))
        best, step = Best(n, self.k, 1e-6, -np.inf), max(64, SLICE // max(1, n))
        for whole in batches:
            name = whole.schema.names[0]
            width = len(whole.column(1).flatten()) // max(1, whole.num_rows)
            few = max(64, min(step, SLICE // 2 // max(1, width)))
            for batch in (whole.slice(i, few) for i in range(0, whole.num_rows, few)):
                rows = _Vectors(batch.column(1))

                def in_order(row: np.ndarray, query: np.ndarray) -> np.ndarray:
                    out = np.zeros(len(row))
                    with np.errstate(all="ignore"):
                        for length in set(rows.length[row].tolist()):
                            at = np.flatnonzero(rows.length[row] == length)
                            a, b, total = rows.start[row[at]], asked.start[query[at]], np.zeros(len(at))
                            for i in range(length):
                                total += rows.values[a + i] * asked.values[b + i]
                            out[at] = total
                    return np.select([np.isnan(out), out == np.inf, out == -np.inf], [np.inf, _MOST, -_MOST], out)

                scores, slack = np.full((batch.num_rows, n), -np.inf), np.zeros(n)
                with np.errstate(all="ignore"):
                    for length, (columns, q) in groups.items():
                        at, x = rows.of(length)
                        if not len(at):
                            continue
                        made = x @ q.T
                        # ufuncs' errors of a product: its length times the precision times both norms
                        slack[columns] = 4 * max(1, length) * 2.3e-16 * norm[columns] * np.sqrt((x * x).sum(1).max())
                        odd = np.nonzero(~np.isfinite(made))
                        if len(odd[0]):
                            made[odd] = in_order(at[odd[0]], columns[odd[1]])
                        if len(at) == batch.num_rows and len(columns) == n:
                            scores = made
                        else:
                            scores[np.ix_(at, columns)] = made
                slack = np.minimum(np.nan_to_num(slack, nan=1e300, posinf=1e300), 1e300)

                def exact(row: np.ndarray, query: np.ndarray, raw: np.ndarray) -> np.ndarray:
                    with np.errstate(all="ignore"):
                        y = raw * 1e6
                        # whatever lies so near to a half that the order of the sum may decide is summed in order
                        doubt = np.flatnonzero((np.abs(raw) < _MOST) & ~(np.abs(np.abs(y - np.floor(y)) - 0.5) > 1e6 * slack[query] + 1e-9 * np.maximum(1, np.abs(y) * 1e-6)))
                    raw[doubt] = in_order(row[doubt], query[doubt])
                    return np.where(np.abs(raw) < _MOST, rounded(raw, 1e6), raw)

                best.add(scores, batch.column(0), exact, slack)
        yield from best.batches(self.ids, name)



def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) cut to a bounded number of bytes, a row at least."""
    for whole in batches:
        reach = np.cumsum(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < whole.num_rows:
            b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + BYTES, "right")))
            yield whole.slice(a, b - a)
            a = b


class Words:
    """Rows (key, text) against the terms of a block of queries: how many rows hold each term, or BM25 scores."""

    def __init__(self, terms: pa.Array) -> None:
        self.terms = terms

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of batches with the lengths of their rows, and row, term and count of each known term in a row, by row."""
        for batch in parts(batches):
            found, length = words(batch.column(1))
            at = pc.index_in(found, value_set=self.terms)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            code = np.repeat(np.arange(len(length)), length)[known] * max(1, len(self.terms)) + at.drop_null().to_numpy()
            code, tf = np.unique(code, return_counts=True)
            yield batch, length, code // max(1, len(self.terms)), code % max(1, len(self.terms)), tf

    def frequencies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows term (its place), df, counted over a task; at place -1 the rows, at -2 the words of all of them."""
        df, rows, total = np.zeros(len(self.terms), np.int64), 0, 0
        for _, length, _, term, _ in self.postings(batches):
            df += np.bincount(term, minlength=len(df))
            rows, total = rows + len(length), total + int(length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int32()), pa.array([rows, total], pa.int64())], names=["term", "df"])
        for a in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 50_000].astype(np.int32)), pa.array(df[at[a : a + 50_000]])], names=["term", "df"])


class Bm25(Words):
    """The best k rows of each query (term and query of each pair: ``term``, sorted, and ``owner``).

    Terms that many rows and many queries hold go by a dense product, all others by postings. Weights are multiples of a
    power of two so small that all their sums are exact: equal texts have equal scores, whatever the order of the sum.
    """

    def __init__(self, terms: pa.Array, ids: pa.Array, term: np.ndarray, owner: np.ndarray, idf: np.ndarray, share: np.ndarray, average: float, k: int, k1: float, b: float, least: np.ndarray | None = None) -> None:
        super().__init__(terms)
        self.ids, self.owner, self.idf, self.average, self.k, self.k1, self.b, self.least = ids, owner.astype(np.int32), idf, average, k, k1, b, least
        self.cuts = np.searchsorted(term, np.arange(len(terms) + 1))
        most = np.bincount(owner, idf[term] * (k1 + 1), minlength=1).max()
        self.quantum = 2.0 ** (np.ceil(np.log2(max(most, 1e-9))) - 51)
        worth = share * np.diff(self.cuts) / max(1, len(ids))
        order = np.argsort(-worth, kind="stable")[: 2 * SLICE // max(1, len(ids))]
        self.dense = order[worth[order] >= DENSE]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, name, times = len(self.ids), "", np.diff(self.cuts)
        column = np.full(len(self.terms), -1)
        column[self.dense] = np.arange(len(self.dense))
        matrix = np.zeros((len(self.dense), n))
        for i, term in enumerate(self.dense.tolist()):
            matrix[i, self.owner[self.cuts[term] : self.cuts[term + 1]]] = 1
        best, step = Best(n, self.k, 1e-9, 5e-324, self.least), max(64, SLICE // max(1, n))
        for batch, length, row, term, tf in self.postings(batches):
            name = batch.schema.names[0]
            weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row] / self.average))
            weight = np.rint(weight / self.quantum) * self.quantum
            for a in range(0, batch.num_rows, step):
                m = min(step, batch.num_rows - a)
                i, j = np.searchsorted(row, (a, a + m))
                here, which, w = row[i:j] - a, term[i:j], weight[i:j]
                place = column[which]
                often = place >= 0
                held = np.zeros((m, len(self.dense)))
                held[here[often], place[often]] = w[often]
                scores = held @ matrix
                here, which, w = here[~often], which[~often], w[~often]
                self._add(scores.reshape(-1), here * n, which, w, times)
                best.add(scores, batch.column(0).slice(a, m), lambda r, q, raw: raw.round(9))
        yield from best.batches(self.ids, name)

    def _add(self, scores: np.ndarray, base: np.ndarray, term: np.ndarray, weight: np.ndarray, times: np.ndarray) -> None:
        """Postings meet their queries in slices of bounded size, however many queries hold a term."""
        reach = np.cumsum(times[term])
        edges = np.searchsorted(reach, np.arange(0, (reach[-1] if len(reach) else 0) + SLICE // 2, SLICE // 2), "right")
        for a, b in zip(edges[:-1].tolist(), [*edges[1:-1].tolist(), len(term)]):
            each = times[term[a:b]]
            first = np.cumsum(each) - each
            at = np.arange(each.sum()) + np.repeat(self.cuts[term[a:b]] - first, each)
            np.add.at(scores, self.owner[at] + np.repeat(base[a:b], each), np.repeat(weight[a:b], each))


class Held(Words):
    """Which passages the rows (key, text) hold: by the rarest inner word of each, then by text."""

    def __init__(self, ids: pa.Array, passages: pa.Array) -> None:
        found, length = words(passages)
        found = found.dictionary_encode()
        super().__init__(found.dictionary)
        self.ids, self.passages = ids, passages.to_pylist()
        end = np.cumsum(length)
        places = found.indices.to_numpy()
        self.inner = [places[b - n + 1 : b - 1] for b, n in zip(end.tolist(), length.tolist())]
        self.short = np.flatnonzero(length < 3).tolist()

    def by_rarest(self, term: np.ndarray, df: np.ndarray) -> Held:
        """With the frequencies of terms; a passage with an inner word that no row has is nowhere."""
        count = np.zeros(len(self.terms), np.int64)
        count[term] = df
        terms = np.array(self.terms.to_pylist(), object)
        self.at: dict[int, list[int]] = {}
        for i, inner in enumerate(self.inner):
            if len(inner):
                least = inner[count[inner] == count[inner].min()]
                self.at.setdefault(int(least[0]), []).append(i)
        # only those words are looked for
        used = sorted(self.at)
        self.at = {place: self.at[x] for place, x in enumerate(used)}
        self.terms = pa.array(terms[used].tolist(), pa.string())
        self.inner = []
        return self

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, row, term, _ in self.postings(batches):
            texts, pairs = batch.column(1), []
            for r, t in zip(row.tolist(), term.tolist()):
                text = texts[r].as_py()
                pairs += [(i, r) for i in self.at[t] if self.passages[i] in text]
            for i in self.short:
                pairs += [(i, r) for r in np.flatnonzero(pc.match_substring(texts, self.passages[i]).fill_null(False).to_numpy(zero_copy_only=False)).tolist()]
            query, at = (pa.array(x, pa.int64()) for x in (zip(*pairs) if pairs else ((), ())))
            yield pa.RecordBatch.from_arrays([self.ids.take(query), batch.column(0).take(at)], names=["query_id", batch.schema.names[0]])


class Saturated:
    """Weights of words in rows (key, text) without the idf: each posting's, or their sums by word."""

    def __init__(self, average: float, k1: float, b: float) -> None:
        self.average, self.k1, self.b = average, k1, b

    def _of(self, batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        found, length = words(batch.column(1))
        found = found.dictionary_encode()
        size = max(1, len(found.dictionary))
        code, tf = np.unique(np.repeat(np.arange(len(length)), length) * size + found.indices.to_numpy(), return_counts=True)
        row, term = code // size, code % size
        return found.dictionary, row, term, tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row] / self.average))

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            terms, _, term, sat = self._of(batch)
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(term, minlength=len(terms))), pa.array(np.bincount(term, sat, minlength=len(terms)))], names=["term", "df", "sat"])

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            terms, row, term, sat = self._of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(sat)], names=[batch.schema.names[0], "term", "sat"])
