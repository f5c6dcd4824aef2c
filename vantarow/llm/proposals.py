"""Inside one block of columns: which pairs of rows may reach the threshold, as a spanning forest.

A block is a set of columns of the incidence matrix with their rows. Every pair of rows that meet in a
column is bounded from above by the sizes, by the places of the column in both rows, and by parity
sketches: each set folded to at least as many bits as it has elements (in later rounds, for the few rows
that come again, to WIDER times as many), a bit being the parity of the elements that fall on it. Two sets differ in at least as many elements as their sketches differ in
bits, so no pair above the threshold is lost. Of what survives, only the edges of a spanning forest
leave the block, however large a group of near copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from vantarow.llm.common import lean, packed

#: Pairs of a block that are held before repeats are taken out.
HELD = 2_000_000
FOREST = pa.schema([(k, pa.int64()) for k in ("gram", "part", "task", "tree", "a", "b", "apart")])


#: Bits of a wide sketch for one of a narrow sketch.
WIDER = 4


def sketch(grams: np.ndarray, wider: int = 1) -> bytes:
    """Parities of how many grams fall on each bit; a power of two of bits, at least ``wider`` times as many as grams."""
    width = wider * max(64, 1 << (len(grams) - 1).bit_length())
    at = (grams & np.uint64(width - 1)).astype(np.int64)
    return packed(np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little"))


class _Rows:
    """Distinct documents of a block: size, component, sketch."""

    def __init__(self, doc: np.ndarray, size: np.ndarray, comp: np.ndarray, sketches: list[bytes], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.doc, first, self.at = np.unique(doc, return_index=True, return_inverse=True)
        self.size = size[first]
        _, self.comp = np.unique(comp[first], return_inverse=True)
        own = [sketches[i] for i in first]
        self.width = np.array([len(x) for x in own], np.int64)
        self.slot, self.bits = np.zeros(len(own), np.int64), {}
        for width in np.unique(self.width):
            some = np.flatnonzero(self.width == width)
            self.slot[some] = np.arange(len(some))
            self.bits[int(width)] = np.frombuffer(b"".join(own[i] for i in some), np.uint64).reshape(len(some), -1)

    def need(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least number of common elements of two rows that reach the threshold."""
        return -(-self.num * (self.size[i] + self.size[j]) // (self.num + self.den))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows differ; the wider one is folded to the width of the other."""
        out = np.empty(len(i), np.int64)
        big, small = np.maximum(self.width[i], self.width[j]), np.minimum(self.width[i], self.width[j])
        wide = np.where(self.width[i] >= self.width[j], i, j)
        thin = i + j - wide
        for kind in np.unique(big * (1 << 32) + small):
            w, s = int(kind) >> 32, int(kind) & ((1 << 32) - 1)
            of = np.flatnonzero((big == w) & (small == s))
            step = max(1, (1 << 22) // w)
            for k in range(0, len(of), step):
                part = of[k : k + step]
                bits = self.bits[w][self.slot[wide[part]]]
                while bits.shape[1] * 8 > s:
                    half = bits.shape[1] // 2
                    bits = bits[:, :half] ^ bits[:, half:]
                out[part] = np.bitwise_count(bits ^ self.bits[s][self.slot[thin[part]]]).sum(1)
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs the sketches leave, and how far apart those are."""
        apart = self.apart(i, j)
        left = np.flatnonzero(apart <= self.size[i] + self.size[j] - 2 * self.need(i, j))
        return left, apart[left]


class _Forest:
    """Components that edges join; an edge of one component adds nothing."""

    def __init__(self, n: int) -> None:
        self.above = list(range(n))

    def top(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _partners(rows: _Rows, at: np.ndarray, place: np.ndarray, home: np.ndarray, start: np.ndarray, length: np.ndarray, dense: int, old: np.ndarray) -> np.ndarray:
    """Codes (i * rows + j) of distinct pairs of the columns: all of short ones, close neighbours of the others."""
    n, held, count = len(rows.doc), [], 0
    size, comp = rows.size[at], rows.comp[at]
    run, where = np.repeat(length, length), np.arange(len(at))
    end = np.repeat(start + length, length)
    for r in range(1, dense):
        where = where[(where + r < end[where]) & ((run[where] <= dense) | (r < 3))]
        if not len(where):
            break
        i, j = where, where + r
        left = rows.size[at[i]] + rows.size[at[j]]
        need = -(-rows.num * left // (rows.num + rows.den))
        fits = (comp[i] != comp[j]) & (size[i] * rows.den >= size[j] * rows.num) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= need) & (home[i] | home[j])
        a, b = at[i[fits]], at[j[fits]]
        held.append(np.minimum(a, b) * n + np.maximum(a, b))
        count += len(a)
        if count > HELD:
            held = [np.unique(np.concatenate(held))]
            count = len(held[0])
    codes = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
    return codes[~np.isin(codes, old)] if len(old) else codes


def _long_column(rows: _Rows, forest: _Forest, at: np.ndarray, home: np.ndarray, place: np.ndarray, old: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Edges of one long column (rows by size): each row outside its largest tree takes the nearest row of every other tree."""
    size = rows.size[at]
    tree = np.array([forest.top(x) for x in rows.comp[at].tolist()])
    kinds, counts = np.unique(tree, return_counts=True)
    if len(kinds) < 2:
        return
    main = kinds[np.argmax(counts)]
    for k in np.flatnonzero(tree != main).tolist():
        if tree[k] == main:
            continue
        lo, hi = np.searchsorted(size, [-(-size[k] * rows.num // rows.den), size[k] * rows.den // rows.num + 1], "left")
        others = np.arange(lo, hi)
        others = others[(tree[others] != tree[k]) & (home[others] | home[k])]
        i = np.full(len(others), at[k])
        fits = np.minimum(size[k] - place[k], size[others] - place[others]) >= rows.need(i, at[others])
        others, i = others[fits], i[fits]
        if len(old) and len(others):
            codes = np.minimum(i, at[others]) * len(rows.doc) + np.maximum(i, at[others])
            others = others[~np.isin(codes, old)]
            i = i[: len(others)]
        if not len(others):
            continue
        left, apart = rows.near(i, at[others])
        order = np.lexsort((at[others[left]], apart))
        _, best = np.unique(tree[others[left]][order], return_index=True)
        for x in order[best].tolist():
            other = others[left[x]]
            if forest.join(int(rows.comp[at[k]]), int(rows.comp[at[other]])):
                yield int(at[k]), int(at[other]), int(apart[x])
        joined = np.isin(tree, np.append(tree[others[left]], tree[k]))
        tree[joined] = forest.top(int(tree[k]))
        main = forest.top(int(main))


@lean
def propose(batches: Iterator[pa.RecordBatch], num: int, den: int, dense: int, forests: int) -> Iterator[pa.RecordBatch]:
    """Edges of ``forests`` spanning forests, disjoint in edges, of the pairs that no bound excludes in this block.

    Rows come by column, then size: gram, part, doc, n, place, comp, home, sketch, other. A row with ``other``
    is a pair that an exact count has refuted. Two rows are compared if at least one is at home here.
    """
    cells: list[tuple] = []
    sketches, refuted = [], []
    for batch in batches:
        other = batch.column(8)
        whole = batch.filter(other.is_null())
        if whole.num_rows:
            cells.append(tuple(whole.column(k).to_numpy(zero_copy_only=False) for k in range(7)))
            sketches += whole.column(7).to_pylist()
        gone = batch.filter(other.is_valid())
        refuted += zip(gone.column(2).to_pylist(), gone.column(8).to_pylist())
    if not cells:
        return
    gram, part, doc, size, place, comp, home = (np.concatenate([c[k] for c in cells]) for k in range(7))
    home = home.astype(bool)
    rows = _Rows(doc, size, comp, sketches, num, den)
    del sketches, cells
    at, n = rows.at, len(rows.doc)
    if len(np.unique(rows.comp)) < 2:
        return
    start = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
    length = np.diff(np.r_[start, len(gram)])
    old = np.empty(0, np.int64)
    if refuted:
        a, b = np.array(refuted, np.int64).T
        known = np.isin(a, rows.doc) & np.isin(b, rows.doc)
        a, b = np.searchsorted(rows.doc, a[known]), np.searchsorted(rows.doc, b[known])
        old = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    codes = _partners(rows, at, place, home, start, length, dense, old)
    near, apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(codes), HELD):
        left, far = rows.near(codes[k : k + HELD] // n, codes[k : k + HELD] % n)
        near.append(codes[k : k + HELD][left])
        apart.append(far)
    near, apart = np.concatenate(near), np.concatenate(apart)
    order = np.lexsort((near, apart))
    near, apart = near[order], apart[order]
    edges: list[tuple[int, int, int]] = []
    trees = None
    for _ in range(forests):
        forest, before = _Forest(int(rows.comp.max()) + 1), len(edges)
        taken = np.zeros(len(near), bool)
        for k, (i, j, far) in enumerate(zip((near // n).tolist(), (near % n).tolist(), apart.tolist())):
            if forest.join(int(rows.comp[i]), int(rows.comp[j])):
                edges.append((i, j, far))
                taken[k] = True
        for s, m in zip(start[length > dense].tolist(), length[length > dense].tolist()):
            edges += _long_column(rows, forest, at[s : s + m], home[s : s + m], place[s : s + m], old)
        trees = trees or forest
        if len(edges) == before:
            break
        near, apart = near[~taken], apart[~taken]
        old = np.union1d(old, [min(i, j) * n + max(i, j) for i, j, _ in edges])
    if edges:
        i, j, far = np.array(edges, np.int64).T
        a, b = np.minimum(rows.doc[i], rows.doc[j]), np.maximum(rows.doc[i], rows.doc[j])
        tree = np.array([trees.top(x) for x in rows.comp[i].tolist()])
        context = TaskContext.get()
        same = np.ones(len(a), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[0] * same, part[0] * same, (context.partitionId() if context else 0) * same, tree, a, b, far)], schema=FOREST)
