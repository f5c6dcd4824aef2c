"""Best-fit packing by bin completion.

Documents are tokenised once into pieces of at most ``size`` tokens. Only lengths matter for packing, and
there are at most ``size`` of them, so the search runs on their histogram: branch-and-bound over bins,
each holding the largest length left and one of the undominated fillings around it. The plan (patterns of
lengths with multiplicities) is bounded by the number of lengths, never by the number of documents;
pieces take their places in it by their rank among pieces of the same length, counted in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantarow.llm.common import STEP, _pieces, keep, lean, packed, scan, texts_of

#: Distinct units, and ids of them, that a worker remembers.
MEMO, MEMO_IDS = 1_500_000, 7_500_000
#: Units that the tokenizer gets in one call; what it returns takes a hundred times the room of the ids.
CALL = 4096
#: Strings that the tokenizer takes whole out of a text; texts with one are encoded in one call.
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) != "'" for i in range(256)])


class _Memo:
    """Ids of units by their hash: sorted keys, and for each a slice of one pool of ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin = self.size = np.empty(0, np.uint32)
        self.pool = np.empty(0, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def at(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions of distinct, sorted ``keys`` in the memo; unknown ones are encoded, a bounded number at a time."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != keys[inner]
        if new.any():
            if len(self.keys) and (len(self.keys) + new.sum() > MEMO or len(self.pool) > MEMO_IDS):
                self.clear()
                return self.at(keys, raw, starts, ends)
            firsts, lasts = starts[new].tolist(), ends[new].tolist()
            sizes, pool = [], [self.pool]
            for k in range(0, len(firsts), CALL):
                units = [raw[a:b].decode() for a, b in zip(firsts[k : k + CALL], lasts[k : k + CALL])]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
                sizes += map(len, ids)
                pool.append(np.fromiter(chain.from_iterable(ids), self.kind))
            size = np.array(sizes, np.uint32)
            begin = len(self.pool) + np.cumsum(size, dtype=np.int64) - size
            self.pool = np.concatenate(pool)
            self.keys, self.begin, self.size = (np.insert(old, at[new], more) for old, more in ((self.keys, keys[new]), (self.begin, begin), (self.size, size)))
            at = np.searchsorted(self.keys, keys)
        return at


@lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Memo(path)


def _encode(part: np.ndarray, cuts: np.ndarray, memo: _Memo) -> list[np.ndarray]:
    """Ids of the texts that ``cuts`` divide ``part`` into, by distinct units.

    Units are words, cut between an ASCII letter and an ASCII mark (not the apostrophe): the tokenizer
    never joins the two, drops white space and folds case, so ids of units in a row are those of the text.
    """
    edge = np.flatnonzero((_LETTER[part[:-1]] & _MARK[part[1:]]) | (_MARK[part[:-1]] & _LETTER[part[1:]])) + 1 if len(part) > 1 else np.empty(0, np.int64)
    starts, ends, hashes = scan(part, np.unique(np.concatenate([cuts, edge])), lower=True)
    owner = np.searchsorted(starts, cuts, "left")
    if not len(starts):
        return [np.empty(0, np.uint32)] * (len(cuts) - 1)
    keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    at = memo.at(keys, part.tobytes(), starts[first], ends[first])
    begin, size = (x[at].astype(np.int64)[inverse] for x in (memo.begin, memo.size))
    ends_at = np.cumsum(size)
    ids = memo.pool[np.arange(ends_at[-1]) + np.repeat(begin - (ends_at - size), size)].astype(np.uint32)
    edges = np.r_[0, ends_at][owner]
    return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]


def token_ids(column: pa.Array, path: str, step: int = STEP) -> Iterator[tuple[int, np.ndarray]]:
    """Row and token ids of every text of a column, equal to encoding each whole text."""
    memo = _memo(path)
    data, offs = texts_of(column)
    row, n = 0, len(offs) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + step, "right")) - 1)
        part = data[offs[row] : offs[to]]
        raw = part.tobytes() if len(part) else b""
        if any(s in raw for s in _SPECIAL):
            for i in range(row, to):
                one = data[offs[i] : offs[i + 1]]
                if any(s in one.tobytes() for s in _SPECIAL):
                    yield i, memo.whole(one.tobytes().decode())
                else:
                    yield i, _encode(one, np.array([0, len(one)]), memo)[0]
        elif to == row + 1 and len(part) > 2 * step:
            yield row, np.concatenate([_encode(part[a:b], np.array([0, b - a]), memo)[0] for a, b in _pieces(part, "plain")])
        else:
            for i, ids in enumerate(_encode(part, offs[row : to + 1] - offs[row], memo)):
                yield row + i, ids
        row = to


@lean
def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column(0).to_pylist()
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for i, ids in token_ids(batch.column(1), path):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            for k, a in enumerate(range(0, len(ids), size)):
                piece = ids[a : a + size]
                for name, value in zip(out, (docs[i], k, a, len(piece), zlib.crc32(packed(piece)))):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})


class _Counts:
    """Lengths that are left, with the next smaller one of any value found fast."""

    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.n = np.zeros(size + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v

    def below(self, value: int) -> int:
        """Largest length left that is at most ``value``; 0 if none."""
        if value <= 0:
            return 0
        found = np.flatnonzero(self.n[1 : value + 1])
        return int(found[-1]) + 1 if len(found) else 0


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: patterns of lengths and how often each is used.

    Runs over open bins by their free room, equal bins together; the first incumbent of the search.
    """
    free: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(size + 1, np.int64)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                k = size // length
                for pattern, times in (((length,) * k, left // k), ((length,) * (left % k), 1)):
                    if pattern and times:
                        room = size - sum(pattern)
                        free.setdefault(room, {}).setdefault(pattern, 0)
                        free[room][pattern] += times
                        rooms[room] += times
                break
            room = int(fit[0]) + length
            pattern, times = next(iter(free[room].items()))
            take = min(times, left)
            if take == times:
                del free[room][pattern]
            else:
                free[room][pattern] -= take
            rooms[room] -= take
            new = (*pattern, length)
            free.setdefault(room - length, {}).setdefault(new, 0)
            free[room - length][new] += take
            rooms[room - length] += take
            left -= take
    return [(p, t) for patterns in free.values() for p, t in patterns.items()]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the lengths of ``b`` fit, first fit decreasing, into bins as large as those of ``a``: then ``a`` is never worse."""
    room = sorted(a, reverse=True)
    for x in sorted(b, reverse=True):
        k = next((i for i, y in enumerate(room) if y >= x), None)
        if k is None:
            return False
        room[k] -= x
    return True


def fillings(left: _Counts, room: int, most: int, tries: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first, then those of fewer and larger lengths.

    Lengths are tried from the largest; a filling that another equals in each place or exceeds is
    dominated and left out, as is one to which a length left could still be added. Equal lengths are one step
    with a multiplicity, so a path has no more steps than different lengths fit. ``tries`` bounds the steps after
    the first filling, which is always found.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    best, budget = [-1], [tries]

    def walk(room_left: int, top: int, chosen: tuple[int, ...]) -> bool:
        budget[0] -= 1
        length = left.below(min(top, room_left))
        if not length:
            total = room - room_left
            if total > best[0] or total == best[0] and len(found) < most:
                best[0] = max(best[0], total)
                found.append((total, chosen))
            return total == room and len([1 for t, _ in found if t == room]) >= most
        while length and (budget[0] > 0 or not found):
            for times in range(min(int(left.n[length]), room_left // length), 0, -1):
                if budget[0] <= 0 and found:
                    return False
                if walk(room_left - times * length, length - 1, chosen + (length,) * times):
                    return True
            # all that is filled from here on has lengths below; it can only be undominated if it gets fuller
            length = left.below(length - 1)
            if length and best[0] == room and len(found) >= most:
                return True
        return False

    walk(room, room, ())
    ranked = sorted(set(found), key=lambda x: (-x[0], len(x[1]), tuple(-y for y in x[1])))
    out: list[tuple[int, ...]] = []
    for _, x in ranked:
        if len(out) < most and not any(_dominates(y, x) for y in out):
            out.append(x)
    return out


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that no packing can do without: total length, and the waste bounds of dual feasible functions.

    How many pieces of at least some length fit into a bin gives one. A function that gives each length a share of
    a bin, so that what fits into a bin never sums to over 1, gives another by its sum. Two kinds are tried: lengths over ``size - e`` take a whole bin and those under ``e``
    nothing (for every e up to half a bin), and lengths rounded to k-ths of a bin (up to 1/20), alone and over
    the first kind.
    """
    lengths = np.array(sorted(k for k in counts if counts[k] > 0), np.int64)
    if not len(lengths):
        return 0
    n = np.array([counts[k] for k in lengths.tolist()], np.int64)
    best = -(-int((lengths * n).sum()) // size)
    # so many pieces are at least this long, and so many of those fit into one bin
    best = max(best, int((-(-np.cumsum(n[::-1]) // (size // lengths[::-1]))).max()))
    cuts = np.unique(np.r_[1, lengths[lengths <= size // 2], size - lengths[lengths > size // 2] + 1])
    for cut in cuts[(cuts >= 1) & (cuts <= size // 2)].tolist():
        shares = np.where(lengths > size - cut, size, np.where(lengths < cut, 0, lengths))
        best = max(best, -(-int((shares * n).sum()) // size))
    for k in range(1, 21):
        # in units of 1 / (size * k): a length that is a whole number of (k + 1)-ths keeps its share
        whole = (lengths * (k + 1)) % size == 0
        rounded = np.where(whole, lengths * k, (lengths * (k + 1)) // size * size)
        best = max(best, -(-int((rounded * n).sum()) // (size * k)))
        for cut in cuts[(cuts >= 1) & (cuts <= size // 2)].tolist()[:: max(1, len(cuts) // 64)]:
            shares = np.where(lengths > size - cut, size * k, np.where(lengths < cut, 0, rounded))
            best = max(best, -(-int((shares * n).sum()) // (size * k)))
    return best


def _search(counts: dict[int, int], size: int, most: int, tries: int, nodes: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """Depth-first branch and bound over fillings, from best-fit decreasing as the first incumbent."""
    best = best_fit(counts, size)
    best_bins = sum(t for _, t in best)
    left = _Counts(counts, size)
    budget = nodes

    def use(big: int, filling: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        pattern = (big, *filling)
        kinds, used = np.unique(pattern, return_counts=True)
        times = int((left.n[kinds] // used).min())
        left.n[kinds] -= times * used
        return pattern, times

    def plan_list(plan) -> list:
        out = []
        while plan:
            plan, step = plan
            out.append(step)
        return out[::-1]

    # first choices are followed in a loop, so that depth costs no stack; branch points are kept for later
    stack = [(0, sum(k * v for k, v in counts.items()), (), None)]
    while stack and budget > 0 and best_bins > least:
        bins, tokens, plan, restore = stack.pop()
        if restore is not None:
            left.n[:] = restore
        while budget > 0:
            budget -= 1
            if bins + -(-tokens // size) >= best_bins:
                break
            big = left.below(size)
            if not big:
                best, best_bins = plan_list(plan), bins
                break
            left.n[big] -= 1
            options = fillings(left, size - big, most, tries)
            left.n[big] += 1
            for other in options[:0:-1]:
                if len(stack) < 64:
                    snapshot = left.n.copy()
                    b, t = use(big, other)
                    stack.append((bins + t, tokens - t * sum(b), (plan, (b, t)), left.n.copy()))
                    left.n[:] = snapshot
            pattern, times = use(big, options[0])
            bins, tokens, plan = bins + times, tokens - times * sum(pattern), (plan, (pattern, times))
    return best


def complete(counts: dict[int, int], size: int, most: int = 3, tries: int = 300, nodes: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion: patterns of lengths, each with its multiplicity, in as few bins as the search finds.

    Branches over the ``most`` best undominated fillings around the largest length left. A filling is used at
    once as often as the counts allow. A branch is cut when its bins, with the least that its remaining lengths
    need, can't beat the incumbent; the search ends on a plan that meets :func:`lower_bound`. Where it doesn't
    get there, further incumbents set the largest lengths apart (they take best-fit bins of their own) and
    search over the others. ``tries`` and ``nodes`` bound the work; they depend on no input.
    """
    least = lower_bound(counts, size)
    best = _search(counts, size, most, tries, nodes, least)
    bins = sum(t for _, t in best)
    lengths = sorted((k for k in counts if counts[k] > 0), reverse=True)
    for k in range(1, 13):
        if bins <= least or len(lengths) < 3:
            break
        apart = {x: counts[x] for x in lengths[: max(1, len(lengths) * k // 40)]}
        rest = {x: counts[x] for x in lengths if x not in apart}
        own = best_fit(apart, size)
        used = sum(t for _, t in own)
        plan = own + _search(rest, size, most, tries, nodes // 12, max(lower_bound(rest, size), least - used))
        if sum(t for _, t in plan) < bins:
            best, bins = plan, sum(t for _, t in plan)
    return best


def _places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): where the ranks of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


@lean
def _assign(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (places[:, 0] << 44) | places[:, 1]
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
        at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
        yield pa.RecordBatch.from_pydict(
            {**{k: batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": places[at, 2] + rank - places[at, 1], "offset": places[at, 3]}
        )


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, search: dict | None = None) -> DataFrame:
    """Tokenise documents and pack their pieces into sequences of at most ``size`` tokens.

    ``documents``: doc_id (unique long) and text; other columns are ignored, whatever their names. A document
    is its ids and then ``end``; a null or empty text is ``end`` alone. Longer documents are cut into pieces of
    ``size``, the last may be shorter. Rows with a null doc_id are packed too (their doc_id stays null);
    repeated rows are packed each; an empty table gives an empty result. ``tokenizer``: path of a file of
    the tokenizers library. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = keep(docs.mapInArrow(partial(_cut, path=tokenizer, size=size, end=end), schema), "pieces")
    # a length that a third of all pieces share is ranked in many parts: each part counts its own, offsets join them
    salts = max(256, pieces.count() // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "salt", "before")
    counts = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = _places(complete(counts, size, **(search or {})))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("local", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", (F.col("before") + F.col("local")).cast("long"))
    ranked = keep(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), "ranked")
    return ranked.mapInArrow(partial(_assign, places=places), f"{schema}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark, sf_dir: str) -> DataFrame:
    """Place of every piece of ``documents``; see :func:`pack`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
