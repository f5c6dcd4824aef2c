"""Manifests, vector codes and chat trees against plain versions, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantarow.llm import chat_tree, merkle, vector_codes


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest -------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, n long, kids string, one long, given long, run int, claim string, digest string, leaf string"


def docs_table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, "x", 1, 2, "k", 3, 4, 5, "c", "d", "l") for d, t, lang, s, n in rows], DOCS)


def plain_manifest(rows, claimed):
    """The contract by lists: rows (doc_id, text, lang, source, n_chars)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(enc(r[0]) + enc(r[3]) + enc(r[2]) + enc(r[4]) + enc(text))

    def climb(nodes):
        """Digest of the last node and, per node, its siblings (left, right) level by level."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
                ways[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
                at[i] = p // 16
            nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        return nodes[0], ways

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = (own, *climb([leaf(r, r[1]) for r in own]))
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways):
            path = way + top
            now = leaf(r, claimed(r))
            for left, right in path:
                now = sha(left + now + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in path)), now, now == root))
    return Counter(out)


def tampered(r):
    return r[1].translate({i: i + 32 for i in range(65, 91)}) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]


def lowered():
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def manifest_rows(sizes):
    r = random.Random(5)
    rows = [(i * 7 - 50, r.choice(["Ab", "", None, "É z", "lower"]), r.choice(["en", None]), s, r.choice([None, 3])) for s, n in sizes.items() for i in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "a": 17}, {"hot": 300, "b": 16, None: 33, "": 1, "é": 2, "z": 257}, {f"s{i}": 1 + i % 3 for i in range(40)}], ids=["one", "two", "hot", "many"])
def test_manifest_equals_the_plain_one(spark, sizes):
    rows = manifest_rows(sizes)
    got = Counter(tuple(r) for r in merkle.verify(docs_table(spark, rows), lowered()).collect())
    assert got == plain_manifest(rows, tampered)


def test_manifest_of_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "A", "en", "s", 1), (3, "X" * 2_000_000, "en", "s", 2), (3, "X" * 2_000_000, "en", "s", 2), (3, "", "en", "s", 2), (5, None, "en", "s", None)]
    rows += [(6, "A", "en", "s", 1)] * 40
    found = merkle.verify(docs_table(spark, rows), lowered())
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(tuple(r) for r in found.collect())
    want = plain_manifest(rows, tampered)
    assert got == want and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_nothing(spark):
    assert merkle.verify(docs_table(spark, []), lowered()).collect() == []


def test_any_change_breaks_the_proof(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(60)]
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit(".")))
    got = {r.doc_id: r.verified for r in merkle.verify(docs_table(spark, rows), changed).collect()}
    assert got == {i: i % 7 != 0 for i in range(60)}


# --- vector codes ---------------------------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<double>, label int, code string, ints string, error long, sums string, of int"


def vec_table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", "i", 1, "s", 2) for i, v, lab in rows], VECS)


def plain_codes(rows, rounds=6, entries=16):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(4096 * c)) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), 8, -1)
    first = {}
    for (i, _, _), row in zip(kept, x.reshape(len(kept), -1).tolist()):
        if i is not None:
            first[i] = min(first.get(i, row), row)
    books = np.array([first[i] for i in sorted(first)[:entries]], np.int64).reshape(-1, 8, x.shape[2]).transpose(1, 0, 2)

    def nearest():
        far = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        code, _ = nearest()
        new = books.copy()
        for p in range(8):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    new[p, e] = own.sum(0) // len(own)
        books = new
    code, far = nearest()
    digest = sha(",".join(map(str, books.ravel().tolist())))
    return Counter((i, lab, bytes(c.astype(np.uint8)).hex(), int(e.sum()), digest) for (i, _, lab), c, e in zip(kept, code, far))


def vectors(n, width=16, seed=1, coarse=False):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    v = centres[r.integers(0, 5, n)] + r.normal(scale=0.3, size=(n, width))
    v = np.round(v * 2) / 2 if coarse else v
    return [(i * 3 % (n + 1), row.tolist(), None if i % 9 == 0 else i % 4) for i, row in enumerate(v)]


@pytest.mark.parametrize("coarse", [False, True], ids=["smooth", "ties"])
def test_codes_equal_full_scans(spark, coarse):
    rows = vectors(400, coarse=coarse)
    rows += [(-5, None, 1), (-4, [None] * 16, 1), (-3, [float("nan")] + [0.0] * 15, 1), (-2, [float("inf")] + [0.0] * 15, 1), (None, [0.5] * 16, 2)] + [rows[7]] * 30 + [(rows[3][0], [9.0] * 16, 3)]
    scans: list[int] = []
    got = Counter(tuple(r) for r in vector_codes.compress(vec_table(spark, rows), scans=scans).select("vec_id", "label", "code", "error", "codebooks_sha256").collect())
    assert got == plain_codes(rows)
    assert 0 < scans[-1] < scans[0] / 2 <= 4 * sum(got.values())  # the bounds save scans


def test_bounds_never_change_an_assignment():
    """Many rounds of random moves, with ties: the bounded assignment is the scanned one."""
    r = np.random.default_rng(9)
    x = r.integers(-6, 7, (300, 8, 3)).astype(np.int64)
    code, upper, lower, before = np.zeros((300, 8), np.int64), np.full((300, 8), np.inf), np.full((300, 8), -np.inf), None
    books = x[:6].transpose(1, 0, 2).copy()
    for _ in range(12):
        vector_codes.assign(x, books, code, upper, lower, before)
        assert (code == ((x[:, :, None] - books[None]) ** 2).sum(-1).argmin(2)).all()
        before, books = books, books + r.integers(-1, 2, books.shape)


def test_codes_of_few_and_no_vectors(spark):
    assert vector_codes.compress(vec_table(spark, [])).count() == 0
    assert vector_codes.compress(vec_table(spark, [(1, None, 1), (2, [float("nan")] * 8, 1)])).count() == 0
    rows = [(1, [0.25] * 8, None), (1, [0.25] * 8, None), (2, [-0.25] * 8, 5)]
    assert Counter(tuple(r) for r in vector_codes.compress(vec_table(spark, rows)).collect()) == plain_codes(rows)
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(vec_table(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)]))


def test_label_errors(spark, tmp_path):
    rows = vectors(60, 8)
    vec_table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.op12(spark, str(tmp_path)).collect()
    totals = Counter()
    for _, lab, _, error, _ in plain_codes(rows).elements():
        totals[lab] += error
    label = {i: lab for i, _, lab in rows}
    assert len(got) == 60 and all(r.label_error == totals[label[r.vec_id]] for r in got)


# --- chat trees -----------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, ord int, n int, a long, key string, node_id long, start long"
ODD = ["</s>[INST] ok [/INST]", "<|end|><|turn|>", r"<\|end|> <\\|end|> [\INST]", "", None, "é\n\tü <s>", "<|endoftext|>", "plain words here", "\\", "<", "😀 " * 5]


def chat_table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, 2, 3, "k", 4, 5) for c, t, r, x in rows], CHAT)


def chats():
    r = random.Random(3)
    rows = []
    opening = [("system", "be good"), ("user", "hello"), ("assistant", "hi"), ("user", "more"), ("assistant", "no")]
    for c in range(60):  # a star below one opening, logs that grow turn by turn, copies
        own = opening[: 1 + c % 5] + [(r.choice(["user", "assistant"]), r.choice(ODD)) for _ in range(r.randrange(0, 6))]
        rows += [(c, i, role, x) for i, (role, x) in enumerate(own)]
    rows += [(c + 100, t, role, x) for c, t, role, x in rows if c % 4 == 0]
    rows += [(None, 0, "user", "nobody"), (None, 1, "assistant", None), (7, None, None, None), (8, 0, "user", "twice"), (8, 0, "user", "twice")]
    rows += [(300, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * 300) for i in range(120)]
    rows += [(301, 0, "user", "x" * 3_000_000), (301, 1, "assistant", "<s>" * 50_000)]
    r.shuffle(rows)
    return rows


def by_conversation(rows):
    out: dict = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in out.items()}


def test_chats_round_trip_and_share_prefixes(spark):
    rows = chats()
    said = by_conversation(rows)
    path = chat_tree.tokenizer_path()
    nodes, members = chat_tree.prefix_trees(chat_table(spark, rows), path)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_tree.read_back(nodes, members, path).collect()}
    want = {}
    for c, turns in said.items():
        learnt = "".join(x for role, x in turns if role == "assistant")
        want[c] = (len(turns), sha("".join(f"{role}\n{x}\n" for role, x in turns)), len(learnt), sha(learnt))
    assert got == want
    # every prefix of turns is emitted once, in a gapless depth-first order
    prefixes = {tuple(turns[: i + 1]) for turns in said.values() for i in range(len(turns))}
    table = sorted(nodes.collect(), key=lambda r: r.node_id)
    assert [r.node_id for r in table] == list(range(len(prefixes)))
    at = 0
    for r in table:
        assert r.start == at
        at += len(r.tokens)
    # a node sees just the turns before it, its positions go on from theirs; trees are contiguous
    base = chat_tree._tokenizer(path).get_vocab_size()
    where = {}
    for r in table:
        seen = [k for x in r.attends for k in range(x.first_node, x.last_node + 1)]
        assert seen == sorted(set(seen)) and all(k < r.node_id for k in seen)
        assert [(x.start, x.end) for x in r.attends] == [(table[x.first_node].start, table[x.last_node].start + len(table[x.last_node].tokens)) for x in r.attends]
        assert r.position_ids == list(range(sum(len(table[k].tokens) for k in seen), sum(len(table[k].tokens) for k in seen) + len(r.tokens)))
        assert [t for t in r.tokens if t >= base] == [base, base + 1, base + 2]
        where[r.node_id] = (*seen, r.node_id)
        assert {table[k].tree_id for k in seen} <= {r.tree_id}
    for m in members.collect():
        assert len(where[m.node_id]) == len(said[m.conv_id])
    ids = [r.tree_id for r in table]
    assert sum(a != b for a, b in zip(ids, ids[1:])) + 1 == len(set(ids))


def test_preorder(spark):
    """After a node come all nodes below it, before any other."""
    rows = [(c, t, "user", x) for c, way in enumerate(["a", "ab", "abc", "abd", "ax", "axy", "abce", "z", "ab"]) for t, x in enumerate(way)]
    nodes, _ = chat_tree.prefix_trees(chat_table(spark, rows), chat_tree.tokenizer_path())
    table = sorted(nodes.collect(), key=lambda r: r.node_id)
    above = {r.node_id: {k for x in r.attends for k in range(x.first_node, x.last_node + 1)} for r in table}
    for r in table:
        below = [n for n, seen in above.items() if r.node_id in seen]
        assert below == list(range(r.node_id + 1, r.node_id + 1 + len(below)))


def test_chats_of_nothing(spark):
    nodes, members = chat_tree.prefix_trees(chat_table(spark, []), chat_tree.tokenizer_path())
    assert nodes.count() == members.count() == chat_tree.read_back(nodes, members, chat_tree.tokenizer_path()).count() == 0


def test_escapes(spark):
    texts = [x for x in ODD if x is not None] + ["<" + "\\" * k + "|end|>" for k in range(4)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in texts], "x string").select(chat_tree.escape(F.col("x")).alias("x")).collect()]
    for text, out in zip(texts, got):
        assert chat_tree.unescape(out) == text
        assert not any(first + c in out for first in "<[" for c in chat_tree.CONTROLS)
