"""Chat formatting over prefix trees: turns that conversations share from their start are emitted once.

Conversations that begin with the same turn form a tree whose nodes are turns. Every node belongs to the longest conversation
that runs through it (of equals the least id), so a tree falls into chains of consecutive turns, and a chain hangs on a node of
another chain. Emitting a chain whole, then the chains that hang on it from its end backwards, is a depth-first order; it follows
from sorting chains by their way from the root. A token sees its chain before it and, of each chain on the way, the part before
the fork: those are its attention intervals, and the tokens in them number its position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantarow.llm.common import keep, lean
from vantarow.llm.order import counted, sums_before

#: Template of a turn: TURN role SAYS text END. Each mark is one token, numbered from the end of the vocabulary.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
MARKS = (TURN, SAYS, END)
#: Control strings, without their first character, that no text may hold: those of this template and of common others.
CONTROLS = ("|turn|>", "|says|>", "|end|>", "|endoftext|>", "|startoftext|>", "|im_start|>", "|im_end|>", "s>", "/s>", "INST]", "/INST]")
#: A control string with any number of backslashes after its first character: escaping adds one, unescaping takes one away.
ESCAPED = r"([<\[])(\\*)(" + "|".join(re.escape(c) for c in CONTROLS) + ")"
#: Texts are tokenised in pieces of at most so many characters.
PIECE = 1 << 16

NODE = "tree_id string, node_id long, start long, tokens array<int>, position_ids array<int>, loss_from int, loss_to int, attends array<struct<first_node: long, last_node: long, start: long, end: long>>"


def escape(text: Column) -> Column:
    """No control string is left in the text; :func:`unescape` gives it back."""
    java = r"([<\[])(\\*)(" + "|".join(r"\Q" + c + r"\E" for c in CONTROLS) + ")"
    return F.regexp_replace(text, java, r"$1\\$2$3")


_BACK = re.compile(r"([<\[])\\(\\*)(" + "|".join(re.escape(c) for c in CONTROLS) + ")")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1\2\3", text)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _encode(tokenizer, text: str) -> list[int]:
    ids: list[int] = []
    for at in range(0, len(text), PIECE):
        ids += tokenizer.encode(text[at : at + PIECE], add_special_tokens=False).ids
    return ids


@lean
def _tokenise(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Tokens of each turn (columns conv, ord, role, text; escaped), and which of them a model learns from."""
    tokenizer = _tokenizer(path)
    base = tokenizer.get_vocab_size()
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("tokens", "loss_from", "loss_to")}
        for role, text, learnt in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            head, body = [base, *_encode(tokenizer, role), base + 1], _encode(tokenizer, text)
            rows["tokens"].append([*head, *body, base + 2])
            rows["loss_from"].append(len(head))
            rows["loss_to"].append(len(head) + (len(body) if learnt else 0))
        out = [pa.array(rows["tokens"], pa.list_(pa.int32())), pa.array(rows["loss_from"], pa.int32()), pa.array(rows["loss_to"], pa.int32())]
        sizes = pa.array([len(t) for t in rows["tokens"]], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out, sizes], names=["conv", "ord", "tokens", "loss_from", "loss_to", "size"])


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows of conversations in order (ord from 1 to n), with a 128-bit hash of all turns up to each."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # rows of a conversation stream through its window sorted; only the running hashes are held
    inside = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("ord", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    hashed = numbered.withColumn("h1", F.xxhash64("ord", "role", "text")).withColumn("h2", F.xxhash64(F.lit(20240301), "text", "role", "ord"))
    return hashed.select("conv", "ord", "role", "text", F.bit_xor("h1").over(inside).alias("a"), F.bit_xor("h2").over(inside).alias("b"))


def _chains(turns: DataFrame) -> DataFrame:
    """Per conversation: n turns, and the last turn it shares with the chain ``parent`` (shared = 0: it is a root)."""
    sizes = turns.groupBy("conv").agg(F.max("ord").alias("n"))
    places = turns.select("conv", "ord", "a", "b").join(sizes, "conv")
    owners = places.groupBy("ord", "a", "b").agg(F.min(F.struct((-F.col("n")).alias("n"), "conv")).alias("own"))
    # written, so that no aggregate stands between shuffle and join: a node that many conversations share can be split
    owners = keep(owners.select("ord", "a", "b", F.col("own.conv").alias("owner")), "owners")
    met = places.join(owners, ["ord", "a", "b"])
    fork = F.max(F.when(F.col("owner") != F.col("conv"), F.struct("ord", "owner"))).alias("fork")
    return met.groupBy("conv").agg(F.max("n").alias("n"), fork).select("conv", "n", F.coalesce("fork.ord", F.lit(0)).alias("shared"), F.col("fork.owner").alias("parent"))


def _ways(chains: DataFrame, forks: DataFrame) -> DataFrame:
    """The way of each chain from its root: key (sorts depth-first) and, root first, which part of each chain above it sees.

    Pointers double: a round joins each way to that of the chain it starts from, so rounds grow with the logarithm of depth.
    """
    at = forks.select(F.col("conv").alias("parent"), F.col("ord").alias("shared"), F.col("after").alias("tokens"))
    own = chains.join(at, ["parent", "shared"], "left")
    step = F.struct((-F.col("shared")).alias("back"), "conv")
    seen = F.struct(F.col("parent").alias("chain"), F.col("shared").alias("turns"), "tokens")
    kind = "array<struct<chain: string, turns: int, tokens: bigint>>"
    now = own.select("conv", F.col("parent").alias("up"), F.array(step).alias("key"), F.when(F.col("parent").isNull(), F.array().cast(kind)).otherwise(F.array(seen)).alias("seen"))
    now = keep(now, "ways")
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("conv").alias("up"), F.col("up").alias("next"), F.col("key").alias("first"), F.col("seen").alias("before"))
        open_, done = now.where("up is not null"), now.where("up is null")
        joined = open_.join(above, "up").select("conv", F.col("next").alias("up"), F.concat("first", "key").alias("key"), F.concat("before", "seen").alias("seen"))
        now = keep(done.unionByName(joined), "ways")
    return now.select("conv", "key", "seen")


def prefix_trees(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Format conversations over shared prefixes.

    ``conversations``: conv_id (long), turn (long), role, text; other columns are ignored, whatever their names. Turns sort
    by turn (null first), role and text, so rows that tie or repeat are turns each; a null role or text is empty; rows without
    a conv_id are one conversation of id null; an empty table gives empty results. ``tokenizer``: path of a byte-level file
    of the tokenizers library.

    Returns nodes and members. A node is one turn that conversations share from their start: tree_id, node_id (its number in
    depth-first order), start (of its tokens in that order), tokens, position_ids, loss_from and loss_to (tokens of it that are
    learnt), attends (intervals of nodes and of tokens before it that it sees, root first). Members: conv_id and the
    node_id of its last turn.
    """
    turns = keep(_turns(conversations), "turns")
    chains = keep(_chains(turns), "chains")
    owned = turns.join(chains.select("conv", "shared"), "conv").where(F.col("ord") > F.col("shared"))
    texts = owned.select("conv", F.col("ord").cast("int").alias("ord"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("learnt"))
    nodes = keep(texts.mapInArrow(partial(_tokenise, path=tokenizer), "conv string, ord int, tokens array<int>, loss_from int, loss_to int, size long"), "tokens")
    within = Window.partitionBy("conv").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    sizes = keep(nodes.select("conv", "ord", "size").withColumn("after", F.sum("size").over(within)), "sizes")
    real = chains.where("shared < n")
    totals = sizes.groupBy("conv").agg(F.max("after").alias("size"), F.count(F.lit(1)).alias("turns"))
    ways = _ways(real, sizes).join(totals, "conv")
    placed = sums_before(ways, [F.col("key")[0]["conv"], "key"], ("turns", "size"), "placed")
    places = placed.select("conv", F.col("turns_before").alias("node0"), F.col("size_before").alias("token0"), F.col("key")[0]["conv"].alias("tree_id"), (F.col("key")[F.size("key") - 1]["back"] * -1).alias("shared"), "seen")
    places = keep(places, "places")
    # the intervals of a chain: each chain on its way has a place, and a part of it is seen
    wanted = places.select("conv", F.posexplode("seen").alias("i", "of")).select("conv", "i", F.col("of.chain").alias("chain"), "of.turns", "of.tokens")
    above = places.select(F.col("conv").alias("chain"), "node0", "token0", "shared")
    interval = F.struct(
        F.col("node0").alias("first_node"), (F.col("node0") + F.col("turns") - F.col("shared") - 1).alias("last_node"),
        F.col("token0").alias("start"), (F.col("token0") + F.col("tokens")).alias("end"),
    )
    attends = wanted.join(above, "chain").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("i", interval.alias("x")))).alias("xs")).select("conv", F.transform("xs", lambda x: x["x"]).alias("above"))
    frame = places.select("conv", "tree_id", "node0", "token0", "shared").join(attends, "conv", "left")
    before = F.col("after") - F.col("size")
    at = F.col("ord") - F.col("shared") - 1
    above_ = F.coalesce("above", F.array().cast("array<struct<first_node: bigint, last_node: bigint, start: bigint, end: bigint>>"))
    chain = F.struct(F.col("node0").alias("first_node"), (F.col("node0") + at - 1).alias("last_node"), F.col("token0").alias("start"), (F.col("token0") + before).alias("end"))
    position = F.aggregate("above", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]) + before
    # all that is small meets first: tokens move once
    frame = sizes.join(frame.withColumn("above", above_), "conv")
    made = nodes.drop("size").join(frame, ["conv", "ord"])
    out = made.select(
        "tree_id", (F.col("node0") + at).alias("node_id"), (F.col("token0") + before).alias("start"), "tokens",
        F.sequence(position.cast("int"), (position + F.col("size") - 1).cast("int")).alias("position_ids"), "loss_from", "loss_to",
        F.when(at > 0, F.concat("above", F.array(chain))).otherwise(F.col("above")).alias("attends"),
    )
    last = chains.select("conv", F.when(F.col("shared") < F.col("n"), F.col("conv")).otherwise(F.col("parent")).alias("chain"), "n")
    ends = last.join(places.select(F.col("conv").alias("chain"), "node0", "shared"), "chain")
    members = ends.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), (F.col("node0") + F.col("n") - F.col("shared") - 1).alias("node_id"))
    return keep(out, "nodes"), keep(members, "members")


@lean
def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Read turns back (columns leaf, node_id, tokens, loss_from, loss_to; whole leaves, in order): digests of what they say."""
    tokenizer = _tokenizer(path)
    base = tokenizer.get_vocab_size()
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    leaf, state = None, None

    def closed() -> list:
        return [leaf, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    for batch in batches:
        done: list[list] = []
        columns = [batch.column(i) for i in range(5)]
        for i in range(batch.num_rows):
            key = columns[0][i].as_py()
            if key != leaf:
                if state:
                    done.append(closed())
                leaf, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            ids = columns[2][i].values.to_numpy()
            start, end = columns[3][i].as_py(), columns[4][i].as_py()
            marks = np.flatnonzero(ids >= base)
            if ids[marks].tolist() != [base, base + 1, base + 2] or marks[0] or marks[2] != len(ids) - 1:
                raise ValueError("a turn isn't marked as the template asks")
            role, text = (tokenizer.decode(ids[a + 1 : b].tolist(), skip_special_tokens=False) for a, b in ((marks[0], marks[1]), (marks[1], marks[2])))
            state[4] += sum(map(len, MARKS)) + len(role) + len(text)
            role, plain = unescape(role), unescape(text)
            state[0] += 1
            state[1].update(f"{role}\n".encode() + plain.encode() + b"\n")
            if end > start:
                learnt = plain if (start, end) == (marks[1] + 1, marks[2]) else unescape(tokenizer.decode(ids[start:end].tolist(), skip_special_tokens=False))
                state[2] += len(learnt)
                state[3].update(learnt.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))
    if state:
        yield pa.RecordBatch.from_pydict(dict(zip(names, ([v] for v in closed()))))


def read_back(nodes: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """What each conversation says, from its tree alone: a last node's intervals name the nodes before it, in order.

    Equal conversations end in one node and are read once. Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.
    """
    leaves = members.select(F.col("node_id").alias("leaf")).distinct()
    ends = nodes.select(F.col("node_id").alias("leaf"), "attends").join(leaves, "leaf")
    runs = ends.select("leaf", F.explode(F.concat(F.transform("attends", lambda x: F.struct(x["first_node"].alias("a"), x["last_node"].alias("b"))), F.array(F.struct(F.col("leaf").alias("a"), F.col("leaf").alias("b"))))).alias("run"))
    each = runs.select("leaf", F.explode(F.sequence("run.a", "run.b")).alias("node_id"))
    said = each.join(nodes.select("node_id", "tokens", "loss_from", "loss_to"), "node_id").select("leaf", "node_id", "tokens", "loss_from", "loss_to")
    schema = "leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    # the nodes of a way ascend: chains above come before those that hang on them
    told = said.repartition("leaf").sortWithinPartitions("leaf", "node_id").mapInArrow(partial(_digests, path=tokenizer), schema)
    told = keep(told, "told")
    return members.withColumnRenamed("node_id", "leaf").join(counted(told), "leaf").drop("leaf")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one of control strings (-7), formatted over prefix trees and read back; see :func:`prefix_trees`."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    nodes, members = prefix_trees(given.unionByName(own), tokenizer_path())
    return read_back(nodes, members, tokenizer_path())


_CHARS = "length(regexp_replace({}, '{}', '\\1\\\\\\2\\3', 'g'))"
_TOLD = "coalesce({}, '')"
ORACLE = f"""
with said as (select conv_id, turn, {_TOLD.format('role')} as role, {_TOLD.format('text')} as text from conversations
  union all select -7, i, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, role))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({sum(map(len, MARKS))} + {_CHARS.format('role', ESCAPED)} + {_CHARS.format('text', ESCAPED)})::bigint as formatted_chars
from said group by conv_id
"""
