"""Retrieval: cleaning, chunks, BM25, dense search, fusion, reranking and metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from html import entities

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantarow.functions.text import content_words, sentences, tokens
from vantarow.operators import nearest
from vantarow.sinks.store import workspace

#: Queries are a stated set: up to this many vectors or terms go to every task, more are taken in blocks.
MAX_QUERIES = 10_000
#: Beyond so many rows that tasks would hand on, a bound is found first.
MAX_HANDED_ON = 4_000_000


#: Elements whose tags are taken out, by what they leave; any other name in angle brackets is a placeholder that stays.
_CELLS = ("td", "th")
_BLOCKS = (
    "blockquote", "br", "caption", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "tfoot", "thead", "tr", "ul",
)
_INLINE = (
    "a", "abbr", "audio", "b", "center", "cite", "code", "col", "colgroup", "del", "em", "embed", "font", "i", "iframe", "img", "input", "ins", "kbd", "mark", "object", "q", "s", "samp", "small", "source", "span",
    "strong", "sub", "sup", "u", "var", "video",
)
#: What no reader sees, a tag, an entity (as patterns), and the entities that stay because they escape markup.
_HIDDEN = r"<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_TAG = r"""</?([a-zA-Z][a-zA-Z0-9]*)\b(?:[^>"']|"[^"]*"|'[^']*')*/?>"""
_ENTITY = r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);"
_ESCAPES = ("lt", "gt", "amp")

#: Java's word boundary knows ASCII alone, and its engine recurses for each turn of a group: runs are taken whole, for good.
_TAG_JAVA = _TAG.replace(r"\b", r"(?![\p{L}\p{N}_])").replace("""[^>"']|""", """[^>"']++|""").replace(")*/?>", ")*+>")
_HIDDEN_JAVA = "(?is)" + _HIDDEN
#: A fenced block: from a line that opens with a fence to the next such line, or to the end.
_FENCE_LINE = r"^[^\S\n]*(?:```|~~~)[^\n]*"
_FENCED = rf"(?dm){_FENCE_LINE}(?:(?s:.*?)\n{_FENCE_LINE}$|(?s:.*)\z)"
_NAMED = {name[:-1]: char for name, char in entities.html5.items() if name.endswith(";")}
#: Names that also count without a semicolon, longest first.
_SHORT = sorted((name for name in entities.html5 if not name.endswith(";")), key=lambda x: (-len(x), x))


def _characters(spark) -> DataFrame:
    """One row: characters by entity name, and by number where it isn't the character's own."""
    numbers = {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)} | {"#0": "\ufffd", "#13": "\r"}
    pairs = sorted((_NAMED | {n: c if c != "\ufffd" or n == "#0" else chr(int(n[1:])) for n, c in numbers.items()}).items())
    return spark.createDataFrame([(dict(pairs),)], "__characters map<string,string>")


def _character(entity: Column) -> Column:
    """What an entity stands for; itself if it is none, or escapes markup."""
    body = F.substring(entity, 2, F.length(entity) - 2)
    number = F.when(body.startswith("#x"), F.conv(F.substr(body, F.lit(3)), 16, 10).try_cast("bigint")).when(body.startswith("#"), F.substr(body, F.lit(2)).try_cast("bigint"))
    own = F.col("__characters")[F.when(body.startswith("#"), F.concat(F.lit("#"), number.cast("string"))).otherwise(body)]
    bad = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    none = number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.when(bad, "\ufffd").when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    short = F.regexp_extract(body, f"^(?:{'|'.join(_SHORT)})", 0)
    legacy = F.when(short != "", F.concat(F.col("__characters")[short], F.substr(body, F.length(short) + 1), F.lit(";"))).otherwise(entity)
    return F.when(F.lower(body).isin(*_ESCAPES), entity).otherwise(F.coalesce(own, F.when(body.startswith("#"), char), legacy))


def _woven(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` changed, in one pass."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(matches, F.array(F.lit(""))), lambda part, match: F.concat(part, match)), "")


def _left_by(tag: Column) -> Column:
    name = F.lower(F.regexp_extract(tag, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    return F.when(name.isin(*_CELLS), F.when(tag.startswith("</"), "").otherwise(" | ")).when(name.isin(*_BLOCKS), "\n").when(name.isin(*_INLINE), "").otherwise(tag)


def strip_html(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Replaces a column of pages (or adds ``into``) by what a reader would read; all steps are expressions.

    Fenced blocks stay as they are. Elsewhere hidden elements and comments go with their contents, cells become
    bars, blocks new lines, inline tags nothing; then entities are decoded but for those that escape markup, and
    the white space that tags leave is tidied. Prose without markup is returned as it is; a null stays null.
    """
    text = F.col(column)
    # a text with neither mark has nothing to take out or to decode, and skips all steps
    marked = text.contains("<") | text.contains("&")
    rows = df.crossJoin(F.broadcast(_characters(df.sparkSession))).withColumns({"__fences": F.when(marked, F.regexp_extract_all(text, F.lit(_FENCED), F.lit(0))), "__pieces": F.when(marked, F.split(text, _FENCED, -1))})
    last = F.size("__pieces") - 1

    def bare(piece: Column, i: Column) -> Column:
        inner = F.when((i > 0) & piece.startswith("\n"), F.substr(piece, F.lit(2))).otherwise(piece)
        return F.when((i < last) & inner.endswith("\n"), F.left(inner, F.length(inner) - 1)).otherwise(inner)

    rows = rows.withColumn("__prose", F.transform("__pieces", bare))
    rows = rows.withColumn("__seen", F.transform("__prose", lambda x: F.regexp_replace(x, _HIDDEN_JAVA, "")))
    rows = rows.withColumn("__plain", F.transform("__seen", lambda x: _woven(x, _TAG_JAVA, _left_by)))
    rows = rows.withColumn("__decoded", F.zip_with("__prose", "__plain", lambda old, new: F.when(old == new, old).otherwise(_woven(new, _ENTITY, _character))))
    tidy = F.zip_with("__prose", F.arrays_zip("__plain", "__decoded"), lambda old, x: F.when(old == x["__plain"], old).otherwise(F.regexp_replace(F.regexp_replace(x["__decoded"], "[ \t]+\n", "\n"), "\n{3,}", "\n\n")))
    rows = rows.withColumn("__tidy", tidy)

    def framed(x: Column, i: Column) -> Column:
        piece = F.get("__pieces", i)
        alone = (piece == "\n") & (i > 0) & (i < last)
        before = F.when((i > 0) & piece.startswith("\n"), "\n").otherwise("")
        after = F.when((i < last) & piece.endswith("\n") & ~alone, "\n").otherwise("")
        return F.concat(before, x, after)

    whole = F.array_join(F.zip_with(F.transform("__tidy", framed), F.concat("__fences", F.array(F.lit(""))), lambda prose, fence: F.concat(prose, fence)), "")
    return rows.withColumn(into or column, F.when(marked, whole).otherwise(text)).drop("__characters", "__fences", "__pieces", "__prose", "__seen", "__plain", "__decoded", "__tidy")


_HEADING = r"(?m)^(#{2,4})\s+(.+)$"


def sections(df: DataFrame, column: str) -> DataFrame:
    """One row for each part under a heading of level two to four: adds heading, body and offset (where the body begins).

    What stands before the first heading is a part without one; a text without headings is one part.
    """
    text = F.col(column)
    rows = df.withColumns({"__bodies": F.split(text, _HEADING, -1), "__marks": F.regexp_extract_all(text, F.lit(_HEADING), F.lit(0)), "__heads": F.regexp_extract_all(text, F.lit(_HEADING), F.lit(2))})
    # a body begins after all bodies and marks before it
    lengths = F.zip_with("__bodies", F.concat("__marks", F.array(F.lit(""))), lambda body, mark: F.length(body) + F.length(mark))
    rows = rows.withColumn("__lengths", lengths)
    part = F.transform(
        "__bodies",
        lambda body, i: F.struct(
            F.when(i > 0, F.regexp_replace(F.get("__heads", i - 1), r"^\s+|\s+$", "")).otherwise("").alias("heading"), body.alias("body"), F.aggregate(F.slice("__lengths", 1, i), F.lit(0), lambda a, x: a + x).alias("offset"), i.alias("i")
        ),
    )
    rows = rows.withColumn("__part", F.explode(part)).where((F.col("__part.i") > 0) | (F.col("__part.body") != "") | (F.size("__marks") == 0))
    return rows.select("*", F.col("__part.heading").alias("heading"), F.col("__part.body").alias("body"), F.col("__part.offset").cast("int").alias("offset")).drop("__bodies", "__marks", "__heads", "__lengths", "__part")


def chunk_documents(documents: DataFrame, text: str = "text", **sizes) -> DataFrame:
    """Retrievable passages of documents (doc_id, a text and anything that rides along): markup out, parts by heading, windows, ids.

    Adds chunk_id, heading, offset (in the text without markup) and piece; the text itself goes.
    """
    return chunks(sections(strip_html(documents, text), text).drop(text), **sizes)


def citation(title: Column, heading: Column) -> Column:
    return F.when(heading != "", F.concat_ws(" - ", title, heading)).otherwise(title)


def search_text(title: Column, heading: Column, text: Column) -> Column:
    """What is indexed of a chunk: its text with the headings in front."""
    return F.concat(title, F.lit(". "), F.when(heading != "", F.concat(heading, F.lit(". "))).otherwise(""), text)


def chunks(parts: DataFrame, size: int = 1200, overlap: int = 200, least: int = 120) -> DataFrame:
    """Overlapping pieces of long bodies. Rows: doc_id, body, offset and anything else; adds chunk_id, piece, offset.

    A body of at most ``size`` is one piece; a short tail ends the pieces unless it is the first.
    """
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    rows = parts.withColumn("body", body).withColumn("__n", F.length("body")).where("__n > 0")
    step = size - overlap
    starts = F.when(F.col("__n") <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.col("__n") - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (F.col("__n") - s >= least)))
    rows = rows.withColumn("__s", F.explode(starts))
    piece = F.regexp_replace(F.substring("body", F.col("__s") + 1, F.lit(size)), r"^\s+|\s+$", "")
    rows = rows.withColumn("piece", piece).withColumn("offset", (F.col("offset") + F.col("__s")).cast("int")).where(F.length("piece") >= least)
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("offset"))).drop("__n", "__s", "body")


def chunk_id(doc: Column, offset: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", doc.cast("string"), offset.cast("string"))), 1, 16)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows key, term, tf."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _measured(docs: DataFrame, key: str, text: str) -> tuple[int, float]:
    """How many rows there are, and the mean number of words."""
    none = pa.array([], pa.string())
    sums = dict(docs.select(key, text).mapInArrow(nearest.Words(none).frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    return sums.get(-1, 0), sums.get(-2, 0) / max(1, sums.get(-1, 0)) or 1.0


def _idf(n: int) -> Column:
    return F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25_totals(docs: DataFrame, key: str = "chunk_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows term, df, total: in how many rows it is and its weights of all rows. ``docs`` is read twice.

    The idf is a factor of all weights of a term, so tasks send sums for each term and no posting is shuffled.
    """
    n, average = _measured(docs, key, text)
    sums = docs.select(key, text).mapInArrow(nearest.Saturated(average, k1, b).sums, "term string, df long, sat double").groupBy("term").agg(F.sum("df").alias("df"), F.sum("sat").alias("sat"))
    return sums.select("term", "df", (_idf(n) * F.col("sat")).alias("total"))


def bm25_weights(docs: DataFrame, key: str = "chunk_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Postings key, term, weight. Counts are made inside rows; postings move once, to the frequency of their term. ``docs`` is read three times."""
    n, average = _measured(docs, key, text)
    made = nearest.Saturated(average, k1, b)
    rows = docs.select(key, text)
    df = rows.mapInArrow(made.sums, "term string, df long, sat double").groupBy("term").agg(F.sum("df").alias("df"))
    return rows.mapInArrow(made.postings, f"{key} {dict(docs.dtypes)[key]}, term string, sat double").join(df, "term").select(key, "term", (_idf(n) * F.col("sat")).alias("weight"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Texts are cut and tokenised once: average, frequencies and scores read the same table."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top k rows of ``docs`` for each query (query_id, query): distinct query terms, positive scores, ties by key.

    Only the queries' terms are counted. Queries, a stated set, go to every task in blocks of bounded size; each
    task scores its own rows and hands on its best k, so no posting of a frequent term is shuffled. ``docs`` is read
    two or three times for each block: one that is costly to make should be :func:`written`.
    """
    rows = docs.select(key, text)
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(docs.dtypes)[key]}, score double"
    blocks, out = max(1, -(-queries.count() // MAX_QUERIES)), None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        # two tables of a block of queries: bounded by their terms
        pairs = some.orderBy("term", "query_id").toArrow().combine_chunks()
        if not pairs.num_rows:
            continue
        term, owner = (pc.dictionary_encode(pairs[x].combine_chunks(), null_encoding="encode") for x in ("term", "query_id"))
        counted = rows.mapInArrow(nearest.Words(term.dictionary).frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        # the last two places are the sums over all rows
        df = np.zeros(len(term.dictionary) + 2)
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        count, average, df = df[-1], df[-2] / max(1, df[-1]), df[:-2]
        idf = np.log(1.0 + (count - df + 0.5) / (df + 0.5))

        def scorer(k: int, least: np.ndarray | None = None) -> nearest.Bm25:
            return nearest.Bm25(term.dictionary, owner.dictionary, term.indices.to_numpy(), owner.indices.to_numpy(), idf, df / max(1, count), average or 1.0, k, k1, b, least)

        least = None
        if rows.rdd.getNumPartitions() * len(owner.dictionary) * k > MAX_HANDED_ON:
            # what the k-th best of a sixteenth of the rows reaches, the k-th best of all reaches: tasks hand on no row below it
            part = top_k(rows.where(F.pmod(F.xxhash64(key), F.lit(16)) == 0).mapInArrow(scorer(k), schema), k, key).where(F.col("rank") == k).toArrow()
            at = pc.index_in(part["query_id"], value_set=owner.dictionary).to_numpy()
            least = np.full(len(owner.dictionary), -np.inf)
            least[at] = part["score"].to_numpy()
        found = top_k(rows.mapInArrow(scorer(k, least), schema), k, key)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"{schema}, rank int") if out is None else out


def top_k(scores: DataFrame, k: int, key: str) -> DataFrame:
    """Rank 1 to k inside each query by score, then key. The window's limit is pushed before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """Exact inner-product top k. ``vectors``: key, embedding; ``queries``: query_id, embedding — the stated set.

    Queries go to every task in blocks of bounded size; corpus vectors never move but as scored candidates.
    """
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(vectors.dtypes)[key]}, score double"
    out = None
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        dots = nearest.Dots(asked["embedding"].combine_chunks(), asked["query_id"].combine_chunks(), k)
        found = top_k(vectors.select(key, "embedding").mapInArrow(dots, schema), k, key)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], f"{schema}, rank int") if out is None else out


def rrf(rankings: list[DataFrame], k: int, key: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ties keep the order of the first ranking that has them, then rank, then key."""
    parts = [r.select("query_id", key, F.lit(i).alias("source"), "rank") for i, r in enumerate(rankings)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("source", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def rerank_length_penalty(hits: DataFrame, k: int, key: str, text: str = "text", target: int = 600) -> DataFrame:
    """Short passages move down: (1 / rank)(0.5 + 0.5 min(length / target, 1)); ties by the old rank."""
    score = (1.0 / F.col("rank")) * (0.5 + 0.5 * F.least(F.length(text) / F.lit(float(target)), F.lit(1.0)))
    rows = hits.withColumn("__old", F.col("rank")).withColumn("score", F.round(score, 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "__old"))).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit and recall at each k and MRR over all queries of ``relevant`` (query_id, doc_id); hits: query_id, doc_id, rank.

    Recall counts distinct documents among the first k chunks; ranks past the largest k give 0.
    """
    want = relevant.distinct()
    found = hits.where(F.col("rank") <= max(ks)).join(want, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    per_doc = want.join(found, ["query_id", "doc_id"], "left")
    per_query = per_doc.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce((F.col("rank") <= k).cast("long"), F.lit(0))).alias(f"got_{k}") for k in ks])
    out = [F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr")]
    for k in ks:
        out += [F.round(F.avg((F.col(f"got_{k}") > 0).cast("double")), 6).alias(f"hit_{k}"), F.round(F.avg(F.col(f"got_{k}") / F.col("n")), 6).alias(f"recall_{k}")]
    return per_query.agg(*out)


class _Grams:
    """Buckets of character n-grams by blake2b, little-endian, modulo the dimensions; a worker remembers those it met last."""

    def __init__(self, dimensions: int, gram: int) -> None:
        self.dimensions, self.gram = dimensions, gram
        self.known, self.place = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int32)

    def _bucket(self, gram: str) -> int:
        return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=4).digest(), "little") % self.dimensions

    def _of_codes(self, codes: np.ndarray) -> np.ndarray:
        """Of grams of up to four characters below 65,536, packed; no gram of spaces or letters is 0."""
        slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.place[slot]
        missed = np.flatnonzero(self.known[slot] != codes)
        if len(missed):
            new, inverse = np.unique(codes[missed], return_inverse=True)
            chars = (new[:, None] >> np.arange(16 * (self.gram - 1), -1, -16).astype(np.uint64)).astype(np.uint16).astype("<u4")
            text = chars.tobytes().decode("utf-32-le")
            made = np.array([self._bucket(text[i : i + self.gram]) for i in range(0, len(text), self.gram)], np.int32)
            out[missed] = made[inverse]
            at = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            # of grams of one slot the last one stays; the code 0 is never kept, as empty slots have it
            at, kept = np.unique(at[::-1], return_index=True)
            kept = len(new) - 1 - kept
            self.known[at], self.place[at] = new[kept], made[kept]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        padded = [f" {x.lower()} " for x in texts]
        length = np.array([len(x) for x in padded], np.int64)
        places = np.maximum(0, length - self.gram + 1)
        chars = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
        begin = np.repeat(np.cumsum(length) - length - (np.cumsum(places) - places), places) + np.arange(places.sum())
        if self.gram <= 4 and chars.min() > 0 and chars.max() < 1 << 16:
            codes = np.zeros(max(0, len(chars) - self.gram + 1), np.uint64)
            for i in range(self.gram):
                codes = (codes << np.uint64(16)) | chars[i : i + len(codes)]
            bucket = self._of_codes(codes[begin])
        else:
            whole = "".join(padded)
            grams, inverse = np.unique(np.array([whole[a : a + self.gram] + "|" for a in begin.tolist()], dtype=f"<U{self.gram + 1}"), return_inverse=True)
            bucket = np.array([self._bucket(g[:-1]) for g in grams.tolist()], np.int64)[inverse]
        row = np.repeat(np.arange(len(padded)), places)
        return np.bincount(row * self.dimensions + bucket, minlength=len(padded) * self.dimensions).reshape(-1, self.dimensions).astype(np.float32)


_GRAMS: dict[tuple[int, int], _Grams] = {}


def hash_embedding(dimensions: int = 512, gram: int = 4):
    """Unit vectors of hashed character n-grams (blake2b, little-endian, modulo the dimensions), as an Arrow function.

    Counts and norms are array operations over the rows of a batch; a worker hashes a gram once while it remembers it.
    """

    @F.arrow_udf("array<float>")
    def embed(text: pa.Array) -> pa.Array:
        grams = _GRAMS.get((dimensions, gram)) or _GRAMS.setdefault((dimensions, gram), _Grams(dimensions, gram))
        texts, out = text.fill_null("").to_numpy(zero_copy_only=False).tolist(), []
        for a in range(0, len(texts), 500):
            counts = grams.counts(texts[a : a + 500])
            norm = np.linalg.norm(counts, axis=1, keepdims=True)
            out.append(np.divide(counts, norm, out=counts, where=norm > 0))
        return as_lists(out)

    return embed


def as_lists(blocks: list[np.ndarray]) -> pa.Array:
    """Rows of matrices as a column of lists."""
    length = np.concatenate([np.full(len(x), x.shape[1]) for x in blocks]) if blocks else np.zeros(0, int)
    flat = np.concatenate([x.reshape(-1) for x in blocks]) if blocks else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat))


def hybrid_search(rankings: dict[str, DataFrame], k: int, key: str, constant: int = 60) -> DataFrame:
    """Fused ranking of several searches, each to its own depth; see :func:`rrf`."""
    return rrf(list(rankings.values()), k, key, constant)


def no_rerank(hits: DataFrame, k: int, key: str) -> DataFrame:
    """The identity among rerankers: the first k as they are."""
    return hits.where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def ablation(configurations: dict[str, DataFrame], relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), replicates: int = 2000) -> DataFrame:
    """Metrics of several configurations (hits: query_id, doc_id, rank) side by side, with intervals of their hit rates.

    Relevant documents and hits, a few for each query, are written once: metrics and intervals read them several times.
    """
    relevant, out = written(relevant, "relevant"), None
    for name, hits in configurations.items():
        hits = written(hits.select("query_id", "doc_id", "rank"), "hits")
        row = retrieval_metrics(hits, relevant, ks).crossJoin(hit_intervals(hits, relevant, ks, replicates)).select(F.lit(name).alias("configuration"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def hit_intervals(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Bootstrap percentile intervals (2.5 and 97.5) of the hit rate at each k, over queries.

    Draws are md5 of (seed, replicate, place), so that the intervals are the same on every engine. A replicate
    needs only how many of its draws hit: queries are numbered in order of their id, draws meet them in a join.
    """
    first = relevant.select("query_id").distinct().join(hits.join(relevant.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    # queries are a stated set: numbering them takes one task
    numbered = first.withColumn("i", (F.row_number().over(Window.orderBy("query_id")) - 1).cast("long"))
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    spark = hits.sparkSession
    draws = spark.range(replicates).select(F.col("id").alias("b")).crossJoin(F.broadcast(n)).where("n > 0").select("b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n"))
    means = draws.select("b", drawn.alias("i")).join(numbered, "i").groupBy("b").agg(*[F.avg((F.coalesce(F.col("first") <= k, F.lit(False))).cast("double")).alias(f"m_{k}") for k in ks])
    return means.agg(*[F.round(F.percentile(f"m_{k}", F.lit(q)), 6).alias(f"hit_{k}_{name}") for k in ks for q, name in ((0.025, "low"), (0.975, "high"))])


def holding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs (query_id, doc_id) of passages (query_id, query) and the documents that hold their text.

    Candidates meet on the rarest inner token of each passage, which a document that holds it has as a token of
    its own; then texts are compared. Passages of fewer than three tokens are compared with all documents. Passages, a
    stated set, go to every task in blocks of bounded size, so no text is shuffled. ``documents`` is read twice.
    """
    rows = documents.select("doc_id", "text")
    schema = f"query_id {dict(passages.dtypes)['query_id']}, doc_id {dict(documents.dtypes)['doc_id']}"
    blocks, out = max(1, -(-passages.count() // MAX_QUERIES)), None
    for block in range(blocks):
        some = passages.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).where("query is not null").select("query_id", "query").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        held = nearest.Held(some["query_id"].combine_chunks(), some["query"].combine_chunks())
        counted = rows.mapInArrow(held.frequencies, "term int, df long").where("term >= 0").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        found = rows.mapInArrow(held.by_rarest(counted["term"].to_numpy(), counted["df"].to_numpy()), schema)
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out.distinct()


def groundedness_sentences(answers: DataFrame, least: int = 3) -> DataFrame:
    """Every scorable sentence of answers (answer_id, answer, context): support and the first eight missing words."""
    rows = answers.select("answer_id", F.posexplode(sentences(F.col("answer"))).alias("position", "sentence"), content_words(F.col("context")).alias("__have"))
    rows = rows.withColumn("__words", content_words(F.col("sentence"))).where(F.size("__words") >= least)
    missing = F.array_except("__words", "__have")
    return rows.select("answer_id", "position", "sentence", (1.0 - F.size(missing) / F.size("__words")).alias("support"), F.slice(F.array_sort(missing), 1, 8).alias("missing"))


def groundedness_report(answers: DataFrame, supported: float = 0.6, least: int = 3) -> DataFrame:
    """Score and supported share of every answer; 1 where no sentence can be scored."""
    scored = groundedness_sentences(answers, least).groupBy("answer_id").agg(F.avg("support").alias("score"), F.avg((F.col("support") >= supported).cast("double")).alias("share"), F.count(F.lit(1)).alias("sentences"))
    return answers.select("answer_id").join(scored, "answer_id", "left").select("answer_id", F.round(F.coalesce("score", F.lit(1.0)), 6).alias("score"), F.round(F.coalesce("share", F.lit(1.0)), 6).alias("supported_share"), F.coalesce("sentences", F.lit(0)).alias("sentences"))
