"""Queries on documents and responses: retrieval, groundedness, risk, audit, costs. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.functions import text
from vantarow.operators import plugins, response, retrieval, windows
from vantarow.plans.registry import Registry
from vantarow.sources.telemetry import table

REGISTRY = Registry()
query = REGISTRY.query


def chunked(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents: chunk_id, doc_id, heading, offset, text. Written once, as searches and joins read them several times."""
    return retrieval.written(_chunks(s, d), "chunks")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return retrieval.chunk_documents(table(s, d, "documents").select("doc_id", "text")).select("chunk_id", "doc_id", "heading", "offset", F.col("piece").alias("text"))


def test_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_WS = "'^\\s+|\\s+$'"
#: What tags leave is marked with noncharacters, so that no step makes a tag out of what another left.
_MARKS = {"|": "chr(64976)", "n": "chr(64977)", "": "chr(64978)"}


def _strip_sql(source: str, key: str, column: str, name: str) -> str:
    """CTEs that end in ``name`` (key, t): pages as a reader would read them, for texts without fences and with few entities."""
    attributes = """(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
    removed = "(?is)<!--.*?-->|" + "|".join(f"<{n}\\b[^>]*>.*?</{n}\\s*>" for n in ("noscript", "script", "style", "template"))
    out = "seen"
    for start, names, left in (("<", retrieval._CELLS, "|"), ("</", retrieval._CELLS, ""), ("</?", retrieval._BLOCKS, "n"), ("</?", retrieval._INLINE, "")):
        out = f"regexp_replace({out}, '(?i){start}(?:{'|'.join(names)})\\b{attributes}', {_MARKS[left]}, 'g')"
    plain = f"replace(replace(replace({out}, {_MARKS['|']}, ' | '), {_MARKS['n']}, chr(10)), {_MARKS['']}, '')"
    decoded = "replace(replace(replace(plain, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"')"
    tidy = f"regexp_replace(regexp_replace({decoded}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"{name}_0 AS (SELECT {key}, {column} AS old, regexp_replace({column}, '{removed}', '', 'g') AS seen FROM {source}), {name}_1 AS (SELECT {key}, old, {plain} AS plain FROM {name}_0), {name} AS (SELECT {key}, CASE WHEN plain = old THEN old ELSE {tidy} END AS t FROM {name}_1)"


_HEAD = "'(?m)^(#{2,4})\\s+(.+)$'"
_SECTIONS = f"""cut AS (SELECT doc_id, string_split_regex(t, {_HEAD}) AS bodies, regexp_extract_all(t, {_HEAD}, 0) AS marks, regexp_extract_all(t, {_HEAD}, 2) AS heads FROM stripped),
parts AS (SELECT doc_id, i, CASE WHEN i > 1 THEN regexp_replace(heads[i - 1], {_WS}, '', 'g') ELSE '' END AS heading, bodies[i] AS part, coalesce(list_sum(list_transform(range(1, i), lambda j: length(bodies[j]) + length(marks[j]))), 0) AS base, len(marks) AS n FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM cut)),
bodies AS (SELECT doc_id, heading, base, regexp_replace(part, {_WS}, '', 'g') AS body FROM parts WHERE i > 1 OR part != '' OR n = 0)"""
_CHUNKS = f"""{_strip_sql('documents', 'doc_id', 'text', 'stripped')}, {_SECTIONS},
pieces AS (SELECT doc_id, heading, base, body, unnest(CASE WHEN length(body) <= 1200 THEN [0] ELSE range(0, length(body), 1000) END) AS s FROM bodies WHERE length(body) > 0),
chunks AS (SELECT substr(sha1(doc_id || ':' || CAST(base + s AS INT)), 1, 16) AS chunk_id, doc_id, heading, CAST(base + s AS INT) AS "offset", regexp_replace(substr(body, CAST(s + 1 AS INT), 1200), {_WS}, '', 'g') AS text FROM pieces WHERE s = 0 OR length(body) - s >= 120),
ck AS (SELECT * FROM chunks WHERE length(text) >= 120)"""
query("chunk_documents", f"WITH {_CHUNKS} SELECT chunk_id, doc_id, heading, \"offset\", length(text) AS length, md5(text) AS digest FROM ck")(lambda s, d: _chunks(s, d).select("chunk_id", "doc_id", "heading", "offset", F.length("text").alias("length"), F.md5("text").alias("digest")))
query("chunk_provenance", f"WITH {_CHUNKS} SELECT chunk_id, 'Page ' || doc_id || CASE WHEN heading != '' THEN ' - ' || heading ELSE '' END AS citation, md5('Page ' || doc_id || '. ' || CASE WHEN heading != '' THEN heading || '. ' ELSE '' END || text) AS search_text FROM ck")(
    lambda s, d: (lambda title: _chunks(s, d).select("chunk_id", retrieval.citation(title, F.col("heading")).alias("citation"), F.md5(retrieval.search_text(title, F.col("heading"), F.col("text"))).alias("search_text")))(F.concat(F.lit("Page "), F.col("doc_id").cast("string")))
)
query("chunk_ids", "SELECT doc_id, substr(sha1(doc_id || ':' || n_chars), 1, 16) AS chunk_id FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", retrieval.chunk_id(F.col("doc_id"), F.col("n_chars")).alias("chunk_id")))
query("tokenise", "SELECT doc_id, len(t) AS n, array_to_string(t[1:5], ' ') AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("first"))
)
query("doc_frequency", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term")(
    lambda s, d: retrieval.term_counts(table(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
)
_BM25 = f"""{_CHUNKS}, tk AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ck),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tk) GROUP BY ALL),
ln AS (SELECT chunk_id, len(t) AS length FROM tk), sums AS (SELECT count(*) AS n, avg(length) AS avg_length FROM ln),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
post AS (SELECT chunk_id, term, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)) AS weight FROM tf JOIN df USING (term) JOIN ln USING (chunk_id), sums),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q),
sc AS (SELECT query_id, chunk_id, round(sum(weight), 9) AS score FROM post JOIN qt USING (term) GROUP BY ALL HAVING sum(weight) > 0),
hits AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= {{k}})"""


def _bm25(k: int) -> str:
    return _BM25.replace("{k}", str(k))


query("bm25_weights", f"WITH {_bm25(10)} SELECT term, count(*) AS chunks, round(sum(weight), 6) AS total FROM post GROUP BY term")(
    lambda s, d: retrieval.bm25_totals(chunked(s, d)).select("term", F.col("df").alias("chunks"), F.round("total", 6).alias("total"))
)


def bm25_hits(s: SparkSession, d: str, k: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Best chunks of the benchmark's items, with columns ``more`` of them."""
    chunks = chunked(s, d)
    hits = retrieval.bm25_search(chunks.select("chunk_id", "text"), test_queries(s, d), k)
    return hits.join(chunks.select("chunk_id", *more), "chunk_id") if more else hits


query("bm25_topk", f"WITH {_bm25(10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits")(lambda s, d: bm25_hits(s, d, 10).withColumn("score", F.round("score", 6)))
_DENSE = """dq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
ds AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(e, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM dq, embeddings WHERE vec_id != query_id),
dh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds) WHERE rank <= {k})"""


def dense_hits(s: SparkSession, d: str, k: int) -> DataFrame:
    e = table(s, d, "embeddings")
    found = retrieval.dense_search(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k + 1)
    return retrieval.top_k(found.where("vec_id != query_id").select("query_id", "vec_id", "score"), k, "vec_id")


query("dense_topk", f"WITH {_DENSE.format(k=10)} SELECT query_id, vec_id, score, rank FROM dh")(lambda s, d: dense_hits(s, d, 10))


def lexical_hits(s: SparkSession, d: str, k: int) -> DataFrame:
    """BM25 of the documents for each whole text of the query set (the ids of vectors that 20 divides), without itself."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    queries = rows.join(F.broadcast(table(s, d, "embeddings").where("vec_id % 20 = 0").select("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieval.bm25_search(rows, queries, k + 1, "vec_id")
    return retrieval.top_k(found.where("vec_id != query_id").select("query_id", "vec_id", "score"), k, "vec_id")


_RRF = _DENSE.format(k=50) + """, tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL), sums AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avg_length FROM tk), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT doc_id AS query_id, term FROM tf JOIN dq ON dq.query_id = doc_id),
ls AS (SELECT query_id, f.doc_id AS vec_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avg_length))), 9) AS score FROM qt JOIN tf f USING (term) JOIN df USING (term) JOIN tk ON tk.doc_id = f.doc_id, sums WHERE f.doc_id != query_id GROUP BY ALL),
nh AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ls) WHERE rank <= 50),
u AS (SELECT query_id, vec_id, 0 AS source, rank FROM nh UNION ALL SELECT query_id, vec_id, 1, rank FROM dh),
fu AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(source * 1000 + rank) AS first FROM u GROUP BY ALL),
fh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, vec_id) AS rank FROM fu) WHERE rank <= 10)"""
query("hybrid_rrf", f"WITH {_RRF} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM fh")(
    lambda s, d: retrieval.hybrid_search({"lexical": lexical_hits(s, d, 50), "dense": dense_hits(s, d, 50)}, 10, "vec_id").withColumn("score", F.round("score", 6))
)
query(
    "rerank_length_penalty",
    f"WITH {_bm25(30)}, rr AS (SELECT query_id, chunk_id, round((1.0::DOUBLE / rank) * (0.5::DOUBLE + 0.5::DOUBLE * least(length(text) / 600.0::DOUBLE, 1)), 9) AS score, rank AS old FROM hits JOIN ck USING (chunk_id)) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM rr) WHERE rank <= 5",
)(lambda s, d: retrieval.rerank_length_penalty(bm25_hits(s, d, 30, ("text",)), 5, "chunk_id").withColumn("score", F.round("score", 6)))
query(
    "retrieval_metrics",
    f"WITH {_bm25(10)}, rel AS (SELECT q.query_id, d.doc_id FROM q JOIN documents d ON contains(d.text, q.query)), fd AS (SELECT r.query_id, r.doc_id, min(h.rank) AS rank FROM rel r LEFT JOIN (SELECT query_id, doc_id, rank FROM hits JOIN ck USING (chunk_id)) h ON h.query_id = r.query_id AND h.doc_id = r.doc_id GROUP BY ALL), "
    "pq AS (SELECT query_id, min(rank) AS first, count(*) AS n, "
    + ", ".join(f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS got_{k}" for k in (1, 3, 5, 10))
    + " FROM fd GROUP BY query_id) SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, "
    + ", ".join(f"round(avg(CASE WHEN got_{k} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{k}, round(avg(got_{k}::DOUBLE / n), 6) AS recall_{k}" for k in (1, 3, 5, 10))
    + " FROM pq",
)(lambda s, d: metrics_of(s, d))


def metrics_of(s: SparkSession, d: str) -> DataFrame:
    """Retrieval metrics where a document that holds a query's text is relevant to it."""
    queries = test_queries(s, d)
    relevant = retrieval.holding(table(s, d, "documents"), queries)
    hits = bm25_hits(s, d, 10, ("doc_id",))
    return retrieval.retrieval_metrics(hits, relevant)


_PAGES = _strip_sql("pages", "page_id", "html", "stripped")
query("strip_html_pages", f"WITH {_PAGES} SELECT page_id, length(t) AS length, md5(t) AS digest FROM stripped")(lambda s, d: retrieval.strip_html(table(s, d, "pages").select("page_id", "html"), "html").select("page_id", F.length("html").alias("length"), F.md5("html").alias("digest")))
_PAGE_PARTS = f"WITH {_PAGES}, " + _SECTIONS.replace("doc_id", "page_id").replace("FROM stripped", "FROM (SELECT page_id, '## Top' || chr(10) || replace(t, '. ', chr(10) || '### Part ' || chr(10)) AS t FROM stripped)")
query("html_sections", f"{_PAGE_PARTS} SELECT page_id, heading, CAST(base AS INT) AS \"offset\", md5(body) AS digest FROM bodies")(lambda s, d: page_sections(s, d))


def page_sections(s: SparkSession, d: str) -> DataFrame:
    """Parts of pages without their markup, after a heading was put in front and between sentences."""
    pages = retrieval.strip_html(table(s, d, "pages").select("page_id", "html"), "html")
    marked = pages.select("page_id", F.concat(F.lit("## Top\n"), F.replace("html", F.lit(". "), F.lit("\n### Part \n"))).alias("t"))
    return retrieval.sections(marked, "t").select("page_id", "heading", "offset", F.md5(F.regexp_replace("body", r"^\s+|\s+$", "")).alias("digest"))


query(
    "hidden_elements",
    r"""SELECT page_id, md5(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')) AS digest FROM pages""",
)(lambda s, d: table(s, d, "pages").select("page_id", F.md5(F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")).alias("digest")))
_MD = "'---' || chr(10) || 'title: Page ' || doc_id || chr(10) || '---' || chr(10) || '{{< note >}}' || chr(10) || chr(10) || chr(10) || chr(10) || '# Head' || chr(10) || '<!-- x -->' || text"
query(
    "clean_markdown",
    f"""WITH m AS (SELECT doc_id, {_MD} AS t FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)\\A---\\n.*?\\n---\\n', ''), '(?s)\\{{\\{{[<%].*?[>%]\\}}\\}}', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}, '', 'g')) AS digest, 'Page ' || doc_id AS title FROM m""",
)(
    lambda s, d: table(s, d, "documents").select("doc_id", F.concat(F.lit("---\ntitle: Page "), F.col("doc_id").cast("string"), F.lit("\n---\n{{< note >}}\n\n\n\n# Head\n<!-- x -->"), F.col("text")).alias("t"))
    .select("doc_id", F.md5(text.clean_markdown(F.col("t"))).alias("digest"), text.title(F.col("t")).alias("title"))
)
query("hash_embed")(lambda s, d: table(s, d, "benchmark").select("item_id", retrieval.hash_embedding()("text").alias("e")).select("item_id", F.size("e").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: F.format_string("%.6f", x)), ",")).alias("digest")))


def configurations(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Lexical, dense (hashed n-grams) and fused rankings of the chunks for the benchmark's items, ten each."""
    chunks, queries = chunked(s, d), test_queries(s, d)
    embed = retrieval.hash_embedding()
    # both rankings are read alone and fused
    lexical = retrieval.written(retrieval.bm25_search(chunks.select("chunk_id", "text"), queries, 50), "lexical")
    dense = retrieval.written(retrieval.dense_search(chunks.select("chunk_id", embed("text").alias("embedding")), queries.select("query_id", embed("query").alias("embedding")), 50, "chunk_id"), "dense")
    fused = retrieval.hybrid_search({"lexical": lexical, "dense": dense}, 10, "chunk_id")
    named = {"bm25": retrieval.no_rerank(lexical, 10, "chunk_id"), "dense": retrieval.no_rerank(dense, 10, "chunk_id"), "hybrid": fused}
    return {k: v.join(chunks.select("chunk_id", "doc_id"), "chunk_id") for k, v in named.items()}


query("retrieval_ablation")(lambda s, d: retrieval.ablation(configurations(s, d), retrieval.holding(table(s, d, "documents"), test_queries(s, d))))


def answers(s: SparkSession, d: str) -> DataFrame:
    """Assistant turns with all earlier turns of their conversation as context."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(s, d, "conversations").withColumn("context", F.array_join(F.collect_list("text").over(before), " "))
    return rows.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"), "context")


_FILL = "[" + ", ".join(f"'{w}'" for w in text.FILLER) + "]"
_GROUND = f"""ans AS (SELECT conv_id * 100 + turn AS answer_id, role, text AS answer, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations),
se AS (SELECT answer_id, context, regexp_replace(x, {_WS}, '', 'g') AS sentence FROM (SELECT answer_id, context, unnest(string_split(regexp_replace(answer, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1))) AS x FROM ans WHERE role = 'assistant')),
sw AS (SELECT answer_id, sentence, list_filter(list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains({_FILL}, w)) AS words, list_distinct(regexp_extract_all(lower(context), '[a-z0-9]{{3,}}')) AS have FROM se WHERE sentence != ''),
sx AS (SELECT answer_id, sentence, len(words) AS n, list_sort(list_filter(words, lambda w: NOT list_contains(have, w))) AS missing FROM sw WHERE len(words) >= 3)"""
query("groundedness_sentences", f"WITH {_GROUND} SELECT answer_id, md5(sentence) AS sentence, round(1.0::DOUBLE - len(missing)::DOUBLE / n, 6) AS support, array_to_string(missing[1:8], ' ') AS missing FROM sx")(
    lambda s, d: retrieval.groundedness_sentences(answers(s, d)).select("answer_id", F.md5("sentence").alias("sentence"), F.round("support", 6).alias("support"), F.array_join("missing", " ").alias("missing"))
)
query(
    "groundedness_report",
    f"WITH {_GROUND} SELECT a.answer_id, round(coalesce(avg(1.0::DOUBLE - len(missing)::DOUBLE / n), 1), 6) AS score, round(coalesce(avg(CASE WHEN 1.0::DOUBLE - len(missing)::DOUBLE / n >= 0.6 THEN 1.0::DOUBLE WHEN n IS NOT NULL THEN 0 END), 1), 6) AS supported_share, count(n) AS sentences FROM (SELECT answer_id FROM ans WHERE role = 'assistant') a LEFT JOIN sx USING (answer_id) GROUP BY a.answer_id",
)(lambda s, d: retrieval.groundedness_report(answers(s, d)))

_LEVEL = "['low', 'medium', 'high'][CAST({0} AS INT)]"
_KINDS = [a for a, _, _ in response.ACTIONS]


def plans(s: SparkSession, d: str) -> DataFrame:
    """Pretended plans, one for each order: an action of the catalogue or none, and a level."""
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*[F.lit(x) for x in _KINDS], F.lit(None).cast("string")), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    return table(s, d, "orders").select(k.alias("plan_id"), action.alias("action"), response.level(F.pmod(k, F.lit(3)) + 1).alias("risk_level"), F.col("o_orderpriority").alias("target"), F.concat(F.lit('do "'), F.col("o_orderstatus"), F.lit('"')).alias("immediate_action"))


_PLANS = f"""acts(action, template, risk_floor) AS (VALUES {', '.join(f"('{a}', '{t}', '{f}')" for a, t, f in response.ACTIONS)}),
plans AS (SELECT o_orderkey AS plan_id, [{', '.join(f"'{x}'" for x in _KINDS)}, NULL][CAST(o_orderkey % 6 + 1 AS INT)] AS action, {_LEVEL.format('o_orderkey % 3 + 1')} AS risk_level, o_orderpriority AS target, 'do "' || o_orderstatus || '"' AS immediate_action FROM orders),
lv AS (SELECT p.*, template, coalesce(risk_floor, 'low') AS risk_floor, greatest(list_position(['low', 'medium', 'high'], risk_level), list_position(['low', 'medium', 'high'], coalesce(risk_floor, 'low'))) AS place FROM plans p LEFT JOIN acts USING (action))"""
query("risk_floor_join", f"WITH {_PLANS} SELECT plan_id, risk_floor, place > 1 AS requires_approval FROM lv")(lambda s, d: response.with_floor(plans(s, d)).select("plan_id", "risk_floor", "requires_approval"))
query("risk_highest", f"WITH {_PLANS} SELECT plan_id, {_LEVEL.format('place')} AS overall FROM lv")(lambda s, d: response.with_floor(plans(s, d)).select("plan_id", "overall"))


def cases(s: SparkSession, d: str) -> DataFrame:
    k = F.col("plan_id")
    assessor = F.when(F.pmod(k, F.lit(5)) != 0, response.level(F.pmod(F.floor(k / 7), F.lit(3)) + 1))
    return response.with_floor(plans(s, d)).select(k.alias("case_id"), response.level(F.pmod(F.floor(k / 5), F.lit(3)) + 1).alias("expected"), F.col("risk_level").alias("author"), F.col("risk_floor").alias("floor"), assessor.alias("assessor"))


_P = "list_position(['low', 'medium', 'high'], {0})"
query(
    "risk_rule_eval",
    f"""WITH {_PLANS}, c AS (SELECT plan_id, plan_id // 5 % 3 + 1 AS e, {_P.format('risk_level')} AS a, {_P.format('risk_floor')} AS f, CASE WHEN plan_id % 5 != 0 THEN plan_id // 7 % 3 + 1 END AS s FROM lv),
r AS (SELECT 'author' AS rule, e, a AS r FROM c UNION ALL SELECT 'author_and_floor', e, greatest(a, f) FROM c UNION ALL SELECT 'all_three', e, greatest(a, f, s) FROM c WHERE s IS NOT NULL)
SELECT rule, count(*) AS rated, sum((r < e)::INT)::BIGINT AS under, sum((r > e)::INT)::BIGINT AS over FROM r GROUP BY rule""",
)(lambda s, d: response.evaluate_rules(cases(s, d)).drop("under_ids"))


def full_plans(s: SparkSession, d: str) -> DataFrame:
    return response.plan_hash(plans(s, d).withColumns({"long_term_fix": F.lit("none"), "short_term_fix": F.col("target"), "rollback": F.lit(None).cast("string")}))


_HASH = """sha256('{"action":' || coalesce('"' || action || '"', 'null') || ',"immediate_action":"' || replace(immediate_action, '"', '\\"') || '","long_term_fix":"none","risk_level":"' || risk_level || '","rollback":null,"short_term_fix":"' || target || '"}')"""
query("plan_hash", f"WITH {_PLANS} SELECT plan_id, {_HASH} AS plan_hash FROM lv")(lambda s, d: full_plans(s, d).select("plan_id", "plan_hash"))
query(
    "execute_plans",
    f"""WITH {_PLANS}, h AS (SELECT *, {_HASH} AS plan_hash FROM lv) SELECT plan_id, plan_id % 4 != 0 AND plan_id % 7 != 0 AND template IS NOT NULL AS executed, CASE WHEN plan_id % 4 != 0 AND plan_id % 7 != 0 THEN replace(template, '{{target}}', target) END AS command,
CASE WHEN plan_id % 4 = 0 THEN 'refused: no approval' WHEN plan_id % 7 = 0 THEN 'error: approval is for another plan' WHEN template IS NULL THEN 'unrecognised action' ELSE 'dry run' END AS detail FROM h""",
)(lambda s, d: executed(s, d))


def executed(s: SparkSession, d: str) -> DataFrame:
    rows = full_plans(s, d).withColumn("token", F.when(F.col("plan_id") % 4 != 0, F.lit("t"))).withColumn("token_hash", F.when(F.col("plan_id") % 7 == 0, F.lit("other")).otherwise(F.col("plan_hash")))
    named = rows.withColumn("plan_hash", F.concat_ws(":", F.col("plan_id").cast("string"), "plan_hash")).withColumn("token_hash", F.concat_ws(":", F.col("plan_id").cast("string"), "token_hash"))
    return response.execute(named).select(F.split_part("plan_hash", F.lit(":"), F.lit(1)).cast("long").alias("plan_id"), "executed", "command", "detail")


query("request_key_lookup", "SELECT item_id, substr(sha256('{\"item\":\"' || item_id || '\",\"model\":\"m\"}'), 1, 24) AS request_key, item_id % 2 = 0 AS degraded FROM benchmark")(lambda s, d: replayed(s, d))


def replayed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "benchmark").select("item_id", F.col("item_id").alias("item"), F.lit("m").alias("model")).withColumn("request_key", response.request_key("item", "model"))
    snapshots = rows.where("item_id % 2 = 1").select("request_key", F.lit("recorded").alias("text"))
    return response.replay(rows, snapshots).select("item_id", "request_key", "degraded")


AUDIT = ("principal", "decision", "at")


def audit_log(s: SparkSession, d: str) -> DataFrame:
    """Pretended audit entries: the events of a user are one log, in order."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").select(F.col("user_id").alias("log_id"), (F.row_number().over(order) - 1).alias("seq"), F.col("event_type").alias("principal"), F.col("props").alias("decision"), F.col("event_id").alias("at"))
    return response.build_chain(rows, AUDIT)


_CHAIN = """ev AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type || '|' || props || '|' || event_id AS payload FROM events),
chain(log_id, seq, hash) AS (SELECT log_id, seq, sha256(repeat('0', 64) || '|' || payload) FROM ev WHERE seq = 0 UNION ALL SELECT e.log_id, e.seq, sha256(c.hash || '|' || e.payload) FROM chain c JOIN ev e ON e.log_id = c.log_id AND e.seq = c.seq + 1)"""
query("audit_chain_build", f"WITH RECURSIVE {_CHAIN} SELECT log_id, seq, hash AS entry_hash FROM chain")(lambda s, d: audit_log(s, d).select("log_id", "seq", "entry_hash"))
query("audit_chain_verify", f"WITH RECURSIVE {_CHAIN} SELECT log_id, CASE WHEN log_id % 3 = 0 AND max(seq) >= 2 THEN 2 END AS first_broken, count(*) AS entries, arg_max(hash, seq) AS head FROM chain GROUP BY log_id")(
    lambda s, d: response.verify_chain(audit_log(s, d).withColumn("principal", F.when((F.col("log_id") % 3 == 0) & (F.col("seq") == 2), F.lit("edited")).otherwise(F.col("principal"))), AUDIT)
)
query(
    "investigation_status",
    "SELECT o_orderkey AS thread_id, CASE WHEN o_orderkey % 11 = 0 THEN 'awaiting_approval' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'rejected' WHEN o_orderkey % 3 = 0 THEN 'complete' WHEN o_orderstatus = 'O' THEN 'no_incident' ELSE 'failed' END AS status FROM orders",
)(
    lambda s, d: response.investigation_status(
        table(s, d, "orders").select(F.col("o_orderkey").alias("thread_id"), (F.col("o_orderkey") % 11 == 0).alias("interrupted"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("r")).alias("report"), F.when(F.col("o_orderstatus") == "F", F.lit("rejected")).otherwise(F.lit("approved")).alias("decision"), (F.col("o_orderstatus") == "O").alias("calm"))
    ).select("thread_id", "status")
)
query("incident_page", "SELECT o_custkey AS thread_id, min(o_orderkey) AS first FROM orders GROUP BY o_custkey ORDER BY first DESC LIMIT 20 OFFSET 10")(
    lambda s, d: response.incident_page(table(s, d, "orders").select(F.col("o_custkey").alias("thread_id"), F.col("o_orderkey").alias("checkpoint_id")), 20, 10)
)
query("token_usage_cost", "SELECT r_name AS model, sum(c_custkey)::BIGINT AS input_tokens, sum(length(c_name))::BIGINT AS output_tokens, CASE WHEN r_name != 'ASIA' THEN round(sum(c_custkey) * 3.0::DOUBLE / 1e6 + sum(length(c_name)) * 15.0::DOUBLE / 1e6, 6) END AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")(
    lambda s, d: costs(s, d)
)


def costs(s: SparkSession, d: str) -> DataFrame:
    regions = F.broadcast(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("model")))
    usage = table(s, d, "customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("model", F.col("c_custkey").alias("input_tokens"), F.length("c_name").cast("long").alias("output_tokens"))
    rates = table(s, d, "region").where("r_name != 'ASIA'").select(F.col("r_name").alias("model"), F.lit(3.0).alias("input_rate"), F.lit(15.0).alias("output_rate"))
    return response.token_cost(usage, rates)


query(
    "stage_latency_percentiles",
    "SELECT stage, a[CAST(least(floor(len(a) * 0.5), len(a) - 1) AS INT) + 1] AS p50, a[CAST(least(floor(len(a) * 0.95), len(a) - 1) AS INT) + 1] AS p95, n FROM (SELECT event_type AS stage, list_sort(list(value) FILTER (k <= 1000)) AS a, count(*) AS n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) GROUP BY event_type)",
)(lambda s, d: response.stage_latency(table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))))
query("event_counters", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")))
query(
    "rate_limit_admissions",
    """WITH RECURSIVE ev AS (SELECT user_id AS caller, epoch_us(ts) / 1e6 AS x, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r(caller, rn, x, request_id, held, admitted) AS (SELECT caller, rn, x, request_id, [x], true FROM ev WHERE rn = 1
UNION ALL SELECT caller, rn, x, request_id, CASE WHEN len(live) < 2 THEN list_append(live, x) ELSE live END, len(live) < 2 FROM (SELECT e.*, list_filter(r.held, lambda y: y > e.x - 3600) AS live FROM r JOIN ev e ON e.caller = r.caller AND e.rn = r.rn + 1))
SELECT caller, x AS "at", request_id, admitted FROM r""",
)(lambda s, d: response.rate_limit(table(s, d, "events").select(F.col("user_id").alias("caller"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("request_id")), 2, 3600.0))
query(
    "first_decision",
    "WITH c AS (SELECT user_id AS incident_id, event_type AS principal, ts AS claimed_at, value < 20 AS waiting, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS later FROM events) SELECT incident_id, arg_min(principal, (claimed_at, principal)) AS principal, min(claimed_at) AS claimed_at FROM c WHERE NOT (waiting AND later IS NOT NULL AND epoch(date_trunc('second', later)) - epoch(date_trunc('second', claimed_at)) >= 900) GROUP BY incident_id",
)(lambda s, d: response.first_decision(table(s, d, "events").select(F.col("user_id").alias("incident_id"), F.col("event_type").alias("principal"), F.col("ts").alias("claimed_at"), F.when(F.col("value") < 20, "waiting").otherwise("done").alias("state"))))
query("retention", "SELECT o_orderkey AS thread_id FROM orders WHERE o_orderstatus = 'O' OR o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")(lambda s, d: retained(s, d))


def retained(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("thread_id"), F.when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("complete").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return response.retain(rows.crossJoin(F.broadcast(rows.agg(F.max("updated_at").alias("now")))), F.col("now"), 365).select("thread_id")


query(
    "window_validation_quarantine",
    "SELECT o_orderkey AS window_id, CASE WHEN o_orderkey % 5 = 0 THEN 'too_few_rows' WHEN o_orderkey % 5 = 1 THEN 'not_rectangular' WHEN o_orderkey % 5 = 2 THEN 'wrong_width' WHEN o_orderkey % 5 = 3 THEN 'not_finite' END AS reason FROM orders",
)(lambda s, d: checked(s, d))


def checked(s: SparkSession, d: str) -> DataFrame:
    one, two = F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))
    bad = F.array(F.lit(1.0), F.lit(float("nan")))
    kind = F.pmod("o_orderkey", F.lit(5))
    values = F.when(kind == 0, F.array(two)).when(kind == 1, F.array(two, one)).when(kind == 2, F.array(one, one)).when(kind == 3, F.array(two, bad)).otherwise(F.array(two, two))
    return windows.quarantine(table(s, d, "orders").select(F.col("o_orderkey").alias("window_id"), values.alias("values")), 2, 2)


def _keys(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name).select(F.col(f"{name[0]}_nationkey").alias("k"))


query("union_intersect_except", "SELECT 'union_all' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10)")(
    lambda s, d: set_operations(s, d)
)


def set_operations(s: SparkSession, d: str) -> DataFrame:
    a, b = _keys(s, d, "customer"), _keys(s, d, "supplier")
    parts = {"union_all": a.unionByName(b), "union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b.where("k < 10"))}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _label_auc(by: str) -> str:
    return f"WITH r AS (SELECT n_chars::DOUBLE AS score, {by} AS label FROM documents JOIN labels USING (doc_id)), g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM r GROUP BY score) SELECT round(sum(pos * below + pos * neg / 2.0) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"


query("label_auc", _label_auc("toxic"))(lambda s, d: label_auc(s, d))


def label_auc(s: SparkSession, d: str) -> DataFrame:
    from vantarow.operators import evaluate

    rows = table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(table(s, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return evaluate.roc_auc(rows).select(F.round("roc_auc", 6).alias("roc_auc"))


def plugged(s: SparkSession, d: str) -> DataFrame:
    """Lexical hits of the benchmark's items, thirty deep, put in order by a plugged-in pair scorer."""
    search = plugins.Reranked(plugins.Lexical(), plugins.Plugin("vantarow.operators.plugins:SharedWords"), 30)
    return search.search(chunked(s, d).select("chunk_id", "text"), test_queries(s, d), 5)


query(
    "plugin_rerank",
    f"WITH {_bm25(30)}, pw AS (SELECT query_id, chunk_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM hits JOIN ck USING (chunk_id) JOIN q USING (query_id)), "
    "ps AS (SELECT query_id, chunk_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 9) AS score FROM pw) SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ps) WHERE rank <= 5",
)(plugged)
query("plugin_encode")(lambda s, d: plugins.Dense(plugins.Plugin("vantarow.operators.plugins:HashedWords", {"dimensions": 128})).search(chunked(s, d).select("chunk_id", "text"), test_queries(s, d), 5).withColumn("score", F.round("score", 6)))
