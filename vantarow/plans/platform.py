"""Queries on what surrounds the detectors: files, sinks, triage, validated answers, states, keys. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.operators import agents, classify, evaluate, response, retrieval, series
from vantarow.plans import detection as det
from vantarow.plans import knowledge as kno
from vantarow.plans.detection import G, points, rounded, with_base
from vantarow.plans.registry import Registry
from vantarow.sinks import store
from vantarow.sources import files
from vantarow.sources.telemetry import METRICS, table

REGISTRY = Registry()
query = REGISTRY.query

# -- what is written is what is read


def stored_series(s: SparkSession, d: str, split: str) -> DataFrame:
    p = points(s, d)
    sp = series.split_time_based(p)
    path = store.workspace(s, "series")
    store.write_series(sp, series.split_incidents(sp, det.incidents_of(p)), path)
    kept, incidents = store.read_series(s, path, split)
    steps = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("point_label").cast("long").alias("labelled"), F.round(F.sum("n_events"), 6).alias("events"))
    return steps.join(incidents.groupBy("series_id").agg(F.count(F.lit(1)).alias("incidents")), "series_id", "left").select("series_id", "steps", "labelled", "events", F.coalesce("incidents", F.lit(0)).alias("incidents"))


query(
    "store_series",
    with_base(
        "SELECT series_id, steps, labelled, events, coalesce(incidents, 0) AS incidents FROM (SELECT series_id, count(*) AS steps, sum(point_label)::BIGINT AS labelled, round(sum(n_events), 6) AS events FROM sp WHERE split = 'train' GROUP BY series_id) LEFT JOIN (SELECT series_id, count(*) AS incidents FROM si WHERE split = 'train' GROUP BY series_id) USING (series_id)",
        det._SI,
    ),
)(lambda s, d: stored_series(s, d, "train"))


def stored_index(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    path = store.workspace(s, "index")
    store.write_index(det.windows.window_index(p, det.incidents_of(p), G), path)
    return s.read.parquet(path)


query("store_window_index", with_base("SELECT * FROM idx"))(stored_index)


def stored_scaler(s: SparkSession, d: str) -> DataFrame:
    path = store.workspace(s, "scaler")
    store.save_scaler(det.train_stats(points(s, d)), path)
    return rounded(store.load_scaler(s, path))


query("store_scaler", with_base("SELECT position, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM st"))(stored_scaler)


def manifests(s: SparkSession, d: str) -> DataFrame:
    path = store.workspace(s, "manifests")
    made = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).alias("rows"))
    store.write_manifest(made, path)
    rows = store.read_manifests(s, path, (("F", "1-URGENT"), ("O", "5-LOW")))
    return rows.select("source", "strategy", "rows", "place")


query("store_manifests", "SELECT o_orderstatus AS source, o_orderpriority AS strategy, count(*) AS rows, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 1 ELSE 2 END AS place FROM orders GROUP BY ALL")(manifests)


def embedding_cache(s: SparkSession, d: str) -> DataFrame:
    """Half of the items are in the cache before; then all are asked for: each is encoded once."""
    from vantarow.operators import retrieval

    path = store.workspace(s, "embeddings")
    items, embed = table(s, d, "benchmark").select("item_id", "text"), retrieval.hash_embedding()
    store.cached_embeddings(items.where("item_id % 2 = 0"), "item_id", "text", "hashed-512", embed, path).count()
    found = store.cached_embeddings(items, "item_id", "text", "hashed-512", embed, path)
    return found.select("item_id", "fingerprint", F.size("embedding").alias("dimensions")).crossJoin(F.broadcast(s.read.parquet(path).agg(F.count(F.lit(1)).alias("encoded"))))


query("embedding_cache", "SELECT item_id, sha256('hashed-512' || chr(0) || item_id || chr(0) || text) AS fingerprint, 512 AS dimensions, (SELECT count(DISTINCT item_id) FROM benchmark) AS encoded FROM benchmark")(embedding_cache)


def snapshots(s: SparkSession, d: str) -> DataFrame:
    path = store.workspace(s, "snapshots")
    rows = table(s, d, "benchmark").select(F.col("item_id").alias("item"), F.lit("m").alias("model"), "text").withColumn("request_key", response.request_key("item", "model"))
    manifest = store.write_snapshots(rows.select("request_key", "text"), path)
    read = s.read.schema("request_key string, text string").json(f"{path}/answers")
    return read.groupBy(F.substring("request_key", 1, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("answers"), F.sum(F.length("text")).alias("characters")).crossJoin(F.broadcast(manifest.select(F.col("answers").alias("total"))))


query(
    "store_snapshots",
    "SELECT substr(k, 1, 1) AS prefix, count(*) AS answers, sum(length(text))::BIGINT AS characters, (SELECT count(*) FROM benchmark) AS total FROM (SELECT sha256('{\"item\":\"' || item_id || '\",\"model\":\"m\"}') AS k, text FROM benchmark) GROUP BY prefix",
)(snapshots)
query(
    "log_lines",
    "SELECT '{\"level\":\"' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || '\",\"message\":\"' || event_type || '\",\"incident_id\":' || user_id || '}' AS value FROM events",
)(lambda s, d: store.log_lines(table(s, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_type").alias("message"), F.col("user_id").alias("incident_id")), "level", "message", "incident_id"))


def appended_log(s: SparkSession, d: str) -> DataFrame:
    """The chain of every user's events, built in two appends: hashes are those of one run."""
    rows = table(s, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_type").alias("principal"), F.col("props").alias("decision"), F.col("event_id").alias("at"))
    path = store.workspace(s, "audit")
    empty = s.createDataFrame([], "log_id long, seq long, principal string, decision string, at long, previous_hash string, entry_hash string")
    cut = table(s, d, "events").agg(F.floor(F.max("event_id") / 2).alias("cut"))
    early, late = (rows.crossJoin(F.broadcast(cut)).where(F.col("at") <= F.col("cut")).drop("cut"), rows.crossJoin(F.broadcast(cut)).where(F.col("at") > F.col("cut")).drop("cut"))
    store.append_audit(empty, early, kno.AUDIT).write.mode("append").parquet(path)
    store.append_audit(s.read.parquet(path), late, kno.AUDIT).write.mode("append").parquet(path)
    return s.read.parquet(path).select("log_id", "seq", "entry_hash")


query(
    "audit_append",
    """WITH RECURSIVE ev AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type || '|' || props || '|' || event_id AS payload FROM events),
chain(log_id, seq, hash) AS (SELECT log_id, seq, sha256(repeat('0', 64) || '|' || payload) FROM ev WHERE seq = 0 UNION ALL SELECT e.log_id, e.seq, sha256(c.hash || '|' || e.payload) FROM chain c JOIN ev e ON e.log_id = c.log_id AND e.seq = c.seq + 1)
SELECT log_id, seq, hash AS entry_hash FROM chain""",
)(appended_log)


def anchored(s: SparkSession, d: str) -> DataFrame:
    """Anchors of every log at its tenth entry; those of every third log are of another hash."""
    log = kno.audit_log(s, d)
    anchors = log.where("seq = 9").select("log_id", F.lit(10).alias("n"), F.when(F.col("log_id") % 3 == 0, F.lit("0")).otherwise(F.col("entry_hash")).alias("hash"))
    return response.check_anchors(response.verify_chain(log, kno.AUDIT), log, anchors).select("log_id", "first_broken", "anchored")


query("audit_anchors", "SELECT user_id AS log_id, NULL::BIGINT AS first_broken, CASE WHEN count(*) >= 10 THEN user_id % 3 != 0 END AS anchored FROM events GROUP BY user_id")(anchored)
query("audit_of_incident", "SELECT event_id AS at, event_type AS principal FROM events WHERE user_id = 7")(lambda s, d: table(s, d, "events").where("user_id = 7").select(F.col("event_id").alias("at"), F.col("event_type").alias("principal")))


def checkpoints(s: SparkSession, d: str) -> DataFrame:
    """Pretended checkpoints: the orders of a customer are versions of one thread."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("thread_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))


def stored_states(s: SparkSession, d: str) -> DataFrame:
    path = store.workspace(s, "states")
    rows = checkpoints(s, d)
    store.write_checkpoints(rows.where("version % 2 = 0"), path)
    store.write_checkpoints(rows.where("version % 2 = 1"), path)
    return store.latest_states(s.read.parquet(path))


query("checkpoint_latest", "SELECT o_custkey AS thread_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")(stored_states)
query("checkpoint_counts", "SELECT count(DISTINCT o_custkey) AS threads, count(*) AS versions, count(DISTINCT o_custkey) AS newest FROM orders")(lambda s, d: agents.newest_threads(checkpoints(s, d)))

# -- files


def written_requests(s: SparkSession, d: str) -> DataFrame:
    """Request bodies of the orders, one in five not JSON and one in seven without values."""
    k = F.col("o_orderkey")
    values = F.array(F.array(k.cast("double"), F.lit(1.5)), F.array(F.col("o_totalprice").cast("double"), F.lit(2.5)))
    body = F.to_json(F.struct(k.cast("string").alias("window_id"), F.col("o_orderstatus").alias("series_id"), F.when(k % 7 != 0, values).alias("values")))
    return table(s, d, "orders").select(k.alias("id"), F.when(k % 5 == 0, F.lit("not json")).otherwise(body).alias("body"))


query("parse_requests", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 != 0 THEN o_orderstatus END AS series_id, CASE WHEN o_orderkey % 5 != 0 AND o_orderkey % 7 != 0 THEN 2 END AS n_rows, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS malformed FROM orders")(
    lambda s, d: files.parse_requests(written_requests(s, d)).select("id", "series_id", F.when(F.col("values").isNotNull(), F.size("values")).alias("n_rows"), "malformed")
)
query(
    "wanted_paths",
    "SELECT path FROM (SELECT CASE WHEN page_id % 4 = 0 THEN 'docs/' || page_id || '/_index.md' WHEN page_id % 4 = 1 THEN 'docs/a/' || page_id || '.md' WHEN page_id % 4 = 2 THEN 'docs/../' || page_id || '.md' ELSE 'other/' || page_id || '.md' END AS path, page_id FROM pages) WHERE page_id % 4 = 1",
)(
    lambda s, d: (lambda k: files.wanted_paths(table(s, d, "pages").select(F.when(k % 4 == 0, F.concat(F.lit("docs/"), k.cast("string"), F.lit("/_index.md"))).when(k % 4 == 1, F.concat(F.lit("docs/a/"), k.cast("string"), F.lit(".md"))).when(k % 4 == 2, F.concat(F.lit("docs/../"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("other/"), k.cast("string"), F.lit(".md"))).alias("path")), ("docs/",)))(F.col("page_id"))
)
query("usable_documents", "SELECT doc_id FROM documents WHERE length(text) >= 400 AND doc_id % 3 != 0")(
    lambda s, d: files.usable_documents(table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("t")).alias("title"))).select("doc_id")
)


def corpus_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The benchmark as a corpus file of one JSON array, and as a file of cases, read again."""
    path = store.workspace(s, "corpus")
    rows = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text")
    one = rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("text").alias("query"), F.array("doc_id").alias("relevant")))).alias("queries"))).alias("value"))
    one.coalesce(1).write.text(path)
    cases = files.read_cases(s, path, "queries", "query: string, relevant: array<string>")
    return cases.select(F.explode("relevant").alias("item_id"), "query").select(F.col("item_id").cast("long").alias("item_id"), F.md5("query").alias("digest"))


query("read_cases", "SELECT item_id, md5(text) AS digest FROM benchmark")(corpus_round_trip)
query(
    "demo_window",
    with_base(
        "SELECT series_id, t0, list(round(n_events, 6) ORDER BY t)[1] AS first, count(*) AS length FROM (SELECT mp.*, t0 FROM mp JOIN (SELECT series_id, coalesce(min(t) FILTER (point_label = 1), min(t)) AS t0 FROM mp GROUP BY series_id) USING (series_id) WHERE t >= t0 AND t < t0 + 12) GROUP BY series_id, t0"
    ),
)(lambda s, d: files.demo_window(points(s, d), list(METRICS), 12, 1).select("series_id", "t0", F.round(F.col("values")[0][0], 6).alias("first"), F.size("values").cast("long").alias("length")))

# -- keys and times


def keys(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, F.concat("c_name", F.lit(":key"), k.cast("string"))).when(k % 6 == 1, F.concat("c_name", F.lit(":k:2024-02-30"))).when(k % 6 == 2, F.concat("c_name", F.lit(":k:2024-06-01"))).when(k % 6 == 3, F.concat("c_name", F.lit(":k:2023-01-01"))).when(k % 6 == 4, F.col("c_name")).otherwise(F.lit(":x"))
    return files.key_ring(table(s, d, "customer").select(k.alias("id"), text.alias("entry")), F.to_date(F.lit("2024-01-01")))


query("key_ring", "SELECT c_custkey AS id, c_custkey % 6 IN (1, 4, 5) AS malformed, c_custkey % 6 IN (0, 2) AS usable, CASE c_custkey % 6 WHEN 2 THEN DATE '2024-06-01' WHEN 3 THEN DATE '2023-01-01' END AS expiry FROM customer")(
    lambda s, d: keys(s, d).select("id", "malformed", "usable", "expiry")
)
query("usable_keys", "SELECT count(*) FILTER (c_custkey % 6 IN (0, 2)) AS usable, count(*) AS entries FROM customer")(lambda s, d: keys(s, d).agg(F.sum(F.col("usable").cast("long")).alias("usable"), F.count(F.lit(1)).alias("entries")))
query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")(lambda s, d: table(s, d, "events").select("event_id", store.iso_seconds(F.col("ts").cast("timestamp")).alias("at")))

# -- triage, answers, plans


def scored_requests(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("window_id"), F.when(k % 9 == 0, F.lit("not_finite")).alias("reason"), F.round(F.col("o_totalprice").cast("double") / 100000, 6).alias("score"))


def triaged(s: SparkSession, d: str) -> DataFrame:
    causes = table(s, d, "orders").where("o_orderkey % 4 != 0").select(F.col("o_orderkey").alias("window_id"), F.concat(F.lit("disk_"), F.lower("o_orderstatus")).alias("cause"), F.lit(0.75).alias("probability"))
    return agents.triage(scored_requests(s, d), F.lit(1.5), causes)


_TRIAGE = "tr AS (SELECT o_orderkey AS window_id, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 'rejected' WHEN round(o_totalprice::DOUBLE / 100000, 6) < 1.5 THEN 'calm' ELSE 'incident' END AS status FROM orders), tc AS (SELECT *, CASE WHEN status = 'incident' AND window_id % 4 != 0 THEN 'disk_' || lower(o_orderstatus) END AS cause FROM tr)"
query("triage", f"WITH {_TRIAGE} SELECT window_id, status, cause, CASE WHEN cause IS NOT NULL THEN 0.75::DOUBLE END AS probability FROM tc")(lambda s, d: triaged(s, d).select("window_id", "status", "cause", "probability"))


def incident_rows(s: SparkSession, d: str) -> DataFrame:
    rows = triaged(s, d).where("status = 'incident'")
    return rows.select(F.col("window_id").alias("incident_id"), F.concat(F.lit(" load on "), F.col("window_id").cast("string"), F.lit(" ")).alias("symptoms"), "cause", F.lit(None).cast("string").alias("passages"))


query("query_text", f"WITH {_TRIAGE} SELECT window_id AS incident_id, trim('load on ' || window_id || coalesce(' ' || replace(cause, '_', ' '), '')) AS query FROM tc WHERE status = 'incident'")(
    lambda s, d: incident_rows(s, d).select("incident_id", agents.query_text(F.col("symptoms"), F.col("cause")).alias("query"))
)
_GOOD, _BAD = '{"cause": "disk_full", "explanation": "no room", "confidence": "high", "extra": 1}', '{"cause": "disk_full", "explanation": "no room", "confidence": "certain"}'


def diagnosed(s: SparkSession, d: str) -> DataFrame:
    """A provider that answers well, badly at first, or never, by the number in the prompt."""
    number = lambda prompt: F.regexp_extract(prompt, "load on ([0-9]+)", 1).cast("long")

    def provider(prompt):
        repaired = prompt.contains("could not be used")
        return F.when(number(prompt) % 3 == 0, F.lit(f"Sure.\n```json\n{_GOOD}\n```")).when(number(prompt) % 3 == 1, F.when(repaired, F.lit(_GOOD)).otherwise(F.lit(_BAD))).otherwise(F.lit(_BAD))

    return agents.diagnose(incident_rows(s, d), provider)


query(
    "diagnosis",
    f"WITH {_TRIAGE} SELECT window_id AS incident_id, CASE WHEN window_id % 3 != 2 THEN 'disk_full' ELSE coalesce(cause, 'unknown') END AS cause, CASE WHEN window_id % 3 != 2 THEN 'no room' ELSE 'no explanation is available' END AS explanation, CASE WHEN window_id % 3 != 2 THEN 'high' ELSE 'low' END AS confidence, window_id % 3 = 2 AS degraded, CASE WHEN window_id % 3 = 0 THEN 1 ELSE 2 END AS attempts FROM tc WHERE status = 'incident'",
)(diagnosed)
_REPLIES = "CASE o_orderkey % 6 WHEN 0 THEN '{\"rating\": \"low\"}' WHEN 1 THEN 'It is {\"rating\": \"high\"} I think' WHEN 2 THEN '{\"rating\": \"extreme\"}' WHEN 3 THEN '{\"other\": 1}' WHEN 4 THEN 'no idea' END"


def parsed_answers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    reply = F.when(k % 6 == 0, '{"rating": "low"}').when(k % 6 == 1, 'It is {"rating": "high"} I think').when(k % 6 == 2, '{"rating": "extreme"}').when(k % 6 == 3, '{"other": 1}').when(k % 6 == 4, "no idea")
    return table(s, d, "orders").select(k.alias("id"), agents.parse_answer(reply, agents.RATING).alias("a")).select("id", F.col("a.value.rating").alias("rating"), F.col("a.error").isNull().alias("valid"))


query("structured_answers", f"SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS rating, o_orderkey % 6 < 2 AS valid FROM (SELECT o_orderkey, {_REPLIES} AS reply FROM orders)")(parsed_answers)
query(
    "remediation",
    f"WITH {_TRIAGE} SELECT window_id AS incident_id, NULL::VARCHAR AS action, 'a person must decide' AS immediate_action, 'high' AS risk_level, true AS degraded FROM tc WHERE status = 'incident'",
)(lambda s, d: agents.remediate(diagnosed(s, d).withColumn("passages", F.lit(None).cast("string")), agents.unavailable).select("incident_id", "action", "immediate_action", "risk_level", "degraded"))


def assessed(s: SparkSession, d: str) -> DataFrame:
    rows = kno.cases(s, d).select(F.col("case_id"), "author", "floor", F.concat(F.lit("plan "), F.col("case_id").cast("string")).alias("plan"))
    return agents.assess(rows, agents.by_rules({"plan 1": '{"rating": "high"}', "plan 2": '{"rating": "low"}'}, "none")).select("case_id", "assessor", "overall")


query(
    "risk_assessment",
    f"WITH {kno._PLANS}, a AS (SELECT plan_id AS case_id, risk_level, risk_floor, CASE WHEN risk_level = 'high' THEN NULL WHEN contains('plan ' || plan_id, 'plan 1') THEN 'high' WHEN contains('plan ' || plan_id, 'plan 2') THEN 'low' END AS assessor FROM lv) SELECT case_id, assessor, CASE WHEN risk_level = 'high' OR assessor IS NULL OR assessor = 'high' OR risk_floor = 'high' THEN 'high' WHEN risk_level = 'medium' OR risk_floor = 'medium' THEN 'medium' ELSE 'low' END AS overall FROM a",
)(assessed)


def reports(s: SparkSession, d: str) -> DataFrame:
    sources = F.array(F.struct(F.lit("c").alias("chunk_id"), F.lit("Disks").alias("title")), F.struct(F.lit("e").alias("chunk_id"), F.lit("Quota").alias("title")))
    rows = diagnosed(s, d).select("incident_id", "cause", "explanation", F.lit("free space").alias("immediate_action"), F.lit("low").alias("risk_level"), F.lit("complete").alias("status"), F.when(F.col("degraded"), F.slice(sources, 1, 0)).otherwise(sources).alias("citations"))
    return agents.report(rows).select("incident_id", F.md5("report").alias("digest"))


query(
    "incident_reports",
    f"WITH {_TRIAGE} SELECT window_id AS incident_id, md5('# Incident ' || window_id || chr(10) || chr(10) || 'Status: complete' || chr(10) || chr(10) || '## Cause' || chr(10) || chr(10) || CASE WHEN window_id % 3 != 2 THEN 'disk full. no room' ELSE replace(coalesce(cause, 'unknown'), '_', ' ') || '. no explanation is available' END || chr(10) || chr(10) || '## Action' || chr(10) || chr(10) || 'free space (risk: low)' || CASE WHEN window_id % 3 != 2 THEN chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '1. Disks' || chr(10) || '2. Quota' ELSE '' END) AS digest FROM tc WHERE status = 'incident'",
)(reports)


def shown_passages(s: SparkSession, d: str) -> DataFrame:
    hits = kno.bm25_hits(s, d, 30, ("doc_id", "text")).withColumn("citation", F.col("doc_id").cast("string")).drop("doc_id")
    return agents.passages(hits, 5).select("query_id", F.md5("passages").alias("digest"), F.size("citations").alias("n"))


query("numbered_passages", f"WITH {kno._bm25(30)}, five AS (SELECT query_id, rank, doc_id, text FROM hits JOIN ck USING (chunk_id) WHERE rank <= 5) SELECT query_id, md5(string_agg('[' || rank || '] ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest, CAST(count(*) AS INT) AS n FROM five GROUP BY query_id")(shown_passages)
query(
    "thread_list",
    f"WITH {kno._PLANS} SELECT plan_id AS thread_id, CASE WHEN plan_id % 2 = 0 THEN 'complete' ELSE 'running' END AS status, CASE WHEN plan_id % 5 = 0 THEN risk_level ELSE risk_floor END AS risk, plan_id % 2 = 0 AS finished FROM lv",
)(lambda s, d: (lambda k: agents.list_rows(response.with_floor(kno.plans(s, d)).select(k.alias("thread_id"), F.when(k % 2 == 0, "complete").otherwise("running").alias("status"), F.lit(None).cast("string").alias("assessor"), F.when(k % 5 != 0, F.col("risk_floor")).alias("floor"), F.col("risk_level").alias("author"))))(F.col("plan_id")))


def resumed(s: SparkSession, d: str) -> DataFrame:
    states = table(s, d, "orders").select(F.col("o_orderkey").alias("thread_id"), F.lit(1).alias("version"), F.when(F.col("o_orderkey") % 3 == 0, "awaiting_approval").otherwise("complete").alias("status"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve").alias("decision"), F.col("l_linenumber").cast("string").alias("principal"), F.timestamp_seconds(F.col("l_linenumber") * 60).alias("claimed_at"))
    return agents.resume(states, lines.where("principal != '1' or thread_id % 2 = 0"))


query(
    "resume_after_decision",
    "WITH g AS (SELECT l_orderkey, l_linenumber AS n, min(CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'A' END) AS flag FROM lineitem WHERE l_linenumber != 1 OR l_orderkey % 2 = 0 GROUP BY ALL), f AS (SELECT l_orderkey, min(n) AS n, arg_min(flag, n) AS flag FROM g GROUP BY l_orderkey) SELECT o_orderkey AS thread_id, CASE WHEN m THEN 2 ELSE 1 END AS version, CASE WHEN m THEN CASE WHEN flag = 'R' THEN 'rejected' ELSE 'complete' END WHEN o_orderkey % 3 = 0 THEN 'awaiting_approval' ELSE 'complete' END AS status, CASE WHEN m THEN n::VARCHAR END AS principal FROM (SELECT o_orderkey, flag, n, o_orderkey % 3 = 0 AND flag IS NOT NULL AS m FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)",
)(resumed)
query(
    "idempotent_retry",
    "SELECT o_orderkey AS request_id, o_custkey AS thread_id, CASE WHEN o_custkey % 4 = 0 THEN 202 WHEN o_custkey % 4 = 1 THEN 409 ELSE 200 END AS code, CASE WHEN o_custkey % 4 = 2 THEN 'complete' WHEN o_custkey % 4 = 3 THEN 'failed' END AS status FROM orders",
)(
    lambda s, d: agents.retried(
        table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("thread_id")),
        table(s, d, "customer").where("c_custkey % 4 != 0").select(F.col("c_custkey").alias("thread_id"), F.when(F.col("c_custkey") % 4 == 1, "running").when(F.col("c_custkey") % 4 == 2, "complete").otherwise("failed").alias("status")),
    )
)


def evaluated(s: SparkSession, d: str) -> DataFrame:
    """Assistant turns as cases: passed if they hold both of two terms."""
    rows = table(s, d, "conversations").where("role = 'assistant'")
    passed = agents.all_terms(F.array(F.lit("The"), F.lit("in")), F.col("text"))
    return rows.select(passed.alias("passed"), (F.col("turn") % 2 == 1).alias("retrieved"), F.lit(1.0).alias("grounded"), (F.col("conv_id") % 10 == 0).alias("degraded"), F.length("text").cast("long").alias("tokens"))


_EVAL = "ev AS (SELECT count(*) AS cases, round(avg((contains(lower(text), 'the') AND contains(lower(text), 'in'))::INT), 6) AS passed, round(avg((turn % 2 = 1)::INT), 6) AS retrieved, 1.0::DOUBLE AS grounded, sum((conv_id % 10 = 0)::INT)::BIGINT AS degraded, sum(length(text))::BIGINT AS tokens FROM conversations WHERE role = 'assistant')"
query("evaluation_summary", f"WITH {_EVAL} SELECT * FROM ev")(lambda s, d: agents.evaluation(evaluated(s, d)))
query("quality_floors", f"WITH {_EVAL} SELECT * FROM (SELECT 'passed' AS name, passed AS value, 1.1::DOUBLE AS floor FROM ev UNION ALL SELECT 'grounded', grounded, 0.9 FROM ev) WHERE value < floor UNION ALL SELECT 'degraded', degraded::DOUBLE, 0.0 FROM ev WHERE degraded > 0")(
    lambda s, d: agents.below_floors(agents.evaluation(evaluated(s, d)), {"passed": 1.1, "grounded": 0.9})
)
query("risk_under_ids", f"WITH {kno._PLANS}, c AS (SELECT plan_id, plan_id // 5 % 3 + 1 AS e, {kno._P.format('risk_level')} AS a FROM lv) SELECT 'author' AS rule, md5(string_agg(plan_id::VARCHAR, ',' ORDER BY plan_id::VARCHAR)) AS digest FROM c WHERE a < e")(
    lambda s, d: response.evaluate_rules(kno.cases(s, d)).where("rule = 'author'").select("rule", F.md5("under_ids").alias("digest"))
)
# -- splits, selection, ranking of what is reported
query("train_machines", "SELECT DISTINCT c_nationkey AS machine FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 5) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(
    lambda s, d: series.remaining(table(s, d, "customer").select(F.col("c_nationkey").alias("machine")), table(s, d, "supplier").where("s_nationkey < 5").select(F.col("s_nationkey").alias("machine")), table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("machine")))
)
query("halve_at_normal", with_base("SELECT series_id, t AS cut FROM (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY abs(t - n // 2), t) AS k FROM mp JOIN (SELECT series_id, max(t) + 1 AS n FROM mp GROUP BY series_id) USING (series_id) WHERE point_label = 0) WHERE k = 1"))(
    lambda s, d: series.cut_points(points(s, d), {"half": 0.5}).select("series_id", "cut")
)
query("index_subset", with_base("SELECT idx.* FROM idx JOIN (SELECT series_id FROM (SELECT DISTINCT series_id FROM mp) WHERE right(series_id, 1) IN ('1', '3')) USING (series_id)"))(
    lambda s, d: (lambda p: det.windows.window_index(p, det.incidents_of(p), G).join(F.broadcast(p.select("series_id").distinct().where(F.right("series_id", F.lit(1)).isin("1", "3"))), "series_id", "left_semi"))(points(s, d))
)
query(
    "patience",
    "SELECT l_orderkey AS run, l_linenumber AS epoch, min(l_quantity::DOUBLE) OVER w AS best, l_linenumber - max(CASE WHEN l_quantity < coalesce(before, 1e18) THEN l_linenumber END) OVER w AS waited FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)",
)(lambda s, d: evaluate.patience(table(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("epoch"), F.col("l_quantity").cast("double").alias("error"))))
query(
    "selection_criterion",
    with_base("SELECT round(avg(score), 6) AS over_all, round(avg(score) FILTER (label = 0), 6) AS over_normal, (SELECT round(average_precision, 6) FROM ap) AS average_precision FROM sw", det._AP),
)(lambda s, d: rounded(evaluate.selection_criterion(det.spread_windows(points(s, d))[1])))
query(
    "against_incumbent",
    f"WITH c AS ({det._compared_sql()}) SELECT c.detector, c.curve_auc, round(c.curve_auc - i.curve_auc, 6) AS delta FROM c, (SELECT curve_auc FROM c WHERE detector = 'window_spread') i ORDER BY c.curve_auc DESC, c.detector",
)(lambda s, d: evaluate.against(rounded(det.compared(points(s, d))), "window_spread"))
def _poisson_sql(mean: str, first: str, second: str) -> str:
    """DuckDB form of :func:`classify.poisson`."""
    terms = classify.POISSON_TERMS
    chance = f"exp(k * ln({mean}) - {mean} - lgamma(k + 1))"
    series = f"(SELECT count(*) FROM (SELECT sum(c) OVER (ORDER BY k) AS upto FROM (SELECT k, {chance} AS c FROM range({terms}) s(k))) WHERE upto < {first})"
    return f"CASE WHEN {mean} < {classify.POISSON_NORMAL} THEN {series} ELSE greatest(0, floor({mean} + sqrt({mean}) * sqrt(-2 * ln({first})) * cos(2 * pi() * {second}) + 0.5))::BIGINT END"


_U = "(CAST(('0x' || substr(md5('42:' || b || ':' || truth || ':' || predicted || ':{}'), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
query(
    "vote_macro_f1_ci",
    f"""WITH v AS (SELECT o_orderstatus AS truth, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS predicted FROM orders),
cells AS (SELECT truth, predicted, count(*)::DOUBLE AS m FROM v GROUP BY ALL),
u AS (SELECT b, truth, predicted, m, {_U.format(1)} AS u1, {_U.format(2)} AS u2 FROM range(2000) x(b), cells),
d AS (SELECT b, truth, predicted, {_poisson_sql('m', 'u1', 'u2')} AS n FROM u),
t AS (SELECT b, truth AS c, sum(n) AS t, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS tp FROM d WHERE n > 0 GROUP BY ALL), p AS (SELECT b, predicted AS c, sum(n) AS p FROM d WHERE n > 0 GROUP BY ALL),
f AS (SELECT b, avg(2.0::DOUBLE * coalesce(tp, 0) / (coalesce(t, 0) + coalesce(p, 0))) AS f1 FROM t FULL JOIN p USING (b, c) GROUP BY b)
SELECT round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM f""",
)(lambda s, d: classify.macro_f1_interval(table(s, d, "orders").select(F.col("o_orderstatus").alias("truth"), F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("predicted"))))
query("largest_shares", "SELECT p_brand AS name, sum(p_retailprice::DOUBLE) AS importance FROM part GROUP BY p_brand ORDER BY importance DESC, name LIMIT 12")(
    lambda s, d: classify.most_important(table(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sum(F.col("p_retailprice").cast("double")).alias("importance")), 12)
)


def pretended_reports(s: SparkSession, d: str) -> DataFrame:
    """Report rows from the parts: two seeds of each brand are runs of one family."""
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(
        F.concat("p_brand", F.lit("[s"), k.cast("string"), F.lit("]")).alias("detector"), F.round(F.col("p_retailprice").cast("double") / 2500, 6).alias("curve_auc"), (F.pmod(k, F.lit(10)) / 10.0).alias("pre_alarmed_share"),
        F.pmod(k, F.lit(2)).cast("double").alias("detection_rate"), (F.pmod(k, F.lit(7)) / 10.0).alias("worst_duty"), F.when(k % 3 != 0, F.pmod(k, F.lit(60)).cast("double")).alias("median_minutes"),
    )
    return rows


_REPORTS = "rp AS (SELECT p_brand || '[s' || p_partkey || ']' AS detector, p_brand, round(p_retailprice::DOUBLE / 2500, 6) AS curve_auc, p_partkey % 10 / 10.0::DOUBLE AS pre_alarmed_share, p_partkey % 2 AS detection_rate, p_partkey % 7 / 10.0::DOUBLE AS worst_duty, CASE WHEN p_partkey % 3 != 0 THEN p_partkey % 60 END AS median_minutes FROM part)"
query("seed_spread", f"WITH {_REPORTS} SELECT p_brand AS family, count(*) AS runs, round(avg(curve_auc), 6) AS mean_auc, round(stddev_samp(curve_auc), 6) AS std_auc, round(max(curve_auc) - min(curve_auc), 6) AS spread FROM rp GROUP BY p_brand HAVING count(*) > 1")(lambda s, d: rounded(evaluate.seed_spread(pretended_reports(s, d))))
query("standing_alarms", f"WITH {_REPORTS} SELECT detector FROM rp WHERE detection_rate > 0 AND (pre_alarmed_share >= 0.2 OR worst_duty >= 0.5)")(lambda s, d: evaluate.standing_alarms(pretended_reports(s, d)).select("detector"))
query("chosen_of_reports", f"WITH {_REPORTS} SELECT arg_max(detector, (round(curve_auc, 9), -coalesce(median_minutes, 1e9), detector)) AS detector FROM rp")(lambda s, d: evaluate.chosen_detector(pretended_reports(s, d)))
query("class_of_event", "SELECT o_orderkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'other' END AS cause FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda s, d: classify.with_class(table(s, d, "orders").select(F.col("o_custkey").alias("event_id"), "o_orderkey"), table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("label"))).select(F.col("o_orderkey").alias("event_id"), "cause")
)
query("rule_answers", "SELECT event_id, CASE WHEN contains(event_type, 'err') THEN 'failed' WHEN contains(event_type, 'r') THEN 'other' ELSE 'fine' END AS answer FROM events")(lambda s, d: table(s, d, "events").select("event_id", kno.text.one_of(F.col("event_type"), {"err": "failed", "r": "other"}, "fine").alias("answer")))
query("json_payloads", "SELECT conv_id, turn, md5('{\"a\": ' || turn || '}') AS digest FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.md5(kno.text.json_payload(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here:\n```json\n{\"a\": "), F.col("turn").cast("string"), F.lit("}\n``` done"))).otherwise(F.concat(F.lit("it is {\"a\": "), F.col("turn").cast("string"), F.lit("} so"))))).alias("digest"))
)
query("overall_risk", f"WITH {kno._PLANS}, c AS (SELECT plan_id AS case_id, {kno._P.format('risk_level')} AS a, {kno._P.format('risk_floor')} AS f, CASE WHEN plan_id % 5 != 0 THEN plan_id // 7 % 3 + 1 ELSE 3 END AS s FROM lv) SELECT case_id, ['low', 'medium', 'high'][CAST(greatest(a, f, s) AS INT)] AS overall FROM c")(
    lambda s, d: response.overall_risk(kno.cases(s, d)).select("case_id", "overall")
)
query(
    "split_search",
    with_base(
        "SELECT seed, coverage, seed = (SELECT arg_max(seed, (least(coverage, 5), -seed)) FROM cov) AS chosen FROM cov",
        "ev AS (SELECT series_id, event_id, 'c' || (event_id % 2) AS cause FROM inc), seeds AS (SELECT CAST(x AS INT) AS seed FROM range(12) r(x)), "
        "rk AS (SELECT seed, series_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || series_id), series_id) AS k, count(*) OVER (PARTITION BY seed) AS n FROM seeds, (SELECT DISTINCT series_id FROM ev)), "
        "pt AS (SELECT seed, series_id, CASE WHEN k <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN k <= floor(n * (0.6::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM rk), "
        "ct AS (SELECT seed, split, cause, count(DISTINCT event_id) AS n FROM pt JOIN ev USING (series_id) GROUP BY ALL), "
        "cov AS (SELECT seed, CASE WHEN count(*) = (SELECT count(DISTINCT cause) * 3 FROM ev) THEN min(n) ELSE 0 END AS coverage FROM ct GROUP BY seed)",
    ),
)(lambda s, d: classify.split_search(det.incidents_of(points(s, d)).select("series_id", "event_id", F.concat(F.lit("c"), F.pmod("event_id", F.lit(2)).cast("string")).alias("cause")), 12))


def investigated(s: SparkSession, d: str) -> DataFrame:
    """One plan from symptoms to a report: the items of the benchmark are reports of symptoms, passages found for them feed the
    diagnosis and the plan, and the report names their sources. The provider answers from the first passage, or not at all."""
    hits = kno.bm25_hits(s, d, 5, ("doc_id", "text")).withColumn("citation", F.concat(F.lit("page "), F.col("doc_id").cast("string"))).drop("doc_id")
    found = agents.passages(hits, 3)
    k = F.col("item_id")
    cause = F.when(k % 3 != 0, F.concat(F.lit("disk_"), (k % 3).cast("string")))
    incidents = table(s, d, "benchmark").select(k.alias("incident_id"), F.col("text").alias("symptoms"), cause.alias("cause"))
    rows = incidents.join(found.withColumnRenamed("query_id", "incident_id"), "incident_id", "left")
    rows = retrieval.written(rows, "investigations")
    first = lambda prompt: F.regexp_extract(prompt, r"\[1\] (page [0-9]+)\n", 1)

    def explains(prompt):
        return F.when(first(prompt) != "", F.concat(F.lit('{"cause": "quota", "explanation": "as in '), first(prompt), F.lit('", "confidence": "high"}')))

    def plans_(prompt):
        return F.when(first(prompt) != "", F.concat(F.lit('{"immediate_action": "read '), first(prompt), F.lit('", "short_term_fix": "clean", "long_term_fix": "grow", "risk_level": "low"}')))

    diagnosed_ = agents.diagnose(rows, explains)
    asked = diagnosed_.join(rows.select("incident_id", "passages", "citations"), "incident_id")
    planned = agents.remediate(asked, plans_).select("incident_id", "immediate_action", "risk_level")
    told = asked.join(planned, "incident_id").withColumn("status", F.lit("complete"))
    cited = F.coalesce("citations", F.array().cast("array<struct<chunk_id:string,title:string>>"))
    ids = F.array_join(F.transform(cited, lambda c: c["chunk_id"]), ",")
    reports_ = agents.report(told.withColumn("citations", cited))
    return told.join(reports_, "incident_id").select("incident_id", "cause", "explanation", "confidence", "degraded", "immediate_action", "risk_level", ids.alias("chunk_ids"), F.md5("report").alias("digest"))


query(
    "investigations",
    f"""WITH {kno._bm25(5)}, three AS (SELECT query_id, rank, chunk_id, doc_id FROM hits JOIN ck USING (chunk_id) WHERE rank <= 3),
f AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids, string_agg(rank || '. page ' || doc_id, chr(10) ORDER BY rank) AS sources, 'page ' || any_value(doc_id) FILTER (rank = 1) AS first FROM three GROUP BY query_id),
r AS (SELECT item_id AS incident_id, CASE WHEN first IS NOT NULL THEN 'quota' WHEN item_id % 3 != 0 THEN 'disk_' || (item_id % 3) ELSE 'unknown' END AS cause, coalesce('as in ' || first, 'no explanation is available') AS explanation,
  CASE WHEN first IS NULL THEN 'low' ELSE 'high' END AS confidence, first IS NULL AS degraded, coalesce('read ' || first, 'a person must decide') AS immediate_action, CASE WHEN first IS NULL THEN 'high' ELSE 'low' END AS risk_level, coalesce(chunk_ids, '') AS chunk_ids, sources FROM benchmark LEFT JOIN f ON query_id = item_id)
SELECT incident_id, cause, explanation, confidence, degraded, immediate_action, risk_level, chunk_ids, md5('# Incident ' || incident_id || chr(10) || chr(10) || 'Status: complete' || chr(10) || chr(10) || '## Cause' || chr(10) || chr(10) || replace(cause, '_', ' ') || '. ' || explanation || chr(10) || chr(10) || '## Action' || chr(10) || chr(10) || immediate_action || ' (risk: ' || risk_level || ')' || coalesce(chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || sources, '')) AS digest FROM r""",
)(investigated)
