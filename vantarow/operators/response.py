"""Response layer: risk policy, plans, audit chain, statuses, costs, latencies, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high")
#: Action kinds, their command templates and the least risk of a plan that names one.
ACTIONS = (
    ("rollout_restart", "kubectl rollout restart deployment/{target}", "medium"),
    ("rollout_undo", "kubectl rollout undo deployment/{target}", "medium"),
    ("scale_out", "kubectl scale deployment/{target} --replicas=6", "low"),
    ("set_memory_limit", "kubectl set resources deployment/{target} --limits=memory=2Gi", "medium"),
    ("cordon_node", "kubectl drain node/{target} --ignore-daemonsets", "high"),
)


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACTIONS), "action string, template string, risk_floor string")


def ordinal(level: Column) -> Column:
    """Place of a level; null for none."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0).cast("long"))


def level(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), place.cast("int"))


def highest(*levels: Column) -> Column:
    """The highest of several levels; nulls don't count."""
    return level(F.greatest(*[ordinal(x) for x in levels]))


def with_floor(plans: DataFrame) -> DataFrame:
    """Adds risk_floor (low for plans that name no known action) and whether a human must approve."""
    table = F.broadcast(actions(plans.sparkSession).select("action", "risk_floor"))
    rows = plans.join(table, "action", "left").withColumn("risk_floor", F.coalesce("risk_floor", F.lit("low")))
    return rows.withColumn("overall", highest(F.col("risk_level"), F.col("risk_floor"))).withColumn("requires_approval", F.col("overall").isin("medium", "high"))


def overall_risk(rows: DataFrame) -> DataFrame:
    """Risk of plans with author, floor and assessor levels; no answer of the assessor counts as high, unless the author says so."""
    return rows.withColumn("overall", highest(F.col("author"), F.col("floor"), F.coalesce("assessor", F.lit("high"))))


def evaluate_rules(cases: DataFrame) -> DataFrame:
    """Per rule: cases rated, rated too low or too high, and which too low. Rows: case_id, expected, author, floor, assessor."""
    rules = F.explode(
        F.array(
            F.struct(F.lit("author").alias("rule"), F.col("author").alias("rating")),
            F.struct(F.lit("author_and_floor").alias("rule"), highest(F.col("author"), F.col("floor")).alias("rating")),
            F.struct(F.lit("all_three").alias("rule"), F.when(F.col("assessor").isNotNull(), highest(F.col("author"), F.col("floor"), F.col("assessor"))).alias("rating")),
        )
    )
    rows = cases.select("case_id", "expected", rules.alias("r")).where("r.rating is not null")
    under, over = ordinal(F.col("r.rating")) < ordinal(F.col("expected")), ordinal(F.col("r.rating")) > ordinal(F.col("expected"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.count(F.lit(1)).alias("rated"), F.sum(under.cast("long")).alias("under"), F.sum(over.cast("long")).alias("over"),
        F.array_join(F.array_sort(F.collect_list(F.when(under, F.col("case_id").cast("string")))), ",").alias("under_ids"),
    )


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with keys in order and no spaces; strings escaped as JSON, nulls as null, numbers as they print."""

    def one(value: Column) -> Column:
        return F.coalesce(value, F.lit("null"))

    parts: list[Column] = [F.lit("{")]
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{name}":'), one(fields[name])]
    return F.concat(*parts, F.lit("}"))


#: Characters that JSON writes in a short form.
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """JSON text of a string in ASCII: other characters, and control characters, as their UTF-16 units."""

    def one(char: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(char, "UTF-16BE"))), "(.{4})", "\\\\u$1")
        out = F.when(char.rlike(r"^[\x20\x21\x23-\x5B\x5D-\x7E]$"), char)
        for raw, short in _SHORT.items():
            out = out.when(char == F.lit(raw), F.lit(short))
        return out.otherwise(units)

    plain = text.rlike(r"^[\x20\x21\x23-\x5B\x5D-\x7E]*$")
    written = F.when(plain, text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), ""))
    return F.concat(F.lit('"'), written, F.lit('"'))


def plan_hash(plans: DataFrame) -> DataFrame:
    """sha256 of the canonical JSON of a plan's fields."""
    names = ("action", "immediate_action", "long_term_fix", "risk_level", "rollback", "short_term_fix")
    return plans.withColumn("plan_hash", F.sha2(canonical_json({n: json_string(F.col(n)) for n in names}), 256))


def request_key(*names: str) -> Column:
    return F.substring(F.sha2(canonical_json({n: json_string(F.col(n).cast("string")) for n in names}), 256), 1, 24)


def replay(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Recorded answers by request key; a miss is a degraded answer."""
    return requests.join(snapshots.select("request_key", F.col("text").alias("answer")), "request_key", "left").withColumn("degraded", F.col("answer").isNull())


def execute(plans: DataFrame) -> DataFrame:
    """Dry-run of plans (plan_hash, action, target, token, token_hash): refused, mismatched, unrecognised or the command."""
    table = F.broadcast(actions(plans.sparkSession).select("action", "template"))
    rows = plans.join(table, "action", "left")
    command = F.replace(F.col("template"), F.lit("{target}"), F.col("target"))
    detail = (
        F.when(F.col("token").isNull(), "refused: no approval").when(F.col("token_hash") != F.col("plan_hash"), "error: approval is for another plan").when(F.col("template").isNull(), "unrecognised action")
    )
    return rows.select("plan_hash", "action", detail.isNull().alias("executed"), F.when(detail.isNull(), command).alias("command"), F.coalesce(detail, F.lit("dry run")).alias("detail"))


GENESIS = "0" * 64


def audit_payload(names: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def build_chain(entries: DataFrame, names: tuple[str, ...], head: str | None = None) -> DataFrame:
    """Link entries of each log (log_id, seq, names) by hash. A log is a fold over its own rows in order, and only that.

    ``head``: column with the hash that the first entry of a log follows; null, or no column, is the genesis hash.
    """
    schema = entries.select("log_id", "seq", *names)
    begin = F.coalesce(F.col(head), F.lit(GENESIS)) if head else F.lit(GENESIS)
    rows_in = entries.select("log_id", "seq", *names, audit_payload(names).alias("__payload"), begin.alias("__begin"))

    def fold(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        rows = rows.sort_values("seq")
        last, before, own = rows["__begin"].iloc[0], [], []
        for payload in rows["__payload"]:
            before.append(last)
            last = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
            own.append(last)
        return rows.drop(columns=["__payload", "__begin"]).assign(previous_hash=before, entry_hash=own)

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return rows_in.groupBy("log_id").applyInPandas(fold, f"{typed}, previous_hash string, entry_hash string")


def verify_chain(log: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """First broken entry of each log, null if the chain holds: every row checks itself and the row before it."""
    order = Window.partitionBy("log_id").orderBy("seq")
    own = F.sha2(F.concat_ws("|", F.col("previous_hash"), audit_payload(names)), 256)
    linked = F.col("previous_hash") == F.coalesce(F.lag("entry_hash").over(order), F.lit(GENESIS))
    counted = F.col("seq") == F.row_number().over(order) - 1
    rows = log.withColumn("good", linked & counted & (F.col("entry_hash") == own))
    return rows.groupBy("log_id").agg(F.min(F.when(~F.col("good"), F.col("seq"))).alias("first_broken"), F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "seq").alias("head"))


def check_anchors(verified: DataFrame, log: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors (log_id, n, hash) against logs: the entry numbered n (from 1) must have the hash; 0 means genesis."""
    rows = log.select("log_id", (F.col("seq") + 1).alias("n"), "entry_hash")
    held = anchors.join(rows, ["log_id", "n"], "left").withColumn("holds", F.when(F.col("n") == 0, F.col("hash") == GENESIS).otherwise(F.coalesce(F.col("entry_hash") == F.col("hash"), F.lit(False))))
    return verified.join(held.groupBy("log_id").agg(F.min("holds").alias("anchored")), "log_id", "left")


def investigation_status(rows: DataFrame) -> DataFrame:
    """Status from what a run has: interrupt, report and decision, calm triage, else failed."""
    status = (
        F.when(F.col("interrupted"), "awaiting_approval").when(F.col("report").isNotNull() & (F.col("decision") == "rejected"), "rejected").when(F.col("report").isNotNull(), "complete")
        .when(F.coalesce("calm", F.lit(True)), "no_incident").otherwise("failed")
    )
    return rows.withColumn("status", status)


def incident_page(checkpoints: DataFrame, limit: int, offset: int) -> DataFrame:
    """Threads by their first checkpoint, newest first; limit 1 to 100, offset not negative."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset not negative")
    return checkpoints.groupBy("thread_id").agg(F.min("checkpoint_id").alias("first")).orderBy(F.desc("first")).offset(offset).limit(limit)


def first_decision(claims: DataFrame, stale_minutes: int = 15) -> DataFrame:
    """The claim that counts for each incident: the first; one left waiting beyond the limit gives way to the next."""
    order = Window.partitionBy("incident_id").orderBy("claimed_at", "principal")
    later = F.lead("claimed_at").over(order)
    stale = (F.col("state") == "waiting") & later.isNotNull() & (F.unix_timestamp(later) - F.unix_timestamp("claimed_at") >= stale_minutes * 60)
    return claims.withColumn("stale", stale).where("not stale").groupBy("incident_id").agg(F.min_by("principal", F.struct("claimed_at", "principal")).alias("principal"), F.min("claimed_at").alias("claimed_at"))


def retain(investigations: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Without what is older than the limit; nothing that awaits approval goes."""
    return investigations.where((F.col("status") == "awaiting_approval") | (F.col("updated_at") >= now - F.make_interval(days=F.lit(days))))


def token_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens and cost by model; the cost of a model without a rate is null."""
    sums = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = F.col("input_tokens") * F.col("input_rate") / 1e6 + F.col("output_tokens") * F.col("output_rate") / 1e6
    return sums.join(F.broadcast(rates), "model", "left").select("model", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost"))


def stage_latency(rows: DataFrame, last: int = 1000) -> DataFrame:
    """Nearest-rank p50 and p95 over the last rows of each stage (stage, seq, ms), and the count of all."""
    order = Window.partitionBy("stage").orderBy(F.desc("seq"))
    kept = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= last).groupBy("stage").agg(F.array_sort(F.collect_list("ms")).alias("a"))

    def at(f: float) -> Column:
        return F.element_at("a", F.least(F.floor(F.size("a") * f).cast("int"), F.size("a") - 1) + 1)

    return kept.join(rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage").select("stage", at(0.5).alias("p50"), at(0.95).alias("p95"), "n")


def rate_limit(requests: DataFrame, per_caller: int = 3, seconds: float = 60.0) -> DataFrame:
    """Admission of every request (caller, at in seconds, request_id): refused ones don't count towards the limit.

    The decision depends on earlier decisions, so each caller is a fold over its own requests, in order.
    """

    def fold(_key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        admitted: list[float] = []
        for rows in parts:
            out = []
            for at in rows["at"]:
                while admitted and admitted[0] <= at - seconds:
                    admitted.pop(0)
                ok = len(admitted) < per_caller
                if ok:
                    admitted.append(at)
                out.append(ok)
            yield rows.assign(admitted=out)

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return next(fold(key, iter([rows.sort_values(["at", "request_id"])])))

    return requests.select("caller", "at", "request_id").groupBy("caller").applyInPandas(whole, "caller long, at double, request_id long, admitted boolean")
