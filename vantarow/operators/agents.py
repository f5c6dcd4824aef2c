"""From a scored window to a report: triage, prompts, validated answers, plans, states. Every step is a projection or a join.

A provider is a function from a prompt column to a reply column: a recorded table, a rule, or any Arrow function that
calls a model. A reply that doesn't fit its schema is asked for once more with the error; what still doesn't fit degrades.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantarow.functions import text
from vantarow.operators import response

Provider = Callable[[Column], Column]
#: States that an investigation doesn't leave.
TERMINAL = ("complete", "rejected", "no_incident", "failed")


@dataclass(frozen=True)
class Schema:
    """What an answer must hold: a DDL of its fields, all of them required but ``optional``; and values some are limited to."""

    ddl: str
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def fields(self) -> list[str]:
        return [f.strip().split(" ")[0] for f in self.ddl.split(",")]


DIAGNOSIS = Schema("cause string, explanation string, confidence string", (("confidence", response.LEVELS),))
PLAN = Schema("action string, immediate_action string, short_term_fix string, long_term_fix string, rollback string, risk_level string", (("risk_level", response.LEVELS),), ("action", "rollback"))
RATING = Schema("rating string", (("rating", response.LEVELS),))


def parse_answer(reply: Column, schema: Schema) -> Column:
    """Struct of value (null unless valid) and error (null if valid) of a reply that may be wrapped in prose or fences; extra keys are ignored."""
    value = F.from_json(text.json_payload(reply), schema.ddl, {"mode": "PERMISSIVE"})
    required = [f for f in schema.fields if f not in schema.optional]
    error = F.when(value.isNull() | F.forall(F.array(*[value[f].isNull() for f in schema.fields]), lambda x: x), "not a JSON object of the schema")
    for f in required:
        error = error.when(value[f].isNull(), f"missing {f}")
    for f, allowed in schema.enums:
        error = error.when(value[f].isNotNull() & ~value[f].isin(*allowed), F.concat(F.lit(f"{f} is "), value[f], F.lit(f", not one of {', '.join(allowed)}")))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def answered(rows: DataFrame, provider: Provider, schema: Schema, prompt: str = "prompt") -> DataFrame:
    """Adds value, error and attempts: the provider's answer to a prompt, asked for once more where it doesn't fit."""
    first = rows.withColumn("__reply", provider(F.col(prompt))).withColumn("__first", parse_answer(F.col("__reply"), schema))
    repair = F.concat(F.col(prompt), F.lit("\n\nYour reply could not be used: "), F.col("__first.error"), F.lit("\nIt was:\n"), F.coalesce("__reply", F.lit("")), F.lit("\nReply with the corrected JSON object and nothing else."))
    failed = F.col("__first.error").isNotNull()
    second = first.withColumn("__again", F.when(failed, parse_answer(provider(F.when(failed, repair)), schema)))
    return second.select(
        *rows.columns, F.coalesce("__first.value", "__again.value").alias("value"), F.when(failed, F.col("__again.error")).alias("error"), F.when(failed, 2).otherwise(1).alias("attempts")
    )


def unavailable(_prompt: Column) -> Column:
    """A provider that never answers."""
    return F.lit(None).cast("string")


def by_rules(rules: dict[str, str], default: str) -> Provider:
    """A provider that gives the answer of the first rule whose key the prompt holds."""
    return lambda prompt: text.one_of(prompt, rules, default)


def in_turn(replies: list[str], turn: Column) -> Provider:
    """A provider that gives one reply after the other, by the number of the turn; after the last, none."""
    return lambda _prompt: F.get(F.array(*[F.lit(r) for r in replies]), turn)


def triage(windows: DataFrame, threshold: Column, causes: DataFrame | None = None) -> DataFrame:
    """Status and cause of windows (window_id, reason, score): rejected, calm below the threshold, else incident.

    ``causes``: window_id, cause and probability of a classifier; asked for incidents only, and a window that it
    has nothing for is an incident without a cause.
    """
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("score") < threshold, "calm").when(F.col("score").isNotNull(), "incident").otherwise("rejected")
    rows = windows.withColumn("status", status)
    if causes is None:
        return rows.withColumns({"cause": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")})
    joined = rows.join(causes.select("window_id", F.col("cause").alias("__cause"), F.col("probability").alias("__p")), "window_id", "left")
    is_incident = F.col("status") == "incident"
    return joined.select(*rows.columns, F.when(is_incident, F.col("__cause")).alias("cause"), F.when(is_incident, F.col("__p")).alias("probability"))


def query_text(symptoms: Column, cause: Column) -> Column:
    """What retrieval is asked for: the symptoms and the cause with its underscores as spaces."""
    return F.trim(F.concat_ws(" ", F.trim(symptoms), F.replace(cause, F.lit("_"), F.lit(" "))))


def passages(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits (query_id, rank, chunk_id, citation, text) of each query as numbered passages and citations."""
    rows = hits.where(F.col("rank") <= most)
    each = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "citation", "text")))
    grouped = rows.groupBy("query_id").agg(each.alias("h"))
    numbered = F.transform("h", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["citation"], F.lit("\n"), x["text"]))
    return grouped.select("query_id", F.array_join(numbered, "\n\n").alias("passages"), F.transform("h", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["citation"].alias("title"))).alias("citations"))


def diagnose(incidents: DataFrame, provider: Provider) -> DataFrame:
    """Diagnosis of incidents (incident_id, symptoms, cause, passages); an answer that never fits degrades to the classifier's cause."""
    prompt = F.concat(F.lit("Explain the incident. Symptoms: "), F.col("symptoms"), F.lit("\nPassages:\n"), F.coalesce("passages", F.lit("none")))
    rows = answered(incidents.withColumn("prompt", prompt), provider, DIAGNOSIS)
    degraded = F.col("value").isNull()
    return rows.select(
        "incident_id", F.coalesce("value.cause", "cause", F.lit("unknown")).alias("cause"), F.coalesce("value.explanation", F.lit("no explanation is available")).alias("explanation"),
        F.coalesce("value.confidence", F.lit("low")).alias("confidence"), degraded.alias("degraded"), "attempts",
    )


def remediate(diagnoses: DataFrame, provider: Provider) -> DataFrame:
    """Plans for diagnoses (incident_id, cause, explanation, passages); without a fitting answer a plan of high risk and no action."""
    prompt = F.concat(F.lit("Plan a remedy. Cause: "), F.col("cause"), F.lit("\n"), F.col("explanation"), F.lit("\nPassages:\n"), F.coalesce("passages", F.lit("none")))
    rows = answered(diagnoses.withColumn("prompt", prompt), provider, PLAN)
    nothing = F.lit("a person must decide")
    return rows.select(
        "incident_id", F.col("value.action").alias("action"), *[F.coalesce(f"value.{f}", nothing).alias(f) for f in ("immediate_action", "short_term_fix", "long_term_fix")],
        F.col("value.rollback").alias("rollback"), F.coalesce("value.risk_level", F.lit("high")).alias("risk_level"), F.col("value").isNull().alias("degraded"),
    )


def assess(plans: DataFrame, provider: Provider) -> DataFrame:
    """Adds the assessor's rating and the overall risk of plans with author and floor; a plan its author rates high isn't asked about."""
    asked = F.col("author") != "high"
    rows = plans.withColumn("prompt", F.when(asked, F.concat(F.lit("Rate the risk: "), F.col("plan"))))
    rated = answered(rows, lambda prompt: F.when(prompt.isNotNull(), provider(prompt)), RATING)
    named = rated.withColumn("assessor", F.when(asked, F.col("value.rating")))
    overall = F.when(asked, response.highest(F.col("author"), F.col("floor"), F.coalesce("assessor", F.lit("high")))).otherwise("high")
    return named.select(*plans.columns, "assessor", overall.alias("overall"))


def report(rows: DataFrame) -> DataFrame:
    """Markdown reports of incidents (incident_id, cause, explanation, immediate_action, risk_level, status, citations)."""
    sources = F.when(F.size("citations") > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(F.transform("citations", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["title"])), "\n"))).otherwise("")
    body = F.concat(
        F.lit("# Incident "), F.col("incident_id").cast("string"), F.lit("\n\nStatus: "), F.col("status"), F.lit("\n\n## Cause\n\n"), F.replace(F.col("cause"), F.lit("_"), F.lit(" ")), F.lit(". "), F.col("explanation"),
        F.lit("\n\n## Action\n\n"), F.col("immediate_action"), F.lit(" (risk: "), F.col("risk_level"), F.lit(")"), sources,
    )
    return rows.select("incident_id", body.alias("report"))


#: What clients never see of a state.
HIDDEN = ("window", "feature_names", "approval_token")


def public_view(states: DataFrame) -> DataFrame:
    return states.drop(*HIDDEN)


def list_rows(states: DataFrame) -> DataFrame:
    """One line for each thread; its risk is the first known of assessor, policy and author."""
    return states.select("thread_id", "status", F.coalesce("assessor", "floor", "author").alias("risk"), F.col("status").isin(*TERMINAL).alias("finished"))


def resume(states: DataFrame, decisions: DataFrame) -> DataFrame:
    """Next version of states (thread_id, version, status) after decisions (thread_id, decision, principal, claimed_at).

    Only what awaits approval takes one, the first; a repeated or late decision changes nothing. Of decisions that one
    principal claims at the same time, an approval comes before a rejection.
    """
    first = response.first_decision(decisions.select(F.col("thread_id").alias("incident_id"), "principal", "claimed_at", F.lit("done").alias("state"))).select(F.col("incident_id").alias("thread_id"), "principal", "claimed_at")
    taken = first.join(decisions, ["thread_id", "principal", "claimed_at"]).groupBy("thread_id").agg(F.min("decision").alias("decision"), F.min("principal").alias("principal"))
    rows = states.join(taken, "thread_id", "left")
    moves = (F.col("status") == "awaiting_approval") & F.col("decision").isNotNull()
    return rows.select(
        "thread_id", F.when(moves, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(moves, F.when(F.col("decision") == "approve", "complete").otherwise("rejected")).otherwise(F.col("status")).alias("status"), F.when(moves, F.col("principal")).alias("principal"),
    )


def retried(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Answer to requests (request_id, thread_id) that may be repeats: 200 and the recorded status, 409 while one runs, else 202."""
    rows = requests.join(outcomes.select("thread_id", F.col("status").alias("__s")), "thread_id", "left")
    code = F.when(F.col("__s").isNull(), 202).when(F.col("__s").isin(*TERMINAL), 200).otherwise(409)
    return rows.select("request_id", "thread_id", code.alias("code"), F.when(code == 200, F.col("__s")).alias("status"))


def all_terms(terms: Column, answer: Column) -> Column:
    """Whether an answer holds every expected term, in any case."""
    return F.forall(terms, lambda t: F.contains(F.lower(answer), F.lower(t)))


def evaluation(cases: DataFrame) -> DataFrame:
    """Summary of evaluated cases (passed, retrieved, grounded, degraded, tokens); empty input counts as one case of nothing."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), *[F.round(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) / n, 6).alias(c) for c in ("passed", "retrieved", "grounded")],
        F.coalesce(F.sum(F.col("degraded").cast("long")), F.lit(0)).alias("degraded"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


def below_floors(summary: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Measures (name, value, floor) of a summary that lie below their floor; any degraded answer is one too."""
    measures = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("floor")) for k, v in floors.items()])
    low = summary.select(F.explode(measures).alias("m")).select("m.*").where("value < floor")
    return low.unionByName(summary.where("degraded > 0").select(F.lit("degraded").alias("name"), F.col("degraded").cast("double").alias("value"), F.lit(0.0).alias("floor")))


def newest_threads(checkpoints: DataFrame) -> DataFrame:
    """How many threads and versions there are, and the newest version of each thread."""
    order = Window.partitionBy("thread_id")
    return checkpoints.withColumn("newest", F.max("version").over(order)).agg(F.countDistinct("thread_id").alias("threads"), F.count(F.lit(1)).alias("versions"), F.sum((F.col("version") == F.col("newest")).cast("long")).alias("newest"))
