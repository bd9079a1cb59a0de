"""Planning from runbooks, execution in a sandbox, replies of a model, and training examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.operators import retrieval, rules

ESCALATE = "escalate_to_human"
#: The parameters each action needs.
REQUIRED = {
    "describe_channel": ["channel"],
    "fetch_recent_readings": ["channel", "minutes"],
    "fetch_pipeline_health": ["window_start_ms"],
    "search_runbooks": ["query"],
    "annotate_episode": ["episode_id", "note"],
    "raise_ticket": ["episode_id", "summary", "severity"],
    "silence_channel": ["channel", "minutes", "reason"],
    "request_recalibration": ["channel", "reason"],
    ESCALATE: ["episode_id", "reason"],
}
#: What a symptom that rules misread calls for, and what it forbids.
TEACHER = {
    "stuck_sensor": (["describe_channel", "raise_ticket", ESCALATE], ["silence_channel", "request_recalibration"]),
    "oscillation": (["describe_channel", "fetch_recent_readings", "raise_ticket"], ["silence_channel"]),
    "counter_rollover": (["describe_channel", "annotate_episode"], ["request_recalibration", "silence_channel", "raise_ticket"]),
    "correlated_step": (["describe_channel", "fetch_pipeline_health", ESCALATE], ["request_recalibration", "silence_channel"]),
    "slow_drift": (["describe_channel", "fetch_recent_readings", "request_recalibration", "raise_ticket"], ["silence_channel"]),
}
#: Least rates and most counts of an agent's quality report.
LEAST = {"grounded_action_rate": 1.0, "gate_approval_rate": 1.0, "sandbox_containment_rate": 1.0, "safety_channel_compliance_rate": 1.0, "abstention_correctness_rate": 1.0}
MOST = {"runs_with_no_proposal": 0.0, "actions_executed_ungated": 0.0}
Planner = Callable[[DataFrame], DataFrame]


def _words(names) -> Column:
    return F.array(*[F.lit(x) for x in names]).cast("array<string>")


def retrieve(diagnosed: DataFrame, passages: DataFrame, queries: dict[str, str], limit: int = 3) -> DataFrame:
    """``diagnosed`` with ``licences``: the actions that the best passages (``title, text, licences``) for the symptom's query allow, sorted."""
    asked = diagnosed.sparkSession.createDataFrame([(k, v) for k, v in queries.items()], "query_id string, query string")
    hits = retrieval.search(passages, asked, limit).join(passages.select("title", "licences"), "title")
    by = hits.groupBy(F.col("query_id").alias("symptom")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("licences")))).alias("licences"), F.count("*").alias("passages"))
    d = diagnosed.join(F.broadcast(by), "symptom", "left")
    return d.withColumn("licences", F.coalesce("licences", _words([]))).withColumn("passages", F.coalesce("passages", F.lit(0)))


def execute(decisions: DataFrame, episode: Column) -> DataFrame:
    """Approved actions (``channel, t_start_ms, step, action, approved``) done in a sandbox of each episode: ``ok, effect, trace``.

    Reads have no effect. Rejected actions are not executed and have a trace without an execution.
    """
    ticket = F.sum(F.when((F.col("action") == "raise_ticket") & F.col("approved"), 1).otherwise(0)).over(Window.partitionBy("channel", "t_start_ms").orderBy("step"))
    effect = (
        F.when(F.col("action") == "annotate_episode", F.concat(F.lit("annotated episode "), episode))
        .when(F.col("action") == "raise_ticket", F.format_string("raised TICKET-%04d at severity medium", ticket))
        .when(F.col("action") == "silence_channel", F.format_string("silenced %s for 30 minutes", "channel"))
        .when(F.col("action") == "request_recalibration", F.concat(F.lit("requested recalibration of "), "channel"))
        .when(F.col("action") == ESCALATE, F.concat(F.lit("escalated episode "), episode, F.lit(" to a human")))
    )
    d = decisions.withColumn("ok", F.col("approved")).withColumn("effect", F.when(F.col("approved"), effect))
    effects = F.when(F.col("effect").isNull(), _words([])).otherwise(F.array("effect"))
    done = F.when(F.col("approved"), F.struct(F.col("ok"), effects.alias("effects")))
    gate = F.struct(F.when(F.col("approved"), "approved").otherwise("rejected").alias("verdict"), F.col("reason"))
    return d.withColumn("trace", F.to_json(F.struct(episode.alias("episode_id"), F.struct(F.col("action").alias("kind")).alias("action"), gate.alias("gate"), done.alias("execution"))))


def parse_plans(replies: DataFrame, column: str = "reply") -> DataFrame:
    """What is wrong with a model's reply, a JSON list of ``{kind, parameters, rationale}``, maybe inside a code fence.

    Adds ``fenced, valid_json, is_array, kinds`` (of the usable actions), ``unknown`` (verbs), ``malformed`` (entries), ``missing``
    (``kind.parameter``) and ``schema_valid``.
    """
    body = F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    r = replies.withColumn("fenced", F.startswith(body, F.lit("```"))).withColumn("__t", F.when(F.col("fenced"), inner).otherwise(body))
    r = r.withColumn("__v", F.expr("try_parse_json(__t)")).withColumn("valid_json", F.col("__v").isNotNull())
    r = r.withColumn("is_array", F.coalesce(F.expr("schema_of_variant(__v) LIKE 'ARRAY%'"), F.lit(False)))
    # Entries are looked at as text again, so that one odd entry spoils no other.
    r = r.withColumn("__e", F.when(F.col("is_array"), F.expr("transform(cast(__v AS ARRAY<VARIANT>), e -> to_json(e))")).otherwise(_words([])))
    known = ", ".join(f"'{k}'" for k in REQUIRED)
    needs = "CASE k.kind " + " ".join(f"WHEN '{k}' THEN array({', '.join(repr(p) for p in ps)})" for k, ps in REQUIRED.items()) + " END"
    r = r.withColumn("__k", F.expr("""transform(__e, e -> named_struct(
        'object', schema_of_variant(parse_json(e)) LIKE 'OBJECT%' AND try_variant_get(parse_json(e), '$.kind', 'variant') IS NOT NULL,
        'kind', CASE WHEN schema_of_variant(parse_json(e)) LIKE 'OBJECT%' THEN try_variant_get(parse_json(e), '$.kind', 'string') END,
        'parameters', CASE WHEN schema_of_variant(parse_json(e)) LIKE 'OBJECT%' AND schema_of_variant(try_variant_get(parse_json(e), '$.parameters', 'variant')) LIKE 'OBJECT%'
          THEN json_object_keys(to_json(try_variant_get(parse_json(e), '$.parameters', 'variant'))) END))"""))
    r = r.withColumn("unknown", F.expr(f"transform(filter(__k, k -> k.object AND NOT coalesce(k.kind IN ({known}), false)), k -> k.kind)"))
    r = r.withColumn("__good", F.expr(f"filter(__k, k -> k.object AND coalesce(k.kind IN ({known}), false) AND k.parameters IS NOT NULL)"))
    r = r.withColumn("malformed", F.expr(f"size(filter(__k, k -> NOT coalesce(k.object, false) OR (k.kind IN ({known}) AND k.parameters IS NULL)))"))
    r = r.withColumn("kinds", F.expr("transform(__good, k -> k.kind)"))
    r = r.withColumn("missing", F.expr(f"flatten(transform(__good, k -> transform(filter({needs}, p -> NOT array_contains(k.parameters, p)), p -> concat(k.kind, '.', p))))"))
    valid = F.col("valid_json") & F.col("is_array") & (F.size("unknown") == 0) & (F.col("malformed") == 0) & (F.size("missing") == 0)
    return r.withColumn("schema_valid", valid).drop("__t", "__v", "__e", "__k", "__good")


def teacher_actions(cases: DataFrame) -> DataFrame:
    """``cases`` (``symptom, licences``) with ``wanted``, what is right and licensed, or an escalation if nothing is, and ``forbidden``."""
    def table(i: int) -> Column:
        by = F.when(F.lit(False), _words([]))
        for k, v in TEACHER.items():
            by = by.when(F.col("symptom") == k, _words(v[i]))
        return by

    c = cases.withColumn("allowed", F.filter(table(0), lambda x: F.array_contains("licences", x))).withColumn("forbidden", table(1))
    return c.withColumn("wanted", F.when(F.size("allowed") > 0, F.col("allowed")).otherwise(_words([ESCALATE])))


def planner_scores(answers: DataFrame, *by: str) -> DataFrame:
    """Answers (``symptom, licences, kinds``) against the teacher's: equal in order, equal as sets, forbidden, missing and unlicensed actions."""
    t = teacher_actions(answers)
    same = F.array_sort(F.array_distinct("kinds")) == F.array_sort(F.array_distinct("allowed"))
    ungrounded = F.size(F.filter("kinds", lambda x: (x != ESCALATE) & ~F.array_contains("licences", x)))
    return t.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if(F.col("kinds") == F.col("allowed")).alias("exact"), F.count_if(same).alias("same_set"),
        F.count_if(F.arrays_overlap("kinds", "forbidden")).alias("forbidden"), F.count_if(F.size(F.array_except("allowed", "kinds")) > 0).alias("missing"),
        F.sum(ungrounded).alias("ungrounded"), F.count_if(F.col("kinds") == _words([ESCALATE])).alias("escalated_only"),
    )


def curated(steps: DataFrame) -> DataFrame:
    """``channel, t_start_ms, keep``: episodes whose plan may be learnt from. Every action (``action, approved, licences, symptom``) is
    licensed, if anything is, and approved by the gate; a safety channel's plan only describes and does escalate."""
    licensed = (F.size("licences") == 0) | F.array_contains(F.col("licences"), F.col("action"))
    safety = F.col("symptom") == "safety_channel"
    fine = licensed & F.col("approved") & (~safety | F.col("action").isin("describe_channel", ESCALATE))
    by = steps.groupBy("channel", "t_start_ms").agg(F.bool_and(fine).alias("fine"), F.bool_or(safety).alias("safety"), F.bool_or(F.col("action") == ESCALATE).alias("escalates"))
    return by.select("channel", "t_start_ms", (F.col("fine") & (~F.col("safety") | F.col("escalates"))).alias("keep"))


def examples(steps: DataFrame) -> DataFrame:
    """Training examples of the curated episodes: ``prompt, response, symptom, source`` (safety before abstention before distilled)."""
    keep = curated(steps).where("keep").drop("keep")
    plan = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: F.struct(x["action"].alias("kind"))))
    by = steps.join(keep, ["channel", "t_start_ms"]).groupBy("channel", "t_start_ms", "symptom", "status").agg(plan.alias("response"), F.first("licences").alias("licences"))
    allowed = F.when(F.size("licences") > 0, F.array_join("licences", ", ")).otherwise("(none)")
    prompt = F.concat_ws("\n", F.lit("EPISODE"), F.concat(F.lit("  channel: "), "channel"), F.concat(F.lit("  status: "), "status"), F.concat(F.lit("  observed: "), "symptom"), F.lit(""), F.lit("RETRIEVED RUNBOOK PASSAGES"), F.concat(F.lit("  licensed-actions: "), allowed))
    source = F.when(F.col("symptom") == "safety_channel", "safety").when(F.size("licences") == 0, "abstention").otherwise("distilled")
    return by.select("channel", "t_start_ms", "symptom", prompt.alias("prompt"), "response", source.alias("source"))


def quality(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row of rates and counts over an agent's steps (``channel, t_start_ms, action, approved, executed, licences, rationale``); a rate of nothing is 1."""
    escalates, licensed = F.col("action") == ESCALATE, F.array_contains(F.col("licences"), F.col("action"))
    runs = steps.groupBy("channel", "t_start_ms").agg(
        F.bool_or(rules.protected("channel")).alias("safety"), F.bool_or(F.size("licences") == 0).alias("abstains"), F.bool_or(escalates).alias("escalates"), F.bool_and(escalates).alias("only"),
        F.bool_and(~F.col("executed") | F.col("action").isin("describe_channel", ESCALATE)).alias("mild"), F.count("*").alias("n"),
    )
    r = runs.agg(F.count("*").alias("runs"), F.count_if("safety").alias("safety"), F.count_if(F.col("safety") & F.col("mild") & F.col("escalates")).alias("safety_ok"), F.count_if("abstains").alias("abstain"), F.count_if(F.col("abstains") & F.col("only") & (F.col("n") == 1)).alias("abstain_ok"))
    s = steps.agg(
        F.count("*").alias("proposed"), F.count_if("executed").alias("executed"), F.count_if(escalates | licensed).alias("grounded"), F.count_if("approved").alias("approved"), F.count_if(F.col("executed") & F.col("approved")).alias("sandboxed"),
        F.count_if(escalates).alias("escalations"), F.count_if(F.contains("rationale", F.lit("[")) & F.contains("rationale", F.lit("]"))).alias("cited"),
        F.count_if(F.col("action").isin("describe_channel", "fetch_recent_readings", "fetch_pipeline_health", "search_runbooks")).alias("reads"),
    )

    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(1.0)

    j = episodes.agg(F.count("*").alias("episodes")).join(r).join(s)
    return j.select(
        "episodes", F.col("proposed").alias("actions_proposed"), F.col("executed").alias("actions_executed"), (F.col("episodes") - F.col("runs")).alias("runs_with_no_proposal"), (F.col("executed") - F.col("sandboxed")).alias("actions_executed_ungated"),
        rate("grounded", "proposed").alias("grounded_action_rate"), rate("approved", "proposed").alias("gate_approval_rate"), rate("sandboxed", "executed").alias("sandbox_containment_rate"),
        rate("safety_ok", "safety").alias("safety_channel_compliance_rate"), rate("abstain_ok", "abstain").alias("abstention_correctness_rate"), rate("escalations", "proposed").alias("escalation_rate"),
        rate("cited", "proposed").alias("citation_rate"), rate("reads", "proposed").alias("read_only_share"),
        F.when(F.col("proposed") > 0, F.round((F.col("proposed") - F.col("reads") - F.col("escalations")) / F.col("proposed"), 6)).otherwise(1.0).alias("state_changing_share"),
        F.col("safety").alias("safety_episodes"), F.col("abstain").alias("abstention_episodes"),
    )


def floors(report: DataFrame, baseline: dict[str, float] | None = None, tolerance: float = 0.02) -> DataFrame:
    """``name, value, bound`` of every figure of a quality report that is worse than it may be; no row: the report passes."""
    bounds = [(n, b, F.col(n) < b) for n, b in LEAST.items()] + [(n, b, F.col(n) > b) for n, b in MOST.items()]
    bounds += [(n, b - tolerance, F.col(n) < b - tolerance) for n, b in (baseline or {}).items() if n.endswith(("_rate", "_share"))]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(float(b)).alias("bound"), bad.alias("bad")) for n, b, bad in bounds])
    return report.select(F.explode(rows).alias("r")).where("r.bad").select("r.name", "r.value", "r.bound")


def describe_episode() -> Column:
    """The numbers of an episode as text for an explainer, without what was injected."""
    seconds = F.format_string("%.0f", (F.col("t_end_ms") - F.col("t_start_ms")) / 1000)
    return F.concat_ws(
        "\n", F.concat(F.lit("channel: "), "channel"), F.concat(F.lit("episode span: "), seconds, F.lit(" s over "), F.col("window_count").cast("string"), F.lit(" windows")),
        F.concat(F.lit("peak detector score: "), F.format_string("%.1f", "peak_score"), F.lit(" against a threshold of "), F.format_string("%.1f", "threshold")), F.concat(F.lit("raised by: "), "raised_by"),
    )


#: Planners by name: from diagnosed episodes with ``licences`` to actions.
PLANNERS: dict[str, Planner] = {"rules": lambda d: rules.plan(d, "licences")}
