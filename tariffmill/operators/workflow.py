"""Review of unmatched services, price alerts, scheduling, run logs, enrichment and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import alert_fires, enrich_action, frequency_hours, jitter_minutes, next_run
from ..functions.text import normalize_name


#: The messages of review errors.
REVIEW_ERRORS = {
    "no_record": "Record not found",
    "closed": "Record is not reviewable",
    "no_target": "Target service is required",
    "target_missing": "Target service not found",
    "no_synonym": "Synonym is required",
    "no_name": "Name and category are required",
    "unknown": "Unknown action",
}


def occurrences(unmatched: DataFrame) -> DataFrame:
    """Queue records by service: count, first and last seen, the latest raw name."""
    return unmatched.groupBy("service_id").agg(F.count("*").alias("occurrence_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.max_by("raw_name", F.struct("seen_at", "raw_name")).alias("raw_name"))


def reopen(queue: DataFrame, seen: DataFrame) -> DataFrame:
    """The queue after another import: counts and dates move on, new services open, terminal states stay."""
    joined = queue.alias("q").join(seen.alias("n"), "service_id", "full")
    return joined.select(
        "service_id",
        (F.coalesce("q.occurrence_count", F.lit(0)) + F.coalesce("n.occurrence_count", F.lit(0))).alias("occurrence_count"),
        F.least("q.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.greatest("q.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
        F.coalesce("q.status", F.lit("open")).alias("status"),
    )


def queue_stats(queue: DataFrame) -> DataFrame:
    states = ("open", "needs_clarification", "approved", "rejected", "ignored")
    return queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def review(queue: DataFrame, actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each action's outcome: new_status, error, note, and what changes (link_to, new_alias, new_name, new_category).

    Only open records and those that need clarification can be reviewed; an action that lacks
    what it needs, or names a catalogue item that isn't there, is an error and changes nothing.
    """
    a = actions.join(queue.select("record_id", F.col("status").alias("old_status")), "record_id", "left")
    a = a.join(catalog.select(F.col("id").alias("target_id"), F.lit(True).alias("_there")), "target_id", "left")
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    to_target = c("action").isin("approve_to_existing", "approve_with_new_synonym")
    error = (
        F.when(c("old_status").isNull(), REVIEW_ERRORS["no_record"])
        .when(~c("old_status").isin("open", "needs_clarification"), REVIEW_ERRORS["closed"])
        .when(to_target & c("target_id").isNull(), REVIEW_ERRORS["no_target"])
        .when(to_target & c("_there").isNull(), REVIEW_ERRORS["target_missing"])
        .when((c("action") == "approve_with_new_synonym") & blank(c("synonym")), REVIEW_ERRORS["no_synonym"])
        .when((c("action") == "create_new_service") & (blank(c("new_name")) | blank(c("new_category"))), REVIEW_ERRORS["no_name"])
        .when(~F.coalesce(c("action").isin("approve_to_existing", "approve_with_new_synonym", "create_new_service", "reject", "needs_clarification", "ignore"), F.lit(False)), REVIEW_ERRORS["unknown"])
    )
    done = F.when(c("action") == "reject", "rejected").when(c("action") == "ignore", "ignored").when(c("action") == "needs_clarification", "needs_clarification").otherwise("approved")
    note = F.coalesce("note", F.when(c("action") == "reject", "Rejected").when(c("action") == "ignore", "Ignored"))
    fine = c("error").isNull()
    return a.withColumn("error", error).select(
        "record_id",
        "action",
        F.when(fine, done).otherwise("error").alias("new_status"),
        "error",
        F.when(fine, note).alias("note"),
        F.when(fine & to_target, c("target_id")).alias("link_to"),
        F.when(fine & (c("action") == "approve_with_new_synonym"), normalize_name("synonym")).alias("new_alias"),
        F.when(fine & (c("action") == "create_new_service"), F.trim("new_name")).alias("new_name"),
        F.when(fine & (c("action") == "create_new_service"), F.trim("new_category")).alias("new_category"),
    )


def evaluate_alerts(alerts: DataFrame, prices: DataFrame) -> DataFrame:
    """Active alerts with the current price they look at (the lowest price_id that fits) and whether they fire."""
    a, p = alerts.where("is_active").alias("a"), prices.alias("p")
    fits = (
        (F.col("a.normalized_service_id") == F.col("p.normalized_service_id"))
        & (F.col("a.clinic_id").isNull() | (F.col("a.clinic_id") == F.col("p.clinic_id")))
        & (F.col("a.branch_id").isNull() | (F.col("a.branch_id") == F.col("p.branch_id")))
    )
    found = a.join(p, fits, "left").groupBy("alert_id", "kind", "threshold").agg(F.min_by("p.price", "p.price_id").alias("price"))
    return found.withColumn("fires", F.coalesce(alert_fires("kind", "threshold", "price"), F.lit(False)))


def alert_counts(alerts: DataFrame, today: Column) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("last_triggered_at").cast("date") == today).alias("triggered_today"))


def evaluate_schedule(sources: DataFrame, runs: DataFrame, now: Column, most_jitter: int = 30) -> DataFrame:
    """source_id, should_run, reason, next_run_at: live and enabled sources run when their interval since the last success has passed."""
    last = runs.where("status = 'success'").groupBy("source_id").agg(F.max("finished_at").alias("last_success"))
    c = F.col
    due = next_run("last_success", frequency_hours("priority"), jitter_minutes("source_id", most_jitter))
    s = sources.join(last, "source_id", "left")
    able = (c("mode") == "live") & c("enabled")
    reason = F.when(c("mode") != "live", F.concat(F.lit("Source mode is "), c("mode"), F.lit(", not live"))).when(~c("enabled"), "Source disabled").when(c("last_success").isNull(), "No previous successful run").when(now >= due, "Scheduled interval elapsed").otherwise("Not due yet")
    return s.select("source_id", (able & (c("last_success").isNull() | (now >= due))).alias("should_run"), reason.alias("reason"), F.when(able, F.coalesce(due, now)).alias("next_run_at"))


def scheduler_status(evaluated: DataFrame, runs: DataFrame) -> DataFrame:
    seen = evaluated.select("should_run", "next_run_at", F.lit(None).cast("timestamp").alias("finished_at"), F.lit(True).alias("source"))
    ran = runs.select(F.lit(False).alias("should_run"), F.lit(None).cast("timestamp").alias("next_run_at"), "finished_at", F.lit(False).alias("source"))
    return seen.unionByName(ran).agg(F.count_if("source").alias("sources"), F.count_if("should_run").alias("due"), F.min("next_run_at").alias("next_run_at"), F.max("finished_at").alias("last_finished_at"))


def run_log(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Runs with their errors counted by stage; the counter is the number of error rows."""
    by_stage = errors.groupBy("run_id", "stage").agg(F.count("*").alias("n"))
    packed = by_stage.groupBy("run_id").agg(F.sum("n").alias("error_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("errors_by_stage"))
    return runs.join(packed, "run_id", "left").withColumn("error_count", F.coalesce("error_count", F.lit(0)))


def enrich(clinics: DataFrame, offered: DataFrame, fields: list[str], key: str = "clinic_id") -> DataFrame:
    """Clinics with empty fields filled; ``filled`` and ``conflicts`` list the fields."""
    o = offered.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = clinics.join(o, key, "left")
    act = {f: enrich_action(f, f"_{f}") for f in fields}
    listed = lambda what: F.array_compact(F.array(*[F.when(act[f] == what, F.lit(f)) for f in fields]))
    j = j.withColumn("filled", listed("fill")).withColumn("conflicts", listed("conflict"))
    return j.select(key, *[F.when(F.array_contains("filled", f), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], "filled", "conflicts")


def dq_report(facts: DataFrame) -> DataFrame:
    """(check, passed, actual, expected) from rows (check, actual, least, most); a null bound doesn't bind."""
    passed = F.coalesce(F.col("actual") >= F.col("least"), F.lit(True)) & F.coalesce(F.col("actual") <= F.col("most"), F.lit(True))
    expected = F.concat_ws(" and ", F.when(F.col("least").isNotNull(), F.concat(F.lit(">= "), F.col("least").cast("string"))), F.when(F.col("most").isNotNull(), F.concat(F.lit("<= "), F.col("most").cast("string"))))
    return facts.select("check", passed.alias("passed"), "actual", expected.alias("expected"))


def text_report(report: DataFrame) -> str:
    """The checks as lines, and whether all passed; the report has one row per check."""
    rows = report.orderBy("check").collect()
    lines = [f"[{'PASS' if r['passed'] else 'FAIL'}] {r['check']}: {r['actual']} ({r['expected']})" for r in rows]
    return "\n".join([*lines, "READY" if all(r["passed"] for r in rows) else "NOT READY"])


def last_of(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def queue_page(queue: DataFrame, services: DataFrame, status: str | None = None, source: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the review queue with service names, latest first; records without a service stay."""
    rows = queue
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.join(services.select("service_id", "service_name"), "service_id", "left").orderBy(F.desc_nulls_last("last_seen_at"), "record_id").offset(offset).limit(limit)


def city_counts(branches: DataFrame) -> DataFrame:
    """Active branches by city, most first."""
    return branches.where("branch_active").groupBy("city").agg(F.count("*").alias("branch_count")).orderBy(F.desc("branch_count"), "city")
