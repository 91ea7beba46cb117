"""Price alerts kept beside an imported model: created, listed, deactivated, and evaluated as prices change.

An evaluation looks at the alerts of services that runs since the last evaluation have observed, and at alerts never looked at;
the others' outcome can't have changed.  Each alert keeps the price it saw, whether it fired and when it last did; each firing
is one row of the ``triggers`` log, and an evaluation of a version is published once, however often it is asked for.

A service whose link to the catalogue changes is met under its new link only: after re-linking evaluate with ``full=True``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lake import Conflict, Lake, Run
from ..operators.workflow import evaluate_alerts
from .ingest import RETRIES, stored

TABLE = ("alert_id long, kind string, threshold decimal(12,2), normalized_service_id long, clinic_id long, branch_id long, is_active boolean, created_at timestamp, last_triggered_at timestamp, price decimal(12,2), fires boolean, evaluated long", ["alert_id"], ["alert_id"])
#: What an alert can watch for.
KINDS = ("below", "above", "changed")


def alerts_of(lake: Lake, active_only: bool = True) -> DataFrame:
    rows = lake.state("alerts", *TABLE)
    return rows.where("is_active") if active_only else rows


def errors(alerts: DataFrame) -> DataFrame:
    """alert_id and error of alerts that can't be created: an unknown kind, no service, no price or a negative one."""
    error = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(F.col("normalized_service_id").isNull(), "no service")
        .when(F.col("threshold").isNull() | (F.col("threshold") < 0), "price must be non-negative")
    )
    return alerts.select("alert_id", error.alias("error")).where("error is not null")


def published(lake: Lake, run_id: str, work: Callable[[Run], None]) -> int:
    """Do the work as this run, again if another run comes between; nothing if the id was published before."""
    for turn in range(RETRIES + 1):
        run = lake.begin(run_id)
        if version := lake.applied(run_id):
            return version
        try:
            work(run)
            return run.publish()
        except Conflict:
            if turn == RETRIES:
                raise
            time.sleep(min(0.05 * 2**turn, 2.0))
    raise AssertionError("unreachable")


def create(lake: Lake, alerts: DataFrame, now: Column, run_id: str | None = None) -> int:
    """Add alerts (alert_id, kind, threshold, normalized_service_id, clinic_id, branch_id) that have no ``errors``; one that is there under its id stays as it is."""
    good = alerts.join(errors(alerts).select("alert_id"), "alert_id", "left_anti").dropDuplicates(["alert_id"])

    def work(run: Run) -> None:
        run.touch({"alerts": (good, ["alert_id"])})
        new = good.join(run.old("alerts", *TABLE).select("alert_id"), "alert_id", "left_anti")
        none = {"last_triggered_at": "timestamp", "price": "decimal(12,2)", "fires": "boolean", "evaluated": "long"}
        told = new.select("alert_id", "kind", F.col("threshold").cast("decimal(12,2)").alias("threshold"), *[F.col(c).cast("long").alias(c) for c in ("normalized_service_id", "clinic_id", "branch_id")])
        run.put("alerts", *TABLE, told.withColumns({"is_active": F.lit(True), "created_at": now.cast("timestamp"), **{c: F.lit(None).cast(t) for c, t in none.items()}}))

    return published(lake, run_id or uuid.uuid4().hex, work)


def deactivate(lake: Lake, ids: DataFrame, run_id: str | None = None) -> int:
    """Switch off the alerts of these ids (alert_id); unknown ones are passed over."""

    def work(run: Run) -> None:
        run.touch({"alerts": (ids, ["alert_id"])})
        found = run.old("alerts", *TABLE).join(ids.select("alert_id").distinct(), "alert_id", "left_semi")
        run.put("alerts", *TABLE, found.withColumn("is_active", F.lit(False)))

    return published(lake, run_id or uuid.uuid4().hex, work)


def prices_of(lake: Lake, head: dict, services: DataFrame | None = None) -> DataFrame:
    """Current prices with the catalogue service they stand for; only of ``services`` (normalized_service_id) if given."""
    linked = stored(lake, "services", head).where("normalized_id is not null").select("service_id", F.col("normalized_id").alias("normalized_service_id"))
    if services is not None:
        linked = linked.join(services, "normalized_service_id", "left_semi")
    place = F.struct("clinic_id", "branch_id", "service_id", "currency").alias("price_id")
    return stored(lake, "current", head).join(linked, "service_id").select(place, "normalized_service_id", "clinic_id", "branch_id", "price")


def evaluate(lake: Lake, now: Column, full: bool = False) -> int:
    """Bring alerts up to date with the newest version; returns the version of the evaluation."""
    head = lake.head()
    last = 0 if full else head["facts"].get("alerts_evaluated", 0)
    own = f"alerts:{head['version']}{':full' if full else ''}"
    if not full and last >= head["version"]:
        return head["version"]

    def work(run: Run) -> None:
        active = lake.state("alerts", *TABLE, run.head).where("is_active")
        seen = lake.log("observations").where((F.col("version") > last) & (F.col("version") <= run.head["version"]) & F.col("normalized_id").isNotNull())
        changed = seen.select(F.col("normalized_id").alias("normalized_service_id")).distinct()
        due = active.join(changed, "normalized_service_id", "left_semi").unionByName(active.join(changed, "normalized_service_id", "left_anti").where(F.lit(full) | F.col("evaluated").isNull()))
        due = run.append("_due", due)
        run.touch({"alerts": (due, ["alert_id"])})
        told = evaluate_alerts(due, prices_of(lake, run.head, due.select("normalized_service_id").distinct())).select("alert_id", F.col("price").alias("_price"), F.col("fires").alias("_fires"))
        made = run.append("_told", due.join(told, "alert_id"))
        run.append("triggers", made.where("_fires").select("alert_id", "kind", "threshold", F.col("_price").alias("price"), now.cast("timestamp").alias("at")))
        fresh = {"price": F.col("_price"), "fires": F.col("_fires"), "evaluated": F.lit(run.head["version"]).cast("long"), "last_triggered_at": F.when(F.col("_fires"), now.cast("timestamp")).otherwise(F.col("last_triggered_at"))}
        run.put("alerts", *TABLE, made.withColumns(fresh))
        run.facts["alerts_evaluated"] = run.head["version"] + 1 - run.head["facts"].get("alerts_evaluated", 0)

    version = published(lake, own, work)
    return version
