"""Review of unmatched services, applied to an imported model and its stored catalogue.

The outcome of each action (see ``operators.workflow.review``) is written back in one run: the queue's states, the services that
are linked now (and found by their new key), the catalogue's new names and aliases, and a row of the ``reviews`` log for each action,
errors included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..operators.lake import Lake, Run
from ..operators.match import relink
from ..operators.upsert import merge_aliases
from ..operators.workflow import review
from .alerts import published
from .ingest import KEYS, TABLES

CATALOG = ("id long, category string, name string, aliases array<string>", ["id"], ["id"])


def catalog_of(lake: Lake) -> DataFrame:
    return lake.state("catalog", *CATALOG)


def seed(lake: Lake, catalog: DataFrame, run_id: str | None = None) -> int:
    """Put catalogue items (id, category, name, aliases): names and categories win over stored ones, aliases are merged."""

    def work(run: Run) -> None:
        run.touch({"catalog": (catalog, ["id"])})
        old = run.old("catalog", *CATALOG).select("id", F.col("aliases").alias("_old"))
        run.put("catalog", *CATALOG, catalog.join(old, "id", "left").withColumn("aliases", merge_aliases("aliases", "_old")))

    return published(lake, run_id or uuid.uuid4().hex, work)


def _link(run: Run, links: DataFrame) -> None:
    """Services (service_id, link) stand for another catalogue item from now on, and are found by it."""
    old = run.old("services", *TABLES["services"]).join(links, "service_id")
    fresh = old.withColumns({"normalized_id": F.col("link"), "match_status": F.lit("matched"), "match_confidence": F.lit(1).cast("decimal(4,3)"), "_fallback": F.xxhash64("link", "normalized_name")})
    moved = fresh.where("fallback <> _fallback")
    gone = moved.select("fallback", F.col("service_id").alias("id"), "made", F.lit(False).alias("live"))
    new = moved.select(F.col("_fallback").alias("fallback"), F.col("service_id").alias("id"), "made", F.lit(True).alias("live"))
    keys = gone.unionByName(new)
    run.touch({"services_keys": (keys, ["fallback"])})
    run.put("services_keys", *KEYS, keys)
    run.put("services", *TABLES["services"], fresh.withColumn("fallback", F.col("_fallback")))


def apply_review(lake: Lake, actions: DataFrame, run_id: str | None = None) -> int:
    """Apply actions (record_id, a service's id; action, target_id, synonym, new_name, new_category, note), one for a record; of several the least counts."""
    one = actions.groupBy("record_id").agg(F.min(F.struct(*[c for c in actions.columns if c != "record_id"])).alias("_a")).select("record_id", "_a.*")

    def work(run: Run) -> None:
        asked = run.append("_actions", one)
        ids = asked.select(F.col("record_id").alias("service_id"))
        targets = asked.select(F.coalesce("target_id", F.lit(0)).alias("id")).unionByName(asked.where("new_name is not null").select(_new_id(run).alias("id")))
        run.touch({"queue": (ids, ["service_id"]), "services": (ids, ["service_id"]), "catalog": (targets, ["id"])})
        queue = run.old("queue", *TABLES["queue"]).join(ids, "service_id", "left_semi")
        known = run.old("catalog", *CATALOG)
        told = run.append("reviews", review(queue.select(F.col("service_id").alias("record_id"), "status"), asked, known).withColumn("new_id", F.when(F.col("new_name").isNotNull(), _new_id(run))))
        fine = told.where("error is null")
        run.put("queue", *TABLES["queue"], queue.join(fine.select(F.col("record_id").alias("service_id"), "new_status"), "service_id").withColumn("status", F.col("new_status")))
        link = F.coalesce("link_to", "new_id")
        _link(run, fine.where(link.isNotNull()).select(F.col("record_id").alias("service_id"), link.alias("link")))
        aliases = fine.where("new_alias is not null").groupBy(F.col("link_to").alias("id")).agg(F.collect_set("new_alias").alias("_new"))  # of one item, as many as were reviewed at once
        longer = known.join(aliases, "id").withColumn("aliases", merge_aliases("aliases", "_new")).select(*known.columns)
        made = fine.where("new_id is not null").groupBy(F.col("new_id").alias("id")).agg(F.min(F.struct("new_category", "new_name")).alias("_n"))
        added = made.join(known, "id", "left_anti").select("id", F.col("_n.new_category").alias("category"), F.col("_n.new_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
        run.put("catalog", *CATALOG, longer.unionByName(added))

    version = published(lake, run_id or uuid.uuid4().hex, work)
    return version


def _new_id(run: Run) -> Column:
    """The id of a catalogue item made by review: equal names of one category are one item."""
    return -F.abs(F.xxhash64(normalize_name("new_name"), normalize_name("new_category")))


def relink_stored(lake: Lake, run_id: str | None = None) -> int:
    """Link stored services to the catalogue's items whose name or alias is theirs; those that are linked so already stay untouched."""

    def work(run: Run) -> None:
        services = lake.state("services", *TABLES["services"], run.head)
        found = relink(services, lake.state("catalog", *CATALOG, run.head)).withColumnRenamed("normalized_service_id", "link")
        changed = services.select("service_id", "normalized_id").join(found, "service_id").where(~F.col("normalized_id").eqNullSafe(F.col("link"))).select("service_id", "link")
        changed = run.append("_relinked", changed)
        run.touch({"services": (changed, ["service_id"])})
        _link(run, changed)

    return published(lake, run_id or uuid.uuid4().hex, work)
