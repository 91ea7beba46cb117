"""Current prices, change status and history as functions of the ordered observation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import batch_status

KEY = ("clinic_id", "branch_id", "service_id", "currency")


def with_change(observations: DataFrame, order: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """Observations with old_price and status: created, updated or unchanged against the one before in ``order``."""
    old = F.lag("price").over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    status = F.when(first, "created").when(old.eqNullSafe(F.col("price")), "unchanged").otherwise("updated")
    return observations.withColumn("old_price", old).withColumn("status", status)


def history(changes: DataFrame) -> DataFrame:
    return changes.where("status <> 'unchanged'")


def observation_log(changes: DataFrame) -> DataFrame:
    return changes.withColumn("change_detected", F.col("status") != "unchanged")


def latest(observations: DataFrame, order: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """The last observation of each key.  Partly aggregated before the shuffle: one row per key and task moves, however often a key repeats."""
    rest = [c for c in observations.columns if c not in key and c not in order]
    return observations.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*key, *[F.col("_last")[c].alias(c) for c in (*order, *rest)])


def merge_current(snapshot: DataFrame, incoming: DataFrame, order: list[str], key: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, changes) of a batch applied to a snapshot with the same columns.

    Within the batch rows count in ``order``; a key's stored row comes before them all, whatever
    its time, as each import overwrites what is there.
    """
    columns = incoming.columns
    both = snapshot.select(*columns).withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    changes = with_change(both, ["_new", *order], key).where("_new = 1").drop("_new")
    return latest(both, ["_new", *order], key).select(*columns), changes


def with_stored(incoming: DataFrame, stored: DataFrame, order: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """Incoming rows with old_price and status, as ``merge_current`` has them, and ``sets_current``: whether a row is the new state of its key.

    That is the last of a key, if it differs from what is stored.  Rows are moved once, to their key.
    """
    rest = [c for c in stored.columns if c not in key]
    in_order = Window.partitionBy(*key).orderBy(*order, *[c for c in rest if c not in order])  # rows of equal order count as ``latest`` has them
    rows = incoming.join(stored.select(*key, F.struct(*rest).alias("_held")), list(key), "left")
    first, last = F.row_number().over(in_order) == 1, F.lead(F.lit(True)).over(in_order).isNull()
    rows = rows.withColumns({"_first": first, "_last": last, "_before": F.lag("price").over(in_order)})
    old = F.when(F.col("_first"), F.col("_held.price")).otherwise(F.col("_before"))
    made = F.col("_first") & F.col("_held").isNull()
    same = F.col("_held").isNotNull()
    for c in rest:
        same &= F.col(f"_held.{c}").eqNullSafe(F.col(c))
    status = F.when(made, "created").when(old.eqNullSafe(F.col("price")), "unchanged").otherwise("updated")
    return rows.select(*incoming.columns, old.alias("old_price"), status.alias("status"), (F.col("_last") & ~same).alias("sets_current"))


def batch_log(changes: DataFrame, rejects: DataFrame) -> DataFrame:
    """Counters and status by batch; a batch of rejects only has status failed."""
    counted = changes.groupBy("batch_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("created", "updated", "unchanged")])
    failed = rejects.groupBy("batch_id").agg(F.count("*").alias("error_count"))
    out = counted.join(failed, "batch_id", "full").na.fill(0)
    imported = F.col("created_count") + F.col("updated_count") + F.col("unchanged_count")
    return out.withColumn("status", batch_status(imported, F.col("error_count")))


def carry_forward(c: Column | str, partition: list[str], order: list[str]) -> Column:
    """The last value that isn't null up to and including this row."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
