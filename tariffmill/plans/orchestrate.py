"""Running sources apart from each other: one that fails doesn't stop the rest."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

RUNS = "run_id string, source_id string, status string, started_at timestamp, finished_at timestamp, row_count long, error_code string, error_message string"


def run_sources(spark: SparkSession, jobs: dict[str, Callable[[], int]], run_id: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> DataFrame:
    """The log of one run: each source's job, which returns how many rows it wrote, in order of their names."""
    log = []
    for source in sorted(jobs):
        began = clock()
        try:
            n, status, code, message = jobs[source](), "success", None, None
        except Exception as e:  # noqa: BLE001  the failure becomes the source's own log entry
            n, status, code, message = 0, "failed", "ORCHESTRATION_ERROR", f"{type(e).__name__}: {e}"[:1000]
        log.append((f"{run_id}:{source}", source, status, began, clock(), n, code, message))
    return spark.createDataFrame(log, RUNS)
