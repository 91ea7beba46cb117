"""Quality of an imported data set: 14 checks of facts that the imports themselves have counted.

Each import observes its own writes (``lake.Run.observe``) and its marker keeps the counts, so a report reads markers only
and makes no pass over any table.  Freshness is told from the numbers of current prices by the day they were seen.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import FRESH_DAYS, STALE_DAYS
from ..operators.lake import Lake
from ..operators.workflow import dq_report

#: How many of each there have to be at least.
LEAST = {"source_count": 3, "service_price_count": 15, "normalized_catalog_count": 50, "parser_run_count": 3, "raw_snapshot_count": 3, "raw_row_count": 15, "price_history_count": 15, "price_observation_count": 15, "deduplication": 15}
#: What no price may lack.
NONE_MAY = ("missing_source_url", "missing_parsed_at")


def freshness_counts(facts: dict[str, int], now: date) -> dict[str, int]:
    """Current prices by state."""
    out = {"fresh": 0, "stale": 0, "expired": 0, "unknown": 0}
    for name, n in facts.items():
        if name.startswith("seen:"):
            day = name[5:]
            age = max((now - date.fromisoformat(day)).days, 0) if day else None
            out["unknown" if age is None else "fresh" if age <= FRESH_DAYS else "stale" if age <= STALE_DAYS else "expired"] += n
    return out


def facts_of(lake: Lake, catalog_count: int, now: date) -> list[tuple[str, int, int | None, int | None]]:
    """(check, actual, least, most) of all 14 checks."""
    head = lake.head()
    facts = head["facts"]
    told = {n: facts.get(n, 0) for n in (*LEAST, *NONE_MAY)} | {"normalized_catalog_count": catalog_count, "parser_run_count": head["version"], "deduplication": facts.get("services_count", 0)}
    rows = [(n, told[n], least, None) for n, least in LEAST.items()] + [(n, told[n], None, 0) for n in NONE_MAY]
    raw = facts.get("raw_row_count", 0)
    rows += [("raw_row_integrity", facts.get("raw_row_integrity", 0), raw, raw), ("unmatched_count", facts.get("unmatched_count", 0), None, None)]
    return [*rows, ("freshness_distribution", sum(freshness_counts(facts, now).values()), None, None)]


def report(spark: SparkSession, lake: Lake, catalog_count: int, now: date) -> DataFrame:
    """(check, passed, actual, expected)."""
    return dq_report(spark.createDataFrame(facts_of(lake, catalog_count, now), "check string, actual long, least long, most long"))


def summary(lake: Lake, catalog_count: int, now: date) -> dict:
    """The report as one record for JSON: the checks, how many passed, freshness, and the exit code of a command that runs it."""
    checks = [{"name": n, "passed": (least is None or x >= least) and (most is None or x <= most), "actual": x, "expected": most if least is None else least} for n, x, least, most in facts_of(lake, catalog_count, now)]
    passed = sum(c["passed"] for c in checks)
    return {"is_ready": passed == len(checks), "passed_count": passed, "failed_count": len(checks) - passed, "freshness_stats": freshness_counts(lake.head()["facts"], now), "checks": checks, "exit_code": int(passed < len(checks))}


def json_report(lake: Lake, catalog_count: int, now: date) -> str:
    return json.dumps(summary(lake, catalog_count, now), indent=2, ensure_ascii=False)
