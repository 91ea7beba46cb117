"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession


def session(name: str = "tariffmill", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it; a private one only for a ``local[...]`` master that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tariffmill-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


#: Fixed value: Spark's setting by which shuffle files are removed once the job that made them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_users: dict[int, tuple[int, str | None]] = {}
_lock = Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs within leave no shuffle files behind: these else stay until the driver collects its garbage, which may be after a run of many jobs has filled the disks."""
    at = id(spark._jsparkSession)
    with _lock:  # several runs may share a session: the first one sets, the last one sets back
        users, before = _users.get(at, (0, spark.conf.get(CLEANUP, None)))
        _users[at] = users + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            users, before = _users.pop(at)
            if users > 1:
                _users[at] = users - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)
