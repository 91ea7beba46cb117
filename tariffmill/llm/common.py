"""Helpers shared by the training-data operators: durable intermediate tables and input shaping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset a private folder serves, and only for a ``local[...]`` master, where driver
    and tasks are one process: elsewhere a machine-local folder would be invisible to executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tariffmill-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most so many rows between the JVM and Python for what runs inside: rows may be long texts or sets, and both sides hold a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def measured_broadcasts(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Inside, joins broadcast a side only if its shuffled rows were at most so many bytes, or if it is hinted.

    Planned ahead, joins go by the sizes of files: a few MB of compressed ids become a table of many times that on the driver.
    """
    by_files, by_rows = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (by_files, by_rows)}
    if str(before[by_files]).startswith("-"):  # the session broadcasts nothing by size
        most = -1
    spark.conf.set(by_files, "-1")
    spark.conf.set(by_rows, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, name: str, rows: int = 2000) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage: lost executors cost only a re-read, and nothing upstream runs twice.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove what ``materialise`` wrote for these tables, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, like these, that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so extra columns with clashing names cannot interfere."""
    return df.select(*[F.col(c) for c in columns])
