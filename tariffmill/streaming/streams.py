"""Streaming forms: incremental import, change detection by key, windowed aggregates.

Late data: windows drop rows behind their watermark in append mode; ``ordered_change_stream`` puts rows back in order and reports late ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.ingest import import_batch
from ..sources import schemas
from ..sources.payloads import service_rows
from ..operators.validate import root_errors


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.PAYLOAD).option("multiLine", True).json(path).withColumn("path", F.input_file_name()).withColumn("root_errors", root_errors())


def run_import(spark: SparkSession, path: str, folder: str, catalog: DataFrame | None = None) -> StreamingQuery:
    """Import what has arrived since the last run, then stop.

    A micro-batch's run id is made of the stream's id, which its checkpoint keeps, and the batch's number:
    a batch that was published before its checkpoint was written is replayed without effect.
    Payloads whose root is invalid are quarantined.
    """
    checkpoint = f"{folder}/_checkpoint"

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
            import_batch(service_rows(batch), folder, catalog, f"{stream}:{number}", batch)

    return payload_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PriceChange(StatefulProcessor):
    """The last price of a key; each row leaves with what it was before and how it changed.  Rows of one batch count in event order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        old = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, seq, price in zip(frame["ts"], frame["seq"], frame["price"]):
            out.append((key[0], ts, seq, price, old, "created" if old is None else "unchanged" if old == price else "updated"))
            old = price
        self.last.update((float(old),))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "price", "old_price", "status"])

    def close(self) -> None:
        pass


def change_stream(events: DataFrame) -> DataFrame:
    """(key, ts, seq, price) as a stream with old_price and status; needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=PriceChange(), outputStructType="key string, ts timestamp, seq long, price double, old_price double, status string", outputMode="Append", timeMode="None")


def _ms(times: pd.Series) -> pd.Series:
    return (times - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)


def _rows(frame: pd.DataFrame) -> list[tuple]:
    return [(t.to_pydatetime(), q, p) for t, q, p in zip(pd.to_datetime(frame["ts"]), frame["seq"].tolist(), frame["price"])]


class OrderedPriceChange(StatefulProcessor):
    """Price changes of a key in event order, whatever the order of arrival.

    Rows are held until event time is ``late`` ahead of them, then leave in order with what was before; rows that come later than
    that leave at once with the status ``late`` and change nothing.  Spark's own watermark is ``reach`` behind, so
    that it hands on late rows up to there.
    """

    def __init__(self, late: int, reach: int) -> None:
        self.ahead = 1000 * (reach - late)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price decimal(12,2)")
        self.held = handle.getListState("held", "ts timestamp, seq long, price decimal(12,2)")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            due = _ms(frame["ts"]) - self.ahead
            late = due <= seen
            if late.any():
                yield pd.DataFrame({"key": key[0], "ts": frame["ts"], "seq": frame["seq"], "price": frame["price"], "old_price": None, "status": "late"})[late]
            new = frame[~late]
            if len(new):
                self.held.appendList(_rows(new))
                for at in sorted(set(due[~late].tolist())):
                    self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.DataFrame(list(self.held.get()), columns=["ts", "seq", "price"])
        ready = _ms(pd.to_datetime(frame["ts"])) - self.ahead <= timerValues.getCurrentWatermarkInMs()
        if not ready.any():  # another timer of the same time has let them go
            return
        rest = frame[~ready]
        if len(rest):
            self.held.put(_rows(rest))
        else:
            self.held.clear()
        now = frame[ready].sort_values(["ts", "seq"], kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        price = now["price"].tolist()
        old = pd.Series([before, *price[:-1]], index=now.index, dtype=object)
        status = old.eq(now["price"]).map({True: "unchanged", False: "updated"}).where(old.notna(), "created")
        self.last.update((price[-1],))
        yield pd.DataFrame({"key": key[0], "ts": now["ts"], "seq": now["seq"], "price": now["price"], "old_price": old, "status": status})

    def close(self) -> None:
        pass


def ordered_change_stream(events: DataFrame, late: int = 600, reach: int = 86_400) -> DataFrame:
    """(key, ts, seq, price) as a stream in event order with old_price and status; needs the RocksDB state store.

    ``late`` and ``reach`` are seconds: rows up to ``late`` behind the newest event take their place, later ones are reported as ``late``, and
    only those more than ``reach`` behind are dropped (and counted by Spark's own metrics).
    """
    if not 0 <= late <= reach:
        raise ValueError("late must not be negative, and reach not less than it")
    rows = events.withColumn("price", F.col("price").cast("decimal(12,2)")).withWatermark("ts", f"{reach} seconds")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=OrderedPriceChange(late, reach), outputStructType="key string, ts timestamp, seq long, price decimal(12,2), old_price decimal(12,2), status string", outputMode="Append", timeMode="EventTime")


def once(events: DataFrame, keys: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and event type; works on batches and on streams."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
