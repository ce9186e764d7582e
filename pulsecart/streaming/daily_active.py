"""Daily active devices on a stream, in five modes that differ in when and which row wins.

========================  =======================  ==============================================
mode                      row appears              winner
========================  =======================  ==============================================
:func:`on_arrival`        at once                  any row of the first batch
:func:`at_day_end`        when the day is closed   earliest row of the day (equals the batch)
:func:`earliest_so_far`   at once                  the same; later batches may replace a row
:func:`first_batch`       at once                  earliest row of the first batch, Python state
:func:`first_batch_sink`  at once                  earliest row of the first batch, keyed table
========================  =======================  ==============================================
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsecart.functions import seconds_in
from pulsecart.operators.activity import DEVICE_DAY, newly_active
from pulsecart.schemas import DAILY_ACTIVE_COLUMNS
from pulsecart.sinks.keyed_table import KeyedTable

DAILY_ACTIVE = ", ".join(f"{c} {'bigint' if c == 'ts' else 'string'}" for c in DAILY_ACTIVE_COLUMNS)
SEEN_FOR = "24 hours"
SEEN_BUCKETS = 64
SEEN_TOGETHER = 10_000


def on_arrival(startup: DataFrame, keep: str = SEEN_FOR, salts: int = 1) -> DataFrame:
    """Pass the first row of each device and day that shows up; forget it after ``keep``.

    With ``salts`` above 1, the rows of each device are first thinned out in that many tasks. Use
    it when a single device can hold a large part of all rows.
    """
    rows = startup.withWatermark("event_time", keep)
    if salts > 1:
        salt = F.pmod(F.xxhash64(*DAILY_ACTIVE_COLUMNS), F.lit(salts))
        rows = rows.withColumn("salt", salt).dropDuplicatesWithinWatermark([*DEVICE_DAY, "salt"])
    return rows.dropDuplicatesWithinWatermark(DEVICE_DAY).select(*DAILY_ACTIVE_COLUMNS)


def at_day_end(startup: DataFrame, delay: str, tie: Sequence[str] = ()) -> DataFrame:
    """The earliest row of each device and day once the watermark passes the end of the day."""
    keys = ["mid", F.window("event_time", "1 day").alias("day")]
    payload = [c for c in DAILY_ACTIVE_COLUMNS if c not in ("mid", "ts")]
    row = (
        startup.withWatermark("event_time", delay)
        .groupBy(*keys)
        .agg(F.min(F.struct("ts", *tie, *payload)).alias("row"))
    )
    return row.select("mid", "row.*").select(*DAILY_ACTIVE_COLUMNS)


def earliest_so_far(startup: DataFrame, delay: str, tie: Sequence[str] = ()) -> DataFrame:
    """The earliest row yet of each device and day that a batch touches, for update mode into a keyed
    table: rows of the open day show up at once, and an earlier row replaces a later one."""
    payload = [c for c in DAILY_ACTIVE_COLUMNS if c not in ("mid", "ts")]
    day = F.window("event_time", "1 day").alias("day")
    row = (
        startup.withWatermark("event_time", delay)
        .groupBy("mid", day)
        .agg(F.min(F.struct("ts", *tie, *payload)).alias("row"))
    )
    return row.select("mid", "row.*").select(*DAILY_ACTIVE_COLUMNS)


def _first_batch_processor(columns: list[str], order: list[str], keep_ms: int, wall_clock: bool) -> StatefulProcessor:
    def firsts(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(order, kind="stable").drop_duplicates("mid")

    class FirstBatch(StatefulProcessor):
        """State of a day's devices in one bucket: until when each counts as seen. It is read and added to as a whole,
        and the devices of a batch are one entry (of ``SEEN_TOGETHER`` at most), so a device costs neither a call nor an
        entry of its own. A timer at the earliest end clears what has run out."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getListState("seen", "mids array<string>, untils array<bigint>")

        def held(self) -> list[tuple[str, int]]:
            return [device for mids, untils in self.seen.get() for device in zip(mids, untils)] if self.seen.exists() else []

        def entries(self, devices: list[tuple[str, int]]) -> list[tuple[list[str], list[int]]]:
            parts = (devices[i : i + SEEN_TOGETHER] for i in range(0, len(devices), SEEN_TOGETHER))
            return [([mid for mid, _ in part], [until for _, until in part]) for part in parts]

        def now(self, timerValues) -> int:
            return timerValues.getCurrentProcessingTimeInMs() if wall_clock else timerValues.getCurrentWatermarkInMs()

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = self.held()
            # By the wall clock a device is free when its time is up, by event time when its timer has fired.
            known = [h for h in held if not wall_clock or h[1] > self.now(timerValues)]
            mids = {mid for mid, _ in known}
            parts, size, merged = [], 0, 0
            for chunk in rows:
                part = firsts(chunk[[m not in mids for m in chunk["mid"]]])
                parts, size = [*parts, part], size + len(part)
                if size > 2 * merged + 10_000:
                    parts = [firsts(pd.concat(parts))]
                    size = merged = len(parts[0])
            best = firsts(pd.concat(parts))
            if best.empty:
                return
            since = best["ts"].astype("int64") if not wall_clock else [self.now(timerValues)] * len(best)
            new = [(mid, int(at) + keep_ms) for mid, at in zip(best["mid"], since)]
            if len(known) < len(held):
                self.seen.put(self.entries(known + new))
            else:
                self.seen.appendList(self.entries(new))
            self.handle.registerTimer(min(until for _, until in new))
            yield best[columns]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, fired = self.now(timerValues), expiredTimerInfo.getExpiryTimeInMs()
            held = self.held()
            left = [h for h in held if h[1] >= now and h[1] > fired]
            if not left:
                self.seen.clear()
            elif len(left) < len(held):
                self.seen.put(self.entries(left))
                self.handle.registerTimer(min(until for _, until in left))
            return iter([])

        def close(self) -> None:
            pass

    return FirstBatch()


def first_batch(
    startup: DataFrame,
    tie: Sequence[str] = (),
    keep: str = "48 hours",
    clock: str = "event",
    buckets: int = SEEN_BUCKETS,
) -> DataFrame:
    """The earliest row of the first batch in which a device shows up on a day.

    A device that was seen on a day is not passed again for ``keep``, even when an earlier row arrives later.
    With the ``event`` clock, ``keep`` counts from the row's own time and is also how late rows may be; with
    ``processing``, it counts from the batch, as a store with expiring keys does (for streams that are stopped:
    run over available data, such a stream does not end). Needs Python state, which
    :func:`seen_set` reads; :func:`first_batch_sink` gives the same rows from built-in operators.

    The devices of a day share ``buckets`` groups of state, fixed by the first checkpoint. A batch reads the groups of
    its devices: more buckets make a small batch cheaper and one of many devices dearer.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock must be event or processing")
    rows = startup.select(*DAILY_ACTIVE_COLUMNS, "event_time", *tie)
    if clock == "event":
        rows = rows.withWatermark("event_time", keep)
    order = ["ts", *tie] if tie else ["ts", *[c for c in DAILY_ACTIVE_COLUMNS if c != "ts"]]
    keep_ms = seconds_in(keep) * 1000
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("mid"), F.lit(buckets)).cast("int"))
    return rows.groupBy("logdate", "bucket").transformWithStateInPandas(
        statefulProcessor=_first_batch_processor(DAILY_ACTIVE_COLUMNS, order, keep_ms, clock == "processing"),
        outputStructType=T.StructType.fromDDL(DAILY_ACTIVE),
        outputMode="Append",
        timeMode="EventTime" if clock == "event" else "ProcessingTime",
    )


def seen_set(spark: SparkSession, checkpoint: str, as_of_ms: int | None = None) -> DataFrame:
    """Devices and days that a :func:`first_batch` stream holds as seen: ``mid``, ``logdate``, ``until`` (ms).

    Read from the state in the stream's checkpoint, as of its last finished batch, while it runs or later.
    ``as_of_ms`` leaves out what has expired by then.
    """
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    entries = state.select("key.logdate", F.col("list_element.mids").alias("mid"), F.col("list_element.untils").alias("until"))
    rows = entries.select("logdate", F.inline(F.arrays_zip("mid", "until"))).select("mid", "logdate", "until")
    return rows if as_of_ms is None else rows.where(F.col("until") > as_of_ms)


def daily_active_table(spark, path: str) -> KeyedTable:
    """The daily-active table: one row per device and day, stored by day."""
    return KeyedTable(spark, path, DAILY_ACTIVE, DEVICE_DAY, day_column="logdate")


def first_batch_sink(
    table: KeyedTable, writer: str, tie: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that adds devices not yet in the table, each with its first row.

    The table is its own seen set, so a device cannot be marked as seen without its row being
    stored. Of the table only the keys of the days in the batch are read.
    """

    def sink(startup: DataFrame, batch_id: int) -> None:
        startup = startup.persist()
        try:
            touched = [r[0] for r in startup.select("logdate").distinct().collect()]
            seen = table.written_keys(touched)
            table.write(newly_active(startup, seen, tie), writer, batch_id, unique=True)
        finally:
            startup.unpersist()

    return sink
