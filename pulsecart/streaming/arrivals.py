"""Late join by time of arrival, with a lifetime of each side that goes from its last arrival.

The interval join of :mod:`pulsecart.streaming.sales` pairs what arrived no further apart than the
tolerance. Here each side is remembered instead:

- An order is remembered for ``keep`` from its arrival; a later delivery replaces it and starts anew.
- A detail that meets a remembered order is paired at once and not remembered. Any other joins the set of
  waiting details of its order, and the whole set is then remembered for ``keep`` from that arrival on.
- An order that arrives is paired with all details that wait for it. They go on waiting, as the order may
  be delivered again.

So a detail may wait much longer than ``keep``, as long as others of its order keep coming.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsecart.functions import seconds_in
from pulsecart.schemas import JOIN_TOLERANCE

_ORDER, _DETAIL = 0, 1
_ORDER_FIELDS = ["order_status", "create_time", "user_id"]


def _late_join(orders: list[str], details: list[str], keep: int, wall_clock: bool) -> StatefulProcessor:
    """``orders`` and ``details`` name the text columns of either side; ``keep`` is in microseconds."""

    pair = Row("o_id", *[f"o_{c}" for c in orders], "o_arrived", *[f"d_{c}" for c in details], "d_arrived")

    class LateJoin(StatefulProcessor):
        """State of one order: its last delivery, the details that wait, and until when each is remembered.

        State is read once and written once for a batch; the waiting details are read only when an order
        comes for them, and otherwise added to.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            text = lambda names: [T.StructField(n, T.StringType()) for n in names]
            number = lambda name: T.StructField(name, T.LongType())
            self.handle = handle
            self.order = handle.getValueState("order", T.StructType([*text(orders), number("arrived"), number("until")]))
            self.waiting = handle.getListState("waiting", T.StructType([*text(details), number("arrived")]))
            self.until = handle.getValueState("until", T.StructType([number("until")]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000 if wall_clock else None
            ordered = sorted(rows, key=lambda r: (r["arrived"], r["side"]))
            order = self.order.get()
            until = self.until.get()
            until = until[0] if until is not None else None
            stored, come = until is not None, []  # waiting details in the store, and of this batch
            forget = renewed = False
            for row in ordered:
                at = row["arrived"] if now is None else now
                if until is not None and at >= until:
                    until, come, forget, stored = None, [], stored or forget, False
                if order is not None and at >= order[-1]:
                    order, renewed = None, False
                if row["side"] == _ORDER:
                    order, renewed = (*[row[f"o_{c}"] for c in orders], row["arrived"], at + keep), True
                    if until is not None:
                        seen = set()
                        for detail in [*(tuple(d) for d in self.waiting.get()), *come] if stored else come:
                            if detail[:-1] not in seen:  # a detail delivered twice waits once
                                seen.add(detail[:-1])
                                yield pair(key[0], *order[:-1], *detail)
                elif order is not None:
                    yield pair(key[0], *order[:-1], *[row[f"d_{c}"] for c in details], row["arrived"])
                else:
                    come.append((*[row[f"d_{c}"] for c in details], row["arrived"]))
                    until = at + keep
            if renewed:
                self.order.update(order)
            if come:
                (self.waiting.appendList if stored else self.waiting.put)(list({d[:-1]: d for d in reversed(come)}.values()))
                self.until.update((until,))
            elif forget:
                self.waiting.clear()
                self.until.clear()
            last = max(order[-1] if order is not None and renewed else 0, until if come else 0)
            if last:
                self.handle.registerTimer(-(-last // 1000))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = expiredTimerInfo.getExpiryTimeInMs() * 1000
            order, until = self.order.get(), self.until.get()
            if order is not None and order[-1] <= now:
                self.order.clear()
            if until is not None and until[0] <= now:
                self.waiting.clear()
                self.until.clear()
            return iter([])

        def close(self) -> None:
            pass

    return LateJoin()


def arrival_pairs(
    orders: DataFrame, details: DataFrame, keep: str = JOIN_TOLERANCE, clock: str = "processing"
) -> DataFrame:
    """Order and detail pairs as ``o_`` and ``d_`` columns, joined by the rules above.

    ``clock`` says what counts as arrival: ``processing`` is the time of the micro-batch, as for a live
    stream (one that is stopped, as timers keep it going when its input ends); ``transport`` is the ``ingest_time`` of the rows, so a replay of the same rows gives the same
    pairs, however they fall into batches, as long as batches follow each other in that time. State leaves
    with timers of the same clock. Rows of one order in a batch are taken by ``ingest_time``, the order
    first if equal. They and its waiting details are worked on by one task, as the lifetime of the set is
    one. Rows without an order id pair with nothing.
    """
    if clock not in ("processing", "transport"):
        raise ValueError("clock must be processing or transport")
    names = [c for c in details.columns if c not in ("order_id", "ingest_time")]
    kinds = {c: details.schema[c].dataType for c in names}

    def side(rows: DataFrame, number: int, key: str, own: str, columns: list[str]) -> DataFrame:
        empty = {f"o_{c}": F.lit(None).cast("string") for c in _ORDER_FIELDS} | {f"d_{c}": F.lit(None).cast("string") for c in names}
        filled = empty | {f"{own}{c}": F.col(c).cast("string") for c in columns}
        return rows.where(F.col(key).isNotNull()).select(
            F.col(key).alias("order_id"), F.lit(number).alias("side"), F.unix_micros("ingest_time").alias("arrived"),
            F.col("ingest_time").alias("event_time"), *[value.alias(name) for name, value in filled.items()],
        )

    rows = side(orders, _ORDER, "id", "o_", _ORDER_FIELDS).unionByName(side(details, _DETAIL, "order_id", "d_", names))
    rows = rows.withWatermark("event_time", keep)
    text = lambda name: T.StructField(name, T.StringType())
    out = T.StructType(
        [text("o_id"), *[text(f"o_{c}") for c in _ORDER_FIELDS], T.StructField("o_arrived", T.LongType())]
        + [*[text(f"d_{c}") for c in names], T.StructField("d_arrived", T.LongType())]
    )
    pairs = rows.groupBy("order_id").transformWithState(
        statefulProcessor=_late_join(_ORDER_FIELDS, names, seconds_in(keep) * 1_000_000, clock == "processing"),
        outputStructType=out,
        outputMode="Append",
        timeMode="ProcessingTime" if clock == "processing" else "EventTime",
    )
    return pairs.select(
        "o_id", *[f"o_{c}" for c in _ORDER_FIELDS], F.timestamp_micros("o_arrived").alias("o_ingest_time"),
        *[F.col(f"d_{c}").cast(kinds[c]).alias(f"d_{c}") for c in names], F.col("o_id").alias("d_order_id"),
        F.timestamp_micros("d_arrived").alias("d_ingest_time"),
    )
