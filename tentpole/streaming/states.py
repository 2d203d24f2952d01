"""Price history as keyed state: a stream of runs, a state for each key, and a timer that ends it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tentpole.operators.state import KEPT_DAYS

HISTORY = "key string, first string, since date, current string, stamp date, gone boolean"
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


class PriceState(StatefulProcessor):
    """First price and its day, current price and the day of the last run that had one; forgotten ``KEPT_DAYS`` days after that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", "first string, since date, current string, stamp date")

    @staticmethod
    def _end(stamp: date) -> int:
        """The first moment of the first day on which a run forgets the key."""
        return _millis(stamp + timedelta(KEPT_DAYS + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        was = self.history.get() if self.history.exists() else None
        if was is not None:
            was = tuple(was)
            # A run after the key's end has passed already: its timer is due, but rows come before timers.
            if timerValues.getCurrentWatermarkInMs() >= self._end(was[3]):
                was = None
        last: dict[date, tuple] = {}
        for r in rows:
            if r.price is not None and r.price != "":
                last[r.stamp] = max(last.get(r.stamp, (r.seq, r.price)), (r.seq, r.price))
        if not last:
            return
        before = was
        for stamp in sorted(last):
            price = last[stamp][1]
            was = (price, stamp, price, stamp) if was is None else (was[0], was[1], price, max(stamp, was[3]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(self._end(was[3]))
        if was != before:
            self.history.update(was)
            yield Row(key=key[0], first=was[0], since=was[1], current=was[2], stamp=was[3], gone=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        first, since, current, stamp = tuple(self.history.get())
        self.history.clear()
        yield Row(key=key[0], first=first, since=since, current=current, stamp=stamp, gone=True)

    def close(self) -> None:
        pass


def price_updates(stream: DataFrame) -> DataFrame:
    """What changes in the history with each run of a stream (``key``, ``price``, ``seq``, ``stamp``: the run's day): rows of :data:`HISTORY`.

    A row with ``gone`` says that a key is forgotten, once runs are more than
    ``KEPT_DAYS`` days past its last price. State is a few values a key, spread
    by key, and comes back from the checkpoint after a stop. A run should come
    in one batch (a file for each and ``maxFilesPerTrigger`` 1); of rows of one
    key and run that with the greatest ``seq`` counts, then the greatest price
    text; rows without a price, and runs older than one seen before, count for
    nothing. The session needs the state store :data:`STORE`.
    """
    timed = stream.withColumn("at", F.to_timestamp("stamp")).withWatermark("at", "0 seconds")
    return timed.groupBy("key").transformWithState(PriceState(), HISTORY, "append", "EventTime")


def history_of(updates: DataFrame, today: date) -> DataFrame:
    """The history after the run of ``today`` from all updates so far, as of :func:`tentpole.operators.state.price_history`."""
    last = updates.groupBy("key").agg(F.max_by(F.struct("first", "since", "current", "stamp", "gone"), F.struct("stamp", "gone")).alias("x"))
    return last.select("key", "x.*").where(~F.col("gone") & (F.datediff(F.lit(today), "stamp") <= KEPT_DAYS)).drop("gone")
