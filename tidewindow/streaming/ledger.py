"""The ledger as a stream: sightings in, entries kept in state, changed entries out.

A day is folded when the watermark has passed it, so days may come in any order within the
lateness that is allowed; what is later than that is left out. State is what a route has
open: its days that wait, and its last entry. A timer drops the entry once the gap after
its last day has passed, as nothing can continue it then, so state follows the routes that
are open, not all that ever were.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewindow.operators.ledger import GAP

ENTRY = "id string, firstSeen date, lastSeen date, pct double, endDate date"
#: Where a session must keep the state of this stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_EPOCH, _DAY_MS = date(1970, 1, 1), 86_400_000


def _number(day) -> int | None:
    return None if day is None or pd.isna(day) else (pd.Timestamp(day).date() - _EPOCH).days


def _day(number: int | None) -> date | None:
    return None if number is None else _EPOCH + timedelta(days=int(number))


class LedgerProcessor(StatefulProcessor):
    """State of a route: ``days``, what was seen on days that wait for the watermark, and ``open``, its last entry."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "pct double, until int")
        self.open = handle.getValueState("open", "first int, last int, pct double, until int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for seen, pct, end in zip(batch["day"], batch["pct"], batch["endDate"], strict=True):
                day, found = _number(seen), (float(pct), _number(end))
                if (day + 1) * _DAY_MS <= passed:  # folded already
                    continue
                if self.days.containsKey((day,)):
                    found = max(found, self.days.getValue((day,)), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
                else:
                    self.handle.registerTimer((day + 1) * _DAY_MS)
                self.days.updateValue((day,), found)
        yield pd.DataFrame([], columns=["id", "firstSeen", "lastSeen", "pct", "endDate"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS - 1
        entry = tuple(self.open.get()) if self.open.exists() else None
        out = []
        if self.days.containsKey((day,)):
            pct, until = self.days.getValue((day,))
            self.days.removeKey((day,))
            if entry is not None and day - entry[1] <= self.gap and not (entry[3] is not None and entry[3] < day):
                entry = (entry[0], day, max(entry[2], pct), entry[3] if until is None else until)
            else:
                entry = (day, day, pct, until)
            self.open.update(entry)
            # the day after the last one that can continue the entry
            self.handle.registerTimer((day + self.gap + 2) * _DAY_MS)
            out.append((key[0], _day(entry[0]), _day(entry[1]), entry[2], _day(entry[3])))
        elif entry is not None and day > entry[1] + self.gap:
            self.open.clear()
        yield pd.DataFrame(out, columns=["id", "firstSeen", "lastSeen", "pct", "endDate"])

    def close(self) -> None:
        pass


def ledger_stream(sightings: DataFrame, *, gap: int = GAP, lateness: int = 3) -> DataFrame:
    """Streaming sightings (id, day, pct, endDate) to the entries that they open or change.

    ``lateness``: days by which a sighting may be behind the latest day of all. A day's
    sightings count once, by the highest pct, as in the replay. Write with ``update`` mode;
    the last row for (id, firstSeen) is the entry. Rows without an id or a day are left out.
    The session's state store must be RocksDB (:data:`STATE_STORE`).
    """
    timed = sightings.filter("id is not null and day is not null").select("id", "day", "pct", "endDate", F.col("day").cast("timestamp").alias("at"))
    timed = timed.withWatermark("at", f"{lateness} days")
    return timed.groupBy("id").transformWithStateInPandas(LedgerProcessor(gap), ENTRY, "Update", "EventTime")
