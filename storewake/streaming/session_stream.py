"""Identity, consent epochs, sessions and window ids of browser events as keyed state.

The state of a browser is one small row, one more per tab and the rows that
wait. Rows wait by the minute until the watermark has passed it and are then
folded in time order, so that a row that arrives late, but within the watermark,
cannot change what was already sent. One timer of a browser folds all minutes that are due, and
reads their rows only. The first rows that wait, up to a bounded number, are one value of
the state, as most browsers have few; when there are more, they are filed by the minute. With a
retention, a browser that is silent for so long is forgotten: its next row starts like a new browser's.

Spark would drop rows behind the watermark without a trace. Here the processor
sees them: a row whose minute has already been folded, or that has no time, comes out
at once with `late` set and changes nothing, so accepted and late rows are the input.

The state can start from a batch: `operators.browser_state.closing_state` of what came
before is handed in as the initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from storewake.functions.ids import time_key
from storewake.operators.browser_state import IDLE_US, KEYS, LENGTH_US

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


ROW = _struct(
    event_id=LongType(),
    ts_us=LongType(),
    is_event=BooleanType(),
    anonymous=BooleanType(),
    login=StringType(),
    post=StringType(),
    tab_id=StringType(),
)
MINUTE = _struct(at_ms=LongType())
WAITING = _struct(rows=ArrayType(ROW))
FEW = _struct(rows=ArrayType(ROW), filed=BooleanType())
TAB = _struct(tab_id=StringType())
WINDOW = _struct(window_us=LongType(), window_epoch=LongType())
_NO_STATE = (None, 0, None, None, None, None)
STATE = _struct(
    email=StringType(),
    epoch=LongType(),
    epoch_us=LongType(),
    was_anonymous=BooleanType(),
    last_us=LongType(),
    session_us=LongType(),
)
OUT = _struct(
    shop=StringType(),
    client_id=StringType(),
    event_id=LongType(),
    ts_us=LongType(),
    anonymous=BooleanType(),
    reset=BooleanType(),
    epoch=LongType(),
    epoch_us=LongType(),
    email=StringType(),
    session_us=LongType(),
    new_session=BooleanType(),
    tab_id=StringType(),
    window_us=LongType(),
    window_epoch=LongType(),
    is_event=BooleanType(),
    late=BooleanType(),
)
_MINUTE_MS = 60_000
# Rows that wait as one value, which is read and written whole; more are filed by the minute.
FEW_ROWS = 128


def _fold(state: tuple, row: tuple, idle_us: int, length_us: int) -> tuple[tuple, tuple | None]:
    """The state after a row, and what is sent for it."""
    email, epoch, epoch_us, was_anonymous, last_us, session_us = state
    event_id, ts_us, is_event, anonymous, login, post, _ = row
    session = (epoch, session_us)
    epoch_us = ts_us if epoch_us is None else epoch_us
    reset = bool(is_event and anonymous and was_anonymous is False)
    if reset:
        email, epoch, epoch_us, last_us = None, epoch + 1, ts_us, None
    if login and not anonymous:
        email = login
    sent = None
    if is_event:
        was_none = was_anonymous is None
        if last_us is None or ts_us - last_us > idle_us or ts_us - session_us > length_us:
            session_us = ts_us
        last_us, was_anonymous = ts_us, bool(anonymous)
        opened = was_none or (epoch, session_us) != session
        sent = (event_id, ts_us, bool(anonymous), reset, epoch, epoch_us, email, session_us, opened)
    if post and not anonymous:
        email = post
    return (email, epoch, epoch_us, was_anonymous, last_us, session_us), sent


def _rows_of(part: pd.DataFrame) -> list[tuple]:
    """Plain rows of a batch, converted column by column."""
    columns = []
    for field in ROW.fields:
        cast = {LongType: int, BooleanType: bool}.get(type(field.dataType), str)
        # A missing value is None or not equal to itself.
        columns.append([None if v is None or v != v else cast(v) for v in part[field.name].tolist()])
    return list(zip(*columns, strict=True))


def _minute_end(row: tuple) -> int | None:
    """When the watermark has passed the minute of a row, in milliseconds."""
    return None if row[1] is None else (row[1] // 1000 // _MINUTE_MS + 1) * _MINUTE_MS


class BrowserProcessor(StatefulProcessor):
    def __init__(self, idle_us: int, length_us: int, retention_us: int | None, few_rows: int = 0):
        """Up to `few_rows` waiting rows are one value; with 0 all are filed by the minute."""
        self._idle_us = idle_us
        self._length_us = length_us
        self._retention_us = retention_us
        self._few_rows = few_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("browser", STATE)
        self._waiting = handle.getMapState("waiting", MINUTE, WAITING)
        self._tabs = handle.getMapState("tabs", TAB, WINDOW)
        self._few = handle.getValueState("few", FEW) if self._few_rows else None

    def _few_waiting(self) -> tuple[list[tuple], bool]:
        """The rows that wait as one value, and whether others may be filed by the minute."""
        if self._few is None:
            return [], True
        found = self._few.get()
        return ([], False) if found is None else ([tuple(r) for r in found[0]], found[1])

    def _file(self, rows: list[tuple]) -> None:
        by_minute: dict[int, list[tuple]] = {}
        for row in rows:
            by_minute.setdefault(_minute_end(row), []).append(row)
        for at_ms, new in by_minute.items():
            if self._waiting.containsKey((at_ms,)):
                new = [tuple(r) for r in self._waiting.getValue((at_ms,))[0]] + new
            self._waiting.updateValue((at_ms,), (new,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late, new, folded_ms = [], [], timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for row in _rows_of(part):
                at_ms = _minute_end(row)
                if at_ms is None or at_ms <= folded_ms:
                    late.append((*key, *row[:2], row[3], *[None] * 6, row[6], None, None, row[2], True))
                else:
                    new.append(row)
        if new:
            few, filed = self._few_waiting()
            if len(few) + len(new) <= self._few_rows:
                self._few.update((few + new, filed))
            else:
                self._file(few + new)
                if self._few is not None:
                    self._few.update(([], True))
            self._handle.registerTimer(min(map(_minute_end, new)))
        if late:
            yield pd.DataFrame(late, columns=OUT.names)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """One row of `closing_state`."""
        (row,) = initialState.astype(object).where(initialState.notna(), None).to_dict("records")
        whole = {n: None if row[n] is None else int(row[n]) for n in ("epoch", "epoch_us", "last_us", "session_us")}
        anonymous = None if row["was_anonymous"] is None else bool(row["was_anonymous"])
        self._state.update(
            (row["email"], whole["epoch"] or 0, whole["epoch_us"], anonymous, whole["last_us"], whole["session_us"])
        )
        for tab in row["tabs"] if row["tabs"] is not None else ():
            self._tabs.updateValue((tab["tab_id"],), (int(tab["window_us"]), int(tab["window_epoch"])))
        if self._retention_us is not None and whole["last_us"] is not None:
            self._handle.registerTimer((whole["last_us"] + self._retention_us) // 1000 + _MINUTE_MS)

    def _window(self, row: tuple, sent: tuple, tabs: dict[str, tuple | None], kept: bool) -> tuple:
        """The window of the event's tab: a new one with its first event or a session it opens.

        `kept` says whether windows of the browser may be in the state.
        """
        tab = row[6] or ""
        if not sent[-1]:
            if tab not in tabs:
                there = kept and self._tabs.containsKey((tab,))
                tabs[tab] = tuple(self._tabs.getValue((tab,))) if there else None
            if tabs[tab] is not None:
                return tabs[tab]
        tabs[tab] = (row[1], sent[4])
        return tabs[tab]

    def _silent(self, state: tuple, now_us: int) -> bool:
        """Whether a browser has been silent for the retention."""
        return self._retention_us is not None and state[4] is not None and state[4] + self._retention_us <= now_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold every minute that the watermark has passed; the next one that waits gets a timer of its own."""
        now_ms = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        few, filed = self._few_waiting()
        minutes = sorted(minute for (minute,) in self._waiting.keys()) if filed else []
        later = [row for row in few if _minute_end(row) > now_ms]
        due: dict[int, list[tuple]] = {}
        passed = [minute for minute in minutes if minute <= now_ms]
        for at_ms in passed:
            due[at_ms] = [tuple(r) for r in self._waiting.getValue((at_ms,))[0]]
            self._waiting.removeKey((at_ms,))
        # What is filed came before the few.
        for row in few:
            if _minute_end(row) <= now_ms:
                due.setdefault(_minute_end(row), []).append(row)
        if len(later) < len(few) or self._few is not None and len(passed) == len(minutes) > 0:
            self._few.update((later, len(passed) < len(minutes)))
        waiting = [*map(_minute_end, later), *minutes[len(passed) :]]
        if waiting:
            self._handle.registerTimer(min(waiting))
        state = tuple(self._state.get()) if self._state.exists() else _NO_STATE
        known, kept, sent, tabs = state, state is not _NO_STATE, [], {}
        for at_ms in sorted(due):
            if self._silent(state, (at_ms - _MINUTE_MS) * 1000):
                self._tabs.clear()
                state, tabs, kept = _NO_STATE, {}, False
            for row in sorted(due[at_ms], key=lambda r: (r[1], r[2], r[0])):
                state, out = _fold(state, row, self._idle_us, self._length_us)
                if out is not None:
                    sent.append((*key, *out, row[6], *self._window(row, out, tabs, kept), True, False))
        for tab, window in tabs.items():
            if window is not None:
                self._tabs.updateValue((tab,), window)
        if due:
            self._state.update(state)
            if self._retention_us is not None:
                self._handle.registerTimer(max(due) + self._retention_us // 1000)
        elif known is not _NO_STATE and self._silent(known, expiredTimerInfo.getExpiryTimeInMs() * 1000):
            self._state.clear()
            self._tabs.clear()
        if sent:
            yield pd.DataFrame(sent, columns=OUT.names)

    def close(self) -> None:
        pass


def with_event_time(rows: DataFrame, lateness: str, ts_us: Column | None = None) -> DataFrame:
    """Rows with `_at`, the time that the stream's watermark follows."""
    micros = F.col("ts_us") if ts_us is None else ts_us
    return rows.withColumn("_at", F.timestamp_micros(micros)).withWatermark("_at", lateness)


def stream_browser_state(
    rows: DataFrame,
    lateness: str = "10 minutes",
    idle_us: int = IDLE_US,
    length_us: int = LENGTH_US,
    retention_us: int | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """The columns of `browser_state` for a stream of the same rows, and `is_event` and `late`.

    Rows without an `_at` of `with_event_time` get one with the given lateness; a union of streams has
    them already. Late rows have no state columns. `initial` has rows of
    `closing_state`. Needs the RocksDB state store (see STATE_STORE and ROCKS). Without a retention
    the state of every browser is kept.
    """
    timed = rows if "_at" in rows.columns else with_event_time(rows, lateness)
    # Without its event time the processor is given late rows too.
    named = timed.withColumnsRenamed({"login_email": "login", "post_email": "post"}).select(*KEYS, *ROW.names)
    state = named.groupBy(*KEYS).transformWithStateInPandas(
        BrowserProcessor(idle_us, length_us, retention_us, FEW_ROWS),
        outputStructType=OUT,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if initial is None else initial.groupBy(*KEYS),
    )
    who = (F.col("shop"), F.col("client_id"), F.col("epoch"))
    return state.select(
        *KEYS,
        "event_id",
        "ts_us",
        "anonymous",
        "reset",
        "epoch",
        "session_us",
        F.coalesce("email", time_key(F.col("epoch_us"), *who)).alias("distinct_id"),
        time_key(F.col("session_us"), *who).alias("session_id"),
        "new_session",
        time_key(F.col("window_us"), F.col("shop"), F.col("client_id"), F.col("tab_id"), F.col("window_epoch")).alias(
            "window_id"
        ),
        "is_event",
        "late",
    )
