"""Timed batches and the closing state of browsers against plain folds."""

import itertools
import random

import pytest

from test_state import SCHEMA, make_rows

from storewake.operators import browser_state as bs
from storewake.operators import buffers
from storewake.streaming import session_stream


def plain_batches(rows, size, wait_us):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or "")
    order = lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2])
    for _, own in itertools.groupby(sorted(rows, key=order), key):
        number, held, first = -1, size, None
        for place, (_, at, n) in enumerate(own, 1):
            at = -(1 << 61) if at is None else at
            if held == size or at >= first + wait_us:
                number, held, first = number + 1, 0, at
            held += 1
            out[n] = (number, place)
    return out


@pytest.mark.parametrize(("size", "limits"), [(10, {}), (3, {"hot_rows": 100, "slice_rows": 50}), (1, {})])
def test_timed_batches(spark, monkeypatch, size, limits):
    monkeypatch.setattr(buffers, "FAN", 4)
    r = random.Random(7)
    rows = []
    for n in range(1500):
        key = "hot" if n % 3 == 0 else r.choice(["a", "b", None, f"k{n}"])
        at = r.choice([None, *range(20)]) if n % 50 == 0 else r.randrange(0, 120 * (400 if key == "hot" else 100))
        rows.append((key, at, n))
    rows += [("burst", 5, 2000 + n) for n in range(700)]
    frame = spark.createDataFrame(rows, "k string, at long, n long")
    made = buffers.timed_batches(frame, ["k"], ["at", "n"], "at", size, 300, **limits).collect()
    assert {r.n: (r.batch_no, r.place) for r in made} == plain_batches(rows, size, 300)
    assert len(made) == len(rows)


def test_timed_batches_of_nothing(spark):
    frame = spark.createDataFrame([], "k string, at long, n long")
    assert buffers.timed_batches(frame, ["k"], ["at", "n"], "at").count() == 0


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 50, "slice_rows": 20}])
def test_closing_state_is_the_streams_fold(spark, limits):
    rows = make_rows(3)
    idle, length = 30 * 60_000_000, 24 * 3600 * 1_000_000
    made = bs.closing_state(spark.createDataFrame(rows, SCHEMA), **limits).collect()
    got = {
        r.client_id: (
            (r.email, r.epoch, r.epoch_us, r.was_anonymous, r.last_us, r.session_us),
            {t.tab_id: (t.window_us, t.window_epoch) for t in r.tabs or ()},
        )
        for r in made
    }
    wanted = {}
    order = lambda r: (r[1] or "", r[4], r[5], r[3])
    for client, own in itertools.groupby(sorted(rows, key=order), lambda r: r[1]):
        state, tabs = session_stream._NO_STATE, {}
        for _, _, tab, event_id, ts, is_event, anonymous, login, post in own:
            state, sent = session_stream._fold(state, (event_id, ts, is_event, anonymous, login, post, tab), idle, length)
            if sent is not None and (sent[-1] or tab not in tabs):
                tabs[tab] = (ts, sent[4])
        wanted[client] = (state, tabs)
    assert got == wanted


def test_late_rows_of_no_time_come_out_aside(spark):
    processor = session_stream.BrowserProcessor(1, 1, None)
    processor.init(_Handle())
    part = spark.createDataFrame(
        [(1, None, True, False, None, None, "t"), (2, 5_000_000, True, False, None, None, "t"), (3, 1, False, True, "x", None, None)],
        session_stream.ROW,
    ).toPandas()
    (out,) = processor.handleInputRows(("s", "c"), iter([part]), _Watermark(60_000))
    assert [(r.event_id, r.is_event, r.late) for r in out.itertuples()] == [(1, True, True), (2, True, True), (3, False, True)]


class _Handle:
    def getValueState(self, *_):
        return None

    def getMapState(self, *_):
        return None


class _Watermark:
    def __init__(self, at_ms):
        self.at_ms = at_ms

    def getCurrentWatermarkInMs(self):
        return self.at_ms
