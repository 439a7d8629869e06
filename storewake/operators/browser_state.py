"""Identity, consent epochs, sessions and window ids of browser events.

Rows are ordered by (ts_us, is_event, event_id) per (shop, client_id). A row
with is_event = false is a page load: it can bring a login email but belongs to
no session. Rows need: shop, client_id, tab_id, event_id, ts_us, is_event,
anonymous, login_email, post_email.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewake.functions.ids import time_key
from storewake.operators.joins import fits_broadcast, join_keys, lookup_join
from storewake.operators.timeline import HOT_ROWS, Timeline
from storewake.session import cut_lineage

KEYS = ("shop", "client_id")
ORDER = ("ts_us", "is_event", "event_id")
SEGMENT = (*KEYS, "segment")

# Fixed values, in microseconds.
IDLE_US = 30 * 60 * 1_000_000
LENGTH_US = 24 * 3600 * 1_000_000

# Longer segments are cut by the distributed way instead of by one fold each.
FOLD_ROWS = 500_000


def _on_event(value: Column) -> Column:
    return F.when(F.col("is_event"), value)


def timeline(
    rows: DataFrame, hot_rows: int = HOT_ROWS, slice_rows: int | None = None
) -> Timeline:
    return Timeline(rows, KEYS, ORDER, hot_rows, slice_rows)


def add_epochs(t: Timeline) -> Timeline:
    """A change of the stored flag from open to anonymous starts an epoch at that event.

    Adds first_row, prev_event_us, reset and epoch.
    """
    t.last_before(
        _seen=F.lit(True),
        _prev_anonymous=_on_event(F.col("anonymous")),
        prev_event_us=_on_event(F.col("ts_us")),
    )
    was_open = F.col("_prev_anonymous").eqNullSafe(False)
    t.add(
        first_row=F.col("_seen").isNull(),
        reset=F.col("is_event") & F.col("anonymous") & was_open,
    )
    t.sum_through(epoch=F.col("reset").cast("long"))
    t.rows = t.rows.drop("_seen", "_prev_anonymous")
    return t


def add_identity(t: Timeline) -> Timeline:
    """A login counts at once, an email of a checkout or form from the next row on.

    Adds distinct_id, and known_id: who the browser was before the row. What a row leaves behind is kept in a struct, so that a
    reset (a struct with null inside) hides everything before it.
    """
    open_row = ~F.col("anonymous")
    login = F.when(open_row & (F.col("login_email") != ""), F.col("login_email"))
    post = F.when(open_row & (F.col("post_email") != ""), F.col("post_email"))
    left = F.coalesce(post, login)
    starts = F.col("first_row") | F.col("reset")
    t.last_before(_left=F.when(F.col("reset") | left.isNotNull(), F.struct(left.alias("email"))))
    t.last_through(_epoch_us=F.when(starts, F.col("ts_us")))
    known = F.when(~F.col("reset"), F.col("_left.email"))
    anonymous_id = time_key(F.col("_epoch_us"), F.col("shop"), F.col("client_id"), F.col("epoch"))
    t.add(distinct_id=F.coalesce(login, known, anonymous_id), known_id=F.coalesce(known, anonymous_id))
    t.rows = t.rows.drop("_left", "_epoch_us")
    return t


def add_segments(t: Timeline, idle_us: int = IDLE_US) -> Timeline:
    """Segments end at a gap longer than idle_us or at a reset; adds segment, segment_us."""
    gap = F.abs(F.col("ts_us") - F.col("prev_event_us")) > idle_us
    opens = F.col("is_event") & (F.col("prev_event_us").isNull() | F.col("reset") | gap)
    t.add(_opens=opens)
    t.sum_through(segment=F.col("_opens").cast("long"))
    t.last_through(segment_us=F.when(F.col("_opens"), F.col("ts_us")))
    t.rows = t.rows.drop("_opens")
    return t


def _folded_starts(times: DataFrame, length_us: int) -> DataFrame:
    """Session starts of segments that fit one fold."""

    def step(starts: Column, time: Column) -> Column:
        late = time - F.element_at(starts, -1) > length_us
        return F.when(late, F.concat(starts, F.array(time))).otherwise(starts)

    sorted_times = F.array_sort(F.collect_set("ts_us"))
    starts = F.aggregate("times", F.slice("times", 1, 1), step)
    listed = times.groupBy(*SEGMENT).agg(sorted_times.alias("times"))
    return listed.select(*SEGMENT, F.explode(starts).alias("ts_us"))


def _next_starts(times: DataFrame, length_us: int, **limits: int | None) -> DataFrame:
    """For each event time the first one later than it by more than length_us.

    Times and questions (a time + length_us) stand on one timeline, backwards, so that the answer is the
    latest time before the question; a long segment is cut into slices.
    """
    points = times.distinct()
    asked = points.select(
        *SEGMENT, "ts_us", (-(F.col("ts_us") + length_us)).alias("_order"), F.lit(0).alias("_given")
    )
    given = points.select(*SEGMENT, "ts_us", (-F.col("ts_us")).alias("_order"), F.lit(1).alias("_given"))
    line = Timeline(asked.unionByName(given), SEGMENT, ("_order", "_given"), **limits)
    answered = line.last_before(next_us=F.when(F.col("_given") == 1, F.col("ts_us"))).result()
    return answered.where((F.col("_given") == 0) & F.col("next_us").isNotNull()).select(*SEGMENT, "ts_us", "next_us")


def _distributed_starts(times: DataFrame, length_us: int, **limits: int | None) -> DataFrame:
    """Session starts of segments of any size, by doubling the jumps from start to start.

    After round r the starts up to 2^r sessions away are known, so the rounds
    grow with the logarithm of the longest segment's days.
    """
    starts = cut_lineage(times.groupBy(*SEGMENT).agg(F.min("ts_us").alias("ts_us")))
    jumps = cut_lineage(_next_starts(times, length_us, **limits))
    while True:
        near = F.broadcast(starts) if fits_broadcast(starts) else starts
        reached = join_keys(jumps, near, [*SEGMENT, "ts_us"], "inner", null_safe=True).select(
            *SEGMENT, F.col("next_us").alias("ts_us")
        )
        reached = cut_lineage(reached)
        if reached.isEmpty():
            break
        starts = cut_lineage(starts.union(reached).distinct())
        hop = jumps.withColumnRenamed("next_us", "mid_us")
        rest = jumps.withColumnRenamed("ts_us", "mid_us")
        jumps = cut_lineage(join_keys(hop, rest, [*SEGMENT, "mid_us"], "inner", null_safe=True).drop("mid_us"))
    return starts


def add_sessions(
    t: Timeline, length_us: int = LENGTH_US, fold_rows: int = FOLD_ROWS
) -> Timeline:
    """Cut segments into sessions of at most length_us after their start.

    Only segments longer than that are looked at again. Their list is written
    once (it needs few narrow columns), because its size decides the join.
    Adds session_us, session_id and new_session.
    """
    times = t.rows.where("is_event").select(*SEGMENT, "ts_us")
    spans = times.groupBy(*SEGMENT).agg(
        F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"), F.count("*").alias("n")
    )
    long_ones = cut_lineage(spans.where(F.col("to_us") - F.col("from_us") > length_us))
    session_us = F.col("segment_us")
    if not long_ones.isEmpty():
        chosen = lookup_join(times, long_ones.select(*SEGMENT, "n"), SEGMENT, null_safe=True)
        starts = _folded_starts(chosen.where(F.col("n") <= fold_rows).drop("n"), length_us)
        if not long_ones.where(F.col("n") > fold_rows).isEmpty():
            large = chosen.where(F.col("n") > fold_rows).drop("n")
            starts = starts.unionByName(_distributed_starts(large, length_us, **t.limits))
        marks = cut_lineage(starts.withColumn("_starts", F.lit(True)))
        t.rows = lookup_join(t.rows, marks, [*SEGMENT, "ts_us"], "left", null_safe=True)
        segment = t.within("segment").last_through(_start_us=F.when(F.col("_starts"), F.col("ts_us")))
        t.rows = segment.rows
        session_us = F.coalesce("_start_us", session_us)
    t.add(session_us=_on_event(session_us))
    t.last_before(_prev=_on_event(F.struct("epoch", "session_us")))
    changed = ~F.struct("epoch", "session_us").eqNullSafe(F.col("_prev"))
    t.add(
        new_session=F.col("is_event") & changed,
        session_id=time_key(F.col("session_us"), F.col("shop"), F.col("client_id"), F.col("epoch")),
    )
    t.rows = t.rows.drop("_prev", "_starts", "_start_us")
    return t


def add_windows(t: Timeline) -> Timeline:
    """A tab gets a window id with its first event and a new one when it opens a session.

    Other tabs keep theirs. Adds window_id.
    """
    tab = t.within("tab_id")
    tab.last_before(_seen=_on_event(F.lit(True)))
    opens = F.col("new_session") | (F.col("is_event") & F.col("_seen").isNull())
    tab.last_through(_window=F.when(opens, F.struct("ts_us", "epoch")))
    parts = [F.col(c) for c in (*KEYS, "tab_id", "_window.epoch")]
    tab.add(window_id=time_key(F.col("_window.ts_us"), *parts))
    t.rows = tab.rows.drop("_seen", "_window")
    return t


def _stated(
    rows: DataFrame,
    idle_us: int = IDLE_US,
    length_us: int = LENGTH_US,
    hot_rows: int = HOT_ROWS,
    fold_rows: int = FOLD_ROWS,
    slice_rows: int | None = None,
) -> DataFrame:
    t = timeline(rows, hot_rows, slice_rows)
    for add in (add_epochs, add_identity):
        add(t)
    add_segments(t, idle_us)
    add_sessions(t, length_us, fold_rows)
    add_windows(t)
    return t.result()


def browser_state(rows: DataFrame, **limits: int) -> DataFrame:
    """All state columns of the events; page load rows are left out of the result.

    `limits` are idle_us, length_us, hot_rows, fold_rows and slice_rows.
    """
    return _stated(rows, **limits).where("is_event").drop(
        "is_event", "first_row", "prev_event_us", "segment_us", "known_id"
    )


def closing_state(rows: DataFrame, **limits: int) -> DataFrame:
    """What every browser's rows leave behind: a stream of later rows can start from it.

    One row per browser: email, epoch, epoch_us, was_anonymous, last_us, session_us, and
    `tabs` with the window of every tab. Aggregates only, so hot browsers merge before the exchange; the tabs of one browser are taken to fit one row.
    """
    order = F.struct(*ORDER)
    open_row = ~F.col("anonymous")
    left = F.coalesce(
        F.when(open_row & (F.col("post_email") != ""), F.col("post_email")),
        F.when(open_row & (F.col("login_email") != ""), F.col("login_email")),
    )
    stated = cut_lineage(
        _stated(rows, **limits).select(
            *KEYS, "tab_id", *ORDER, "anonymous", "epoch", "session_us", "new_session", left.alias("left")
        )
    )
    last_event = F.when(F.col("is_event"), order)
    epochs = stated.groupBy(*KEYS, "epoch").agg(
        F.max_by("left", F.when(F.col("left").isNotNull(), order)).alias("email"),
        F.min("ts_us").alias("epoch_us"),
        F.max_by("anonymous", last_event).alias("was_anonymous"),
        F.max(_on_event(F.col("ts_us"))).alias("last_us"),
        F.max_by("session_us", last_event).alias("session_us"),
    )
    last = F.max_by(F.struct("email", "epoch", "epoch_us", "was_anonymous", "last_us", "session_us"), F.col("epoch"))
    browsers = epochs.groupBy(*KEYS).agg(last.alias("s")).select(*KEYS, "s.*")
    window = F.struct(F.col("ts_us").alias("window_us"), F.col("epoch").alias("window_epoch"))
    tab = F.coalesce("tab_id", F.lit("")).alias("tab_id")
    tabs = (
        stated.where("is_event")
        .groupBy(*KEYS, tab)
        .agg(F.coalesce(F.max_by(window, F.when(F.col("new_session"), order)), F.min_by(window, order)).alias("w"))
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("tab_id", "w.window_us", "w.window_epoch")).alias("tabs"))
    )
    return join_keys(browsers, tabs, KEYS, "left", null_safe=True)


def identity_links(state: DataFrame) -> DataFrame:
    """(person before, email) pairs where an email differs from the current id.

    `state` has the rows of `add_identity`: a checkout or form links its email to
    the sender, a login (on the row of its page load) to who the browser was.
    """
    login, post = F.col("login_email"), F.col("post_email")
    on_load = ~F.col("is_event") & (login != "") & (login != F.col("known_id"))
    on_event = F.col("is_event") & (post != "") & (post != F.col("distinct_id"))
    from_id = F.when(F.col("is_event"), F.col("distinct_id")).otherwise(F.col("known_id"))
    to_id = F.when(F.col("is_event"), post).otherwise(login)
    return state.where(~F.col("anonymous") & (on_event | on_load)).select(
        "shop", "client_id", "event_id", "ts_us", from_id.alias("from_id"), to_id.alias("to_id")
    )
