"""Identity and sessions against a plain fold, with and without hot clients."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from storewake.operators import browser_state as bs
from storewake.operators.dedup import deduplicated
from storewake.operators.envelope import numbered_batches
from storewake.operators.joins import detail_join, lookup_join
from storewake.operators.timeline import SLICE, Timeline

MINUTE = 60_000_000
SCHEMA = (
    "shop string, client_id string, tab_id string, event_id long, ts_us long, is_event boolean,"
    " anonymous boolean, login_email string, post_email string"
)


def make_rows(seed, clients=4, events=400):
    """One client holds a third of the rows and is never idle for long."""
    draw = random.Random(seed)
    rows, clock = [], {}
    for i in range(events):
        client = "bot" if i % 3 == 0 else f"c{draw.randrange(clients)}"
        client = None if client == "c1" else client
        step = draw.choice([0, 1, 20, 29]) if client == "bot" else draw.choice([0, 5, 30, 31, 900])
        clock[client] = clock.get(client, 10**15) + step * MINUTE + draw.choice([0, 0, 1])
        event = draw.random() > 0.1
        login = draw.choice([None, None, f"L{i % 5}@x"])
        post = draw.choice([None, None, f"P{i % 4}@x"]) if event else None
        rows.append(
            ("s", client, draw.choice("ab"), i, clock[client], event, draw.random() < 0.4, login, post)
        )
    return rows


def plain_state(rows, idle_us, length_us):
    """Row by row, as a browser would do it: event to (epoch, session start, email)."""
    out, order = {}, lambda r: (r[0], r[1] or "", r[4], r[5], r[3])
    for _, own in itertools.groupby(sorted(rows, key=order), lambda r: (r[0], r[1])):
        epoch, email, before_us, before_anonymous, start = 0, None, None, None, None
        for _, _, _, event_id, ts, is_event, anonymous, login, post in own:
            reset = is_event and anonymous and before_anonymous is False
            if reset:
                epoch, email = epoch + 1, None
            login = login if not anonymous else None
            if is_event:
                if before_us is None or reset or ts - before_us > idle_us or ts - start > length_us:
                    start = ts
                out[event_id] = (epoch, start, login or email)
                before_us, before_anonymous = ts, anonymous
            if not anonymous:
                email = post or login or email
    return out


LIMITS = [
    {},
    {"hot_rows": 50},
    {"hot_rows": 0, "fold_rows": 0, "slice_rows": 20},
]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_plain_fold(spark, seed, limits):
    rows = make_rows(seed)
    expected = plain_state(rows, 30 * MINUTE, 24 * 60 * MINUTE)
    state = bs.browser_state(spark.createDataFrame(rows, SCHEMA), **limits)
    made = {r.event_id: r for r in state.collect()}
    assert set(made) == set(expected)
    for event_id, (epoch, session_us, email) in expected.items():
        r = made[event_id]
        assert (r.epoch, r.session_us) == (epoch, session_us)
        if email:
            assert r.distinct_id == email
        else:
            assert "@" not in r.distinct_id


def test_same_answer_however_hot(spark):
    frame = spark.createDataFrame(make_rows(3), SCHEMA)
    columns = ["event_id", "epoch", "distinct_id", "session_id", "window_id", "new_session"]
    answers = [
        sorted(tuple(r) for r in bs.browser_state(frame, **limits).select(*columns).collect())
        for limits in LIMITS
    ]
    assert answers[0] == answers[1] == answers[2]


def test_length_limit_holds_without_a_client(spark):
    """One browser with an event every 20 minutes for 50 hours has three sessions, named or not."""
    base = 10**15
    rows = [
        ("s", client, "t", i + 1000 * n, base + i * 20 * MINUTE, True, False, None, None)
        for n, client in enumerate(["c", None])
        for i in range(150)
    ]
    for limits in LIMITS:
        state = bs.browser_state(spark.createDataFrame(rows, SCHEMA), **limits)
        found = state.groupBy("client_id").agg(F.sum(F.col("new_session").cast("int")).alias("n"))
        assert {(r.client_id, r.n) for r in found.collect()} == {("c", 3), (None, 3)}


def timed_rows():
    """Null keys, null times and a burst of one instant."""
    draw = random.Random(9)
    rows = []
    for i in range(600):
        key = draw.choice(["a", "a", "b", None, None])
        time = None if draw.random() < 0.2 else 77 if key == "a" else draw.randrange(40)
        rows.append((key, time, i, draw.randrange(5)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 100}, {"hot_rows": 0, "slice_rows": 40}])
def test_running_columns_of_awkward_rows(spark, limits):
    rows = timed_rows()
    frame = spark.createDataFrame(rows, "k string, t long, i long, v long")
    t = Timeline(frame, ["k"], ["t", "i"], **limits)
    largest = t.rows.where(F.col(SLICE) > 0).groupBy("k", SLICE).count().agg(F.max("count")).first()[0]
    assert (largest or 0) <= limits.get("slice_rows", limits.get("hot_rows", 0))
    t.sum_through(total=F.col("v")).last_before(latest=F.when(F.col("v") > 2, F.col("i")))
    made = {r.i: (r.total, r.latest) for r in t.result().collect()}
    order = lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])
    for _, own in itertools.groupby(sorted(rows, key=order), lambda r: r[0]):
        total, latest = 0, None
        for _, _, i, v in own:
            total += v
            assert made[i] == (total, latest)
            latest = i if v > 2 else latest


def test_gap_limit_is_strict(spark):
    base = 10**15
    rows = [
        ("s", "c", "t", i, base + gap, True, False, None, None)
        for i, gap in enumerate([0, 30 * MINUTE, 60 * MINUTE + 1000])
    ]
    state = bs.browser_state(spark.createDataFrame(rows, SCHEMA)).orderBy("event_id").collect()
    assert [r.new_session for r in state] == [True, False, True]


def test_state_windows_share_one_exchange(spark):
    frame = spark.createDataFrame(make_rows(4), SCHEMA).repartition(4)
    t = bs.add_segments(bs.add_identity(bs.add_epochs(bs.timeline(frame))))
    plan = t.result()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(shop") == 1


def test_numbering_of_a_hot_key(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") * 3_600_000_000).alias("ts_us"),
        F.col("id"),
    )
    made = numbered_batches(rows, ["k"], ["ts_us", "id"], hot_rows=10).where("k = 'hot'")
    places = [(r.id, r.batch_no, r.place) for r in made.orderBy("id").collect()]
    assert places == [(3 * i, i // 10, i + 1) for i in range(334)]


def test_lookup_join_beyond_the_broadcast_limit(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    names = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        small = lookup_join(facts, names, "k", how)
        large = lookup_join(facts, names, "k", how, max_rows=10, salts=7)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_dedup_keeps_first_and_is_stable(spark):
    rows = [("u" if i % 3 else None, i, f"e{i}") for i in range(60)] + [("v", 99, "x")]
    events = spark.createDataFrame(rows, "uuid string, arrival_seq long, event string")
    once = deduplicated(events)
    assert once.where("uuid = 'u'").collect()[0].event == "e1"
    assert once.where("uuid is null").count() == 20
    assert sorted(map(tuple, deduplicated(once).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_detail_join_of_hot_keys(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    details = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = detail_join(rows, details, ["k"])
    split = detail_join(rows, details, ["k"], hot_rows=10)
    assert plain.count() > 500
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_salted_anti_join(spark):
    rows = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    gone = spark.range(3).select(F.col("id").alias("k"))
    salted = lookup_join(rows, gone, "k", "left_anti", max_rows=1, salts=3)
    assert {r.k for r in salted.collect()} == {3, 4, 5, 6}
