"""What must not grow faster than the input: exchanges, broadcasts, slices, timers and files."""

import tempfile

from pyspark.sql import functions as F

from registry import sample, streams
from storewake.operators import joins
from storewake.operators import settings_jobs as jobs
from storewake.operators.joins import lookup_join
from storewake.operators.timeline import MANY_SLICES, SLICE, Timeline
from storewake.streaming.session_stream import BrowserProcessor


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_settings_are_not_broadcast(spark):
    shops = spark.createDataFrame([("a",), ("b",), (None,)], "shop string")
    stored = spark.createDataFrame([("a", "x", "t", "1"), (None, "x", "t", "2")], "shop string, key string, type string, value string")
    seeded = jobs.seed_settings(shops, stored, {"ecommerce_spec": "true", "js_web_feature_toggle": "false"})
    assert "Broadcast" not in _plan(seeded)
    made = sorted(map(str, seeded.where("key <> 'x'").collect()))
    kinds = {"ecommerce_spec": ("boolean", "true"), "js_web_feature_toggle": ("boolean", "false")}
    wanted = [(shop, key, *kinds[key]) for shop in ("a", "b", None) for key in kinds]
    frame = spark.createDataFrame(wanted, "shop string, key string, type string, value string")
    assert made == sorted(map(str, frame.collect())) and seeded.count() == 8


def test_wide_rows_land_without_an_exchange(spark):
    def build(session, _):
        return session.range(90, numPartitions=3)

    folder = tempfile.mkdtemp(prefix="run-")
    wide = sample.landed(spark, folder, "wide", build, spread=False)
    assert wide.count() == 90 and len(wide.inputFiles()) == 3


def test_slices_are_held_and_sums_stay(spark):
    rows = spark.range(6000).select((F.col("id") % 900).alias("k"), "id")
    line = Timeline(rows, ["k"], ["id"], hot_rows=0, slice_rows=1).sum_through(n=F.lit(1))
    assert line.rows.select(SLICE).distinct().count() <= MANY_SLICES
    assert line.result().where(F.col("n") != F.floor(F.col("id") / 900) + 1).isEmpty()


def test_large_dimension_is_repeated_for_hot_keys_only(spark):
    keys = [1] * 40 + [None] * 40 + list(range(2, 12))
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long")
    names = spark.createDataFrame([(k, f"name{k}") for k in (1, 2, 3, None, 90)], "k long, name string")
    plain = lookup_join(rows, names, "k", max_rows=1)
    assert "explode" not in _plan(plain)
    for how in ("inner", "left", "left_semi", "left_anti"):
        for null_safe in (False, True):
            wanted = lookup_join(rows, names, "k", how, null_safe=null_safe)
            salted = lookup_join(rows, names, "k", how, max_rows=1, salts=5, null_safe=null_safe, hot_rows=10)
            cold = lookup_join(rows, names, "k", how, max_rows=1, null_safe=null_safe)
            for made in (salted, cold):
                assert made.columns == wanted.columns
                assert sorted(map(str, made.collect())) == sorted(map(str, wanted.collect()))


def test_a_piece_of_arrivals_has_its_number_of_files(spark):
    path = f"{tempfile.mkdtemp(prefix='run-')}/rows"
    for n in (50, 1, 0):
        streams._append(spark.range(n, numPartitions=5), path, 4)
    made = spark.read.parquet(path)
    assert made.count() == 51 and len(made.inputFiles()) == 12


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Map(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.pop


class _Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getValueState(self, *_):
        return _Value()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def registerTimer(self, at_ms):
        self.timers.add(at_ms)


class _At:
    def __init__(self, at_ms):
        self.at_ms = at_ms

    def getCurrentWatermarkInMs(self):
        return self.at_ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_one_timer_folds_all_minutes_that_are_due(spark):
    from storewake.streaming.session_stream import ROW

    handle = _Handle()
    processor = BrowserProcessor(10_000_000_000, 10_000_000_000, None)
    processor.init(handle)
    rows = [(n, n * 60_000_000 + 1, True, False, None, None, "t") for n in range(1, 6)]
    part = spark.createDataFrame(rows, ROW).toPandas()
    assert list(processor.handleInputRows(("s", "c"), iter([part]), _At(0))) == []
    assert handle.timers == {120_000} and len(handle.maps["waiting"]) == 5
    (sent,) = processor.handleExpiredTimer(("s", "c"), _At(250_000), _At(120_000))
    assert list(sent.event_id) == [1, 2, 3] and list(sent.new_session) == [True, False, False]
    assert handle.timers == {120_000, 300_000} and sorted(handle.maps["waiting"]) == [(300_000,), (360_000,)]
    (rest,) = processor.handleExpiredTimer(("s", "c"), _At(900_000), _At(300_000))
    assert list(rest.event_id) == [4, 5] and not handle.maps["waiting"]
    assert list(processor.handleExpiredTimer(("s", "c"), _At(900_000), _At(360_000))) == []


def test_texts_of_contexts_go_through_no_exchange(spark, sf_dir):
    from registry import pixel_sample, sample
    from storewake.plans import pixel

    parts = pixel_sample.pixel_events(spark, sf_dir), pixel_sample.page_loads(spark, sf_dir), sample.pixel_settings(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = pixel.context_rows(*parts)
        optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The joins stand below the projection that writes the texts of a page load.
    assert "person_bare" in optimized and "$initial_referring_domain" not in optimized[optimized.index("Join ") :]


def test_hot_keys_are_looked_for_in_groups(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{n % 50}",) for n in range(500)] + [("hot",)] * 40 + [(None,)] * 30, "k string")
    exact = {r.k: r["count"] for r in joins.hot_keys(rows, ["k"], 20).collect()}
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 0)
    assert {r.k: r["count"] for r in joins.hot_keys(rows, ["k"], 20).collect()} == exact == {"hot": 40, None: 30}
    assert joins.hot_keys(rows, ["k"], 40) is None
    monkeypatch.setattr(joins, "HOT_GROUPS", 1)
    assert joins.hot_keys(rows, ["k"], 40).count() == 0


def test_orders_meet_their_lines_before_their_texts(spark, sf_dir):
    from registry import sample

    plan = sample._orders(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Below the first join the heads have no texts yet.
    assert "/landing" in plan and "/landing" not in plan[plan.index("Join ") :]
    assert "RepartitionByExpression [l_orderkey" in plan and "SKU" not in plan[plan.index("RepartitionByExpression [l_orderkey") :]


def test_few_waiting_rows_are_one_value_and_fold_the_same(spark):
    from storewake.streaming.session_stream import ROW

    # Repeated minutes, rows at the same time, a login and three arrivals, the second of which is too many.
    rows = [
        (n, (n * 7919 % 11) * 60_000_000 + n % 3, n % 7 != 5, n % 4 == 0, "l" if n % 7 == 5 else None, None, f"t{n % 2}")
        for n in range(1, 25)
    ]
    arrivals = [rows[:4], rows[4:14], rows[14:]]
    made, held = [], []
    for few_rows in (0, 8, 100):
        handle, values, sent = _Handle(), {}, []
        handle.getValueState = lambda name, *_, values=values: values.setdefault(name, _Value())
        processor = BrowserProcessor(90_000_000, 300_000_000, None, few_rows)
        processor.init(handle)
        for part, watermark in zip(arrivals, (0, 0, 0), strict=True):
            frame = spark.createDataFrame(part, ROW).toPandas()
            assert list(processor.handleInputRows(("s", "c"), iter([frame]), _At(watermark))) == []
            held.append(len(handle.maps["waiting"]))
        for at_ms in (240_000, 300_000, 900_000):
            for frame in processor.handleExpiredTimer(("s", "c"), _At(at_ms), _At(min(handle.timers))):
                sent += frame.astype(object).where(frame.notna(), None).values.tolist()
        assert not handle.maps["waiting"] and (not few_rows or values["few"].held == ([], False))
        made.append((sent, handle.maps["tabs"], values["browser"].held))
    assert made[0] == made[1] == made[2] and len(made[0][0]) == sum(r[2] for r in rows)
    assert held[0] > 0 and held[3] == 0 < held[4] and held[6:] == [0, 0, 0]


def test_an_orders_text_lands_once_beside_its_copies(spark, sf_dir):
    from registry import sample, streams

    made = streams._webhooks(spark, sf_dir)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS payload#") == 4
    counts = {(r.topic, r.arrival_seq): r["count"] for r in made.groupBy("topic", "arrival_seq").count().collect()}
    orders = sample.orders(spark, sf_dir)
    whole = orders.count()
    assert counts["orders/create", 0] == counts["orders/updated", 0] == whole
    assert counts["orders/cancelled", 0] == orders.where("status = 'F'").count()
    assert counts["orders/create", 1] == orders.where("id % 10 = 0").count()


def test_sink_writes_rows_where_they_are(spark):
    from storewake.streaming import sink

    folder = tempfile.mkdtemp(prefix="run-")
    rows = spark.range(40, numPartitions=4).withColumn("api_host", F.concat(F.lit("h"), F.col("id") % 2))
    sink.batch_writer(folder)(rows, 0)
    files = sink.read_sink(spark, folder).inputFiles()
    # Two hosts in each of four tasks; moved together they would be a file or two.
    assert len(files) == 8 and all(f.endswith(".zstd.parquet") for f in files)
    assert sorted(r.id for r in sink.read_sink(spark, folder).collect()) == list(range(40))


def test_lines_of_refunds_meet_before_their_texts(spark, sf_dir):
    from registry import sample

    plan = sample._refunds(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "SKU" not in plan[plan.index("RepartitionByExpression [l_orderkey") :]


def test_hot_rows_land_compressed_and_bodies_are_made_once(spark, sf_dir, monkeypatch):
    from registry import pixel
    from storewake import session
    from storewake.operators import envelope

    rows = spark.range(300).select(F.lit("k").alias("k"), "id", F.lit("x" * 50).alias("body"), F.lit(None).alias("none"))
    for some in (rows.drop("none"), rows):
        made = envelope.numbered_batches(some, ["k"], ["id"], hot_rows=50, slice_rows=40)
        assert {(r.id, r.batch_no, r.place) for r in made.collect()} == {(n, n // 10, n + 1) for n in range(300)}
    landed = session.land(rows.drop("none"))
    assert all(f.endswith(".zstd.parquet") for f in landed.inputFiles()) and landed.schema.names == ["k", "id", "body"]
    assert session.land(rows).count() == 300

    seen = []
    numbered = envelope.numbered_batches
    monkeypatch.setattr(envelope, "numbered_batches", lambda sent, *a, **b: seen.append(sent) or numbered(sent, *a, **b))
    pixel.catalog.queries["pixel_requests"](spark, sf_dir)
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
