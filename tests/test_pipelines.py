"""Sources, redaction, sinks and plans."""

import json
from collections import Counter
import tempfile

from pyspark.sql import functions as F

from registry import pixel_sample, sample, state, streams
from registry.streams import heartbeat
from storewake.operators import browser_state as bs
from storewake.operators import envelope, server_events, shops
from storewake.plans import pixel, server
from storewake.sources import webhooks
from storewake.streaming import session_stream, sink


def test_landed_json(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    lines = [
        {"topic": "orders/create", "shop": "a", "arrival_seq": 0, "payload": '{"id": 5, "extra": 1}'},
        {"topic": "orders/create", "shop": "a", "arrival_seq": 1, "payload": "broken"},
        {"topic": "orders/create", "shop": "a", "arrival_seq": 2, "payload": "5"},
        {"topic": "orders/create", "shop": "a", "arrival_seq": 3, "payload": "[]"},
        {"topic": "orders/create", "shop": "a", "arrival_seq": 4, "payload": None},
        {"topic": "shop/redact", "shop": "b", "arrival_seq": 0, "payload": "{}"},
        {"topic": "app/uninstalled", "shop": "c", "arrival_seq": 0, "payload": "{}"},
    ]
    with open(f"{folder}/part.json", "w") as out:
        out.writelines(json.dumps(line) + "\n" for line in lines)
    landed = webhooks.read_landed(spark, folder)
    (order,) = webhooks.payloads(landed, "orders/create").collect()
    assert order.id == 5 and '"extra": 1' in order.raw and order.email is None
    assert sorted(r.arrival_seq for r in webhooks.unreadable(landed).collect()) == [1, 2, 3, 4]
    assert [r.shop for r in webhooks.notices(landed).collect()] == ["b"]
    assert [r.shop for r in webhooks.uninstalled_shops(landed).collect()] == ["c"]
    audit = tempfile.mkdtemp(prefix="run-")
    webhooks.append_audit(webhooks.notices(landed), audit)
    webhooks.append_audit(webhooks.notices(landed), audit)
    assert spark.read.parquet(audit).count() == 2


def _pixel(spark, sf_dir, strict):
    return pixel.pixel_event_table(
        pixel_sample.pixel_events(spark, sf_dir),
        pixel_sample.page_loads(spark, sf_dir),
        sample.pixel_settings(spark, sf_dir),
        strict=strict,
    )


def test_strict_redaction_only_removes(spark, sf_dir):
    loads = pixel_sample.page_loads(spark, sf_dir)
    rows = pixel.context_rows(
        pixel_sample.pixel_events(spark, sf_dir), loads, sample.pixel_settings(spark, sf_dir)
    )
    anonymous = {r.event_id for r in rows.where("anonymous").select("event_id").collect()}
    kept = {r.arrival_seq: r for r in _pixel(spark, sf_dir, False).collect()}
    strict = {r.arrival_seq: r for r in _pixel(spark, sf_dir, True).collect()}
    assert set(kept) == set(strict)
    names = ("id", "email", "firstName", "lastName", "phone")
    for key, row in kept.items():
        loose, tight = json.loads(row.properties), json.loads(strict[key].properties)
        assert set(tight) <= set(loose)
        if key not in anonymous:
            assert loose == tight
        else:
            assert "firstName" not in tight
            assert not set(names) & set(tight["$set"])
            assert tight.get("email") is None and tight.get("form") is None
    assert any("firstName" in json.loads(kept[k].properties) for k in anonymous)


def test_person_update_leaves_out_missing_fields(spark, sf_dir):
    gate = shops.eligible_shops(sample.shops(spark, sf_dir))
    rows = server_events.with_order_person(shops.with_shop(sample.orders(spark, sf_dir), gate))
    texts = server_events.event_table(rows, server_events.order_identify_mapping())
    for row in texts.collect():
        assert None not in json.loads(row.properties)["$set"].values()


def test_batches_hold_every_event_once(spark, sf_dir):
    gate = shops.eligible_shops(sample.shops(spark, sf_dir))
    rows = server_events.with_order_person(shops.with_shop(sample.orders(spark, sf_dir), gate))
    events = server_events.event_table(rows, server_events.order_updated_mapping())
    sent = envelope.enveloped(events).withColumn("ts_us", F.unix_micros(F.to_timestamp("timestamp")))
    sent = sent.withColumn("ts_us", F.coalesce("ts_us", F.lit(0)))
    batched = envelope.numbered_batches(sent, ["url", "api_key"], ["ts_us", "body"])
    requests = [json.loads(r.request) for r in envelope.batch_requests(batched).collect()]
    assert max(len(r["batch"]) for r in requests) == envelope.BATCH_SIZE
    assert sum(len(r["batch"]) for r in requests) == events.count()
    event = requests[0]["batch"][0]
    assert event["properties"]["$lib"] == envelope.LIBRARY and event["event"] == "Order Updated"
    assert "uuid" not in event or event["uuid"]


def test_own_properties_win(spark):
    row = spark.createDataFrame(
        [("e", "d", '{"$lib":"mine","a":null}', None, None)],
        "event string, distinct_id string, properties string, timestamp string, uuid string",
    )
    body = json.loads(row.select(envelope.event_body()).collect()[0][0])
    assert body == {
        "event": "e",
        "properties": {"distinct_id": "d", "$lib_version": "1.0.0", "$lib": "mine", "a": None},
    }


def test_shop_filter_is_pushed_and_shops_are_broadcast(spark, sf_dir):
    gate = shops.eligible_shops(sample.shops(spark, sf_dir))
    events = server_events.order_cancelled(shops.with_shop(sample.cancelled_orders(spark, sf_dir), gate))
    plan = events._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line and "cancelled_at" in line][-1]
    assert "line_items" not in scan.split("ReadSchema")[1]
    assert "EqualTo(status,F)" in plan


def test_repeated_batch_replaces_itself(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    rows = spark.range(10).withColumn("api_host", F.concat(F.lit("h"), F.col("id") % 2))
    write = sink.batch_writer(folder)
    for batch in (0, 0, 1):
        write(rows, batch)
    assert sink.read_sink(spark, folder).count() == 20


def test_stream_state_does_not_depend_on_the_split(spark, sf_dir):
    rows = state._all_rows(spark, sf_dir).drop("name")
    spark.conf.set(session_stream.STATE_STORE, session_stream.ROCKS)
    t = bs.add_identity(bs.add_epochs(bs.timeline(rows)))
    batch = t.result().where("is_event").select("event_id", "epoch", "distinct_id")
    expected = sorted(map(tuple, batch.collect()))
    for files in (1, 3):
        folder = tempfile.mkdtemp(prefix="run-")
        rows.repartition(files).write.mode("overwrite").parquet(folder)
        heartbeat(rows).select(*rows.columns).write.mode("append").parquet(folder)
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = sink.run_to_end(
            session_stream.stream_browser_state(source, "35 days"), f"split{files}", partition_by=None
        )
        made = out.where("shop <> 'heartbeat'").select("event_id", "epoch", "distinct_id")
        assert sorted(map(tuple, made.collect())) == expected


def test_stream_folds_minute_by_minute_and_forgets(spark):
    """Files in the order of time and a short lateness: state is carried over many flushes."""
    from test_state import MINUTE, SCHEMA, make_rows, plain_state

    rows = sorted((r for r in make_rows(5, events=240) if r[1] is not None), key=lambda r: r[4])
    last = max(r[4] for r in rows) + 400 * 24 * 60 * MINUTE
    rows.append(("heartbeat", "", "a", 9999, last, True, True, None, None))
    spark.conf.set(session_stream.STATE_STORE, session_stream.ROCKS)
    folder = tempfile.mkdtemp(prefix="run-")
    for n in range(0, len(rows), 31):
        spark.createDataFrame(rows[n : n + 31], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = session_stream.stream_browser_state(source, "1 minute")
    made = sink.run_to_end(kept, "minutes", partition_by=None).where("shop <> 'heartbeat'").collect()
    wanted = plain_state(rows[:-1], 30 * MINUTE, 24 * 60 * MINUTE)
    assert {r.event_id: (r.epoch, r.session_us) for r in made} == {k: v[:2] for k, v in wanted.items()}
    batch = bs.browser_state(spark.createDataFrame(rows[:-1], SCHEMA)).collect()
    assert {r.event_id: r.window_id for r in made} == {r.event_id: r.window_id for r in batch}
    forgetful = session_stream.stream_browser_state(source, "1 minute", retention_us=600 * MINUTE)
    short = sink.run_to_end(forgetful, "forgets", partition_by=None).where("shop <> 'heartbeat'").collect()
    assert len(short) == len(made)
    before = {}
    for r in sorted(short, key=lambda r: (r.client_id, r.ts_us, r.event_id)):
        if r.client_id in before and r.ts_us - before[r.client_id] > 602 * MINUTE:
            assert r.epoch == 0
        before[r.client_id] = r.ts_us


def test_the_feed_is_read_and_parsed_once(spark, sf_dir):
    landed = sample.landed(spark, sf_dir, "webhooks", streams._webhooks)
    table = server.feed_events_table(sample.shops(spark, sf_dir), webhooks.feed(landed))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("payload") > 0
    scans = [line for line in plan.splitlines() if "Relation" in line and "payload" in line]
    assert len(scans) == 1
    topics = {
        "created": ["orders/create"], "updated": ["orders/updated"], "cancelled": ["orders/cancelled"],
        "refunds": ["refunds/create"], "customers": ["customers/create", "customers/update"],
    }
    parts = {name: webhooks.payloads(landed, *some) for name, some in topics.items()}
    apart = server.server_events_table(sample.shops(spark, sf_dir), **parts)
    columns = ["shop", "event", "distinct_id", "timestamp", "uuid", "properties", "arrival_seq", "arrived_at"]
    count = lambda frame: Counter(map(tuple, frame.select(*columns).collect()))
    assert count(table) == count(apart)


def test_broken_payloads_make_no_event(spark, sf_dir):
    shop = sample.shops(spark, sf_dir).where("api_key <> '' and api_host <> '' and server_enabled").first().shop
    bodies = ["broken", "5", "[]", None, "{", '[{"email":"a@x"}]', "{}", '{"id":"no number","email":"a@x.com"}']
    rows = [(topic, shop, n, body) for topic in webhooks.TOPIC_SCHEMAS for n, body in enumerate(bodies)]
    landed = spark.createDataFrame(rows, "topic string, shop string, arrival_seq long, payload string")
    made = server.feed_events_table(sample.shops(spark, sf_dir), webhooks.feed(landed)).collect()
    assert {r.arrival_seq for r in made} == {7}
