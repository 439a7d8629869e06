"""Streaming queries, run over what has landed and compared with the batch oracles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import pixel, pixel_sample, sample, server, state
from registry.common import Catalog
from registry.sample import landed, with_views
from storewake.operators import browser_state as bs
from storewake.operators import envelope, page_context, pixel_settings
from storewake.session import shared_folder
from storewake.sources import browser
from storewake.streaming import browser_stream, server_stream, session_stream, sink

catalog = Catalog()
query = catalog.query

BATCHES = 6

# What happened to an order; every topic brings its whole payload.
_ORDER_TOPICS = (("orders/create", "true"), ("orders/updated", "true"), ("orders/cancelled", "status = 'F'"))
# Half of the customers come as new ones.
_CUSTOMER_TOPIC = "case when id % 2 = 0 then 'customers/create' else 'customers/update' end"


def _webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads as landed text, in several files; a retry lands an hour later.

    The text of an order is made once and lands beside its copies under other topics, where it takes little
    room. The retries land last, in files of their own, so they often come with a later batch.
    """

    def texts(rows: DataFrame, topics: Column) -> DataFrame:
        body = [c for c in rows.columns if c not in ("shop", "arrival_seq", "status")]
        made = rows.select(topics.alias("topics"), "shop", "arrival_seq", F.to_json(F.struct(*body)).alias("payload"))
        return made.select(
            F.explode("topics").alias("topic"),
            "shop",
            "arrival_seq",
            "payload",
            F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_seq") * 3600).alias("arrived_at"),
        )

    topics = [F.when(F.expr(condition), F.lit(topic)) for topic, condition in _ORDER_TOPICS]
    parts = (
        texts(sample.orders(spark, sf_dir), F.array_compact(F.array(*topics))),
        texts(sample.refunds(spark, sf_dir), F.array(F.lit("refunds/create"))),
        texts(sample.customers(spark, sf_dir), F.array(F.expr(_CUSTOMER_TOPIC))),
        texts(sample.orders(spark, sf_dir, retries=True).where("arrival_seq > 0"), F.array(F.lit("orders/create"))),
    )
    return reduce(DataFrame.unionByName, parts)


def _stream(spark: SparkSession, frame: DataFrame, files: int) -> DataFrame:
    """A stream over the files of a landed table: some at a time, a large table in BATCHES parts."""
    paths = frame.inputFiles()
    path = paths[0].rsplit("/", 1)[0]
    files = max(files, -(-len(paths) // BATCHES))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, landed(spark, sf_dir, "webhooks", _webhooks, spread=False), 3)
    return server_stream.stream_server_events(rows, sample.shops(spark, sf_dir))


def _run(events: DataFrame, name: str, **options) -> DataFrame:
    return sink.run_to_end(events, f"{name}-{uuid.uuid4().hex[:8]}", **options)


_RETRIED = """
union all select shop, 'Order Completed', distinct_id, created_at,
  case when checkout_token is not null then {uuid} end, cast(id as varchar)
from fx_sent where source_name is distinct from 'web' and id % 10 = 0{only}
union all select shop, '$identify', distinct_id, created_at, null, cast(id as varchar)
from fx_sent where strategy = 'non-anonymized' and id % 10 = 0
"""


@query(
    with_views(
        "select shop, event, distinct_id, timestamp, uuid, ref from fx_server_events"
        + _RETRIED.format(uuid=server._COMPLETED_UUID, only=""),
        *server.SERVER_VIEWS,
    )
)
def stream_server_events(spark, sf_dir):
    """Every topic mapped on arrival; retries are still in it."""
    return _run(_events(spark, sf_dir), "server").select(
        "shop", "event", "distinct_id", "timestamp", "uuid", server._reference().alias("ref")
    )


@query(
    with_views(
        """
select shop, event, distinct_id, timestamp, uuid, ref from fx_server_events"""
        + """
union all select shop, 'Order Completed', distinct_id, created_at, null, cast(id as varchar)
from fx_sent where source_name is distinct from 'web' and id % 10 = 0 and checkout_token is null
union all select shop, '$identify', distinct_id, created_at, null, cast(id as varchar)
from fx_sent where strategy = 'non-anonymized' and id % 10 = 0
""",
        *server.SERVER_VIEWS,
    )
)
def stream_dedup(spark, sf_dir):
    """Events of all topics without the retries, which land an hour later; events without a uuid stay."""
    kept = _run(server_stream.stream_deduplicated(_events(spark, sf_dir)), "dedup")
    return kept.select(
        "shop", "event", "distinct_id", "timestamp", "uuid", server._reference().alias("ref")
    )


@query(
    with_views(
        """
select regexp_replace(api_host, '/$', '') || '/batch/' as url, api_key, count(*) as events
from (select shop from fx_server_events"""
        + " union all select shop from fx_sent where source_name is distinct from 'web' and id % 10 = 0"
        + " union all select shop from fx_sent where strategy = 'non-anonymized' and id % 10 = 0"
        + ") join fx_eligible using (shop) group by 1, 2",
        *server.SERVER_VIEWS,
    )
)
def stream_sink(spark, sf_dir):
    """The sent form of all events per host and key, as the sink holds it."""
    sent = envelope.enveloped(_events(spark, sf_dir))
    return _run(sent, "sink", partition_by="url").groupBy("url", "api_key").agg(
        F.count("body").alias("events")
    )


@query(
    with_views(
        """
select regexp_replace(api_host, '/$', '') || '/batch/' as url, api_key, count(*) as events, true as small
from (select shop from fx_server_events"""
        + " union all select shop from fx_sent where source_name is distinct from 'web' and id % 10 = 0"
        + " union all select shop from fx_sent where strategy = 'non-anonymized' and id % 10 = 0"
        + ") join fx_eligible using (shop) group by 1, 2",
        *server.SERVER_VIEWS,
    )
)
def stream_requests(spark, sf_dir):
    """Request bodies of all events per host and key; none holds more than a batch."""
    sent = envelope.enveloped(_events(spark, sf_dir))
    size = F.json_array_length(F.get_json_object("request", "$.batch"))
    named = F.get_json_object("request", "$.api_key")
    return _run(sent, "requests", requests=True).groupBy("url", named.alias("api_key")).agg(
        F.sum(size).cast("long").alias("events"),
        (F.max(size) <= envelope.BATCH_SIZE).alias("small"),
    )


_PIXEL_FIELDS = f"""
select {sample.shop_name('shop_no')} as shop, event_id, name, client_id, tab_id, page_load_id, timestamp, href,
  case when is_checkout and event_id % 4 <> 0 then '#' || cast(event_id as varchar) end as order_name,
  case when is_checkout then 'n' || cast(event_id % 3 as varchar) end as note,
  case when name in ('clicked', 'input_changed') then 'button' when name = 'form_submitted' then 'form' end as kind
from (select *, name like 'checkout%' or name = 'payment_info_submitted' as is_checkout from fx_px)
"""


def _pixel_json(spark: SparkSession, sf_dir: str) -> str:
    """Browser events as landed JSON lines."""
    frame = pixel_sample.pixel_events(spark, sf_dir)
    path = f"{shared_folder(spark)}/landed-json/{uuid.uuid4().hex}"
    frame.repartition(4).write.json(path)
    return path


def _pixel_fields(rows: DataFrame) -> DataFrame:
    return rows.select(
        "shop",
        "event_id",
        "name",
        "client_id",
        "tab_id",
        "page_load_id",
        "timestamp",
        "href",
        F.col("checkout.order.name").alias("order_name"),
        F.col("checkout.note").alias("note"),
        F.col("element.type").alias("kind"),
    )


@query(with_views(_PIXEL_FIELDS, state.PX))
def pixel_source(spark, sf_dir):
    """Landed browser events, read with their schema."""
    return _pixel_fields(browser.read_pixel_events(spark, _pixel_json(spark, sf_dir)))


@query(with_views(_PIXEL_FIELDS, state.PX))
def stream_pixel_source(spark, sf_dir):
    """The same as a stream, one file at a time."""
    rows = browser.stream_pixel_events(spark, _pixel_json(spark, sf_dir), 1)
    return _run(_pixel_fields(rows), "pixel-source", partition_by=None)


def _browser_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state._all_rows(spark, sf_dir).drop("name")


def heartbeat(rows: DataFrame) -> DataFrame:
    """A row of no browser, long after all others: it moves the watermark past them."""
    none = F.lit(None).cast("string")
    return rows.agg(F.max("ts_us").alias("ts_us")).select(
        F.lit("heartbeat").alias("shop"),
        F.lit("").alias("client_id"),
        F.lit(0).cast("long").alias("event_id"),
        (F.col("ts_us") + F.lit(40 * 24 * 3600 * 1_000_000)).alias("ts_us"),
        F.lit(True).alias("anonymous"),
        F.lit(True).alias("is_event"),
        none.alias("tab_id"),
        none.alias("login_email"),
        none.alias("post_email"),
    )


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs."""
    before = spark.conf.get(session_stream.STATE_STORE, None)
    spark.conf.set(session_stream.STATE_STORE, session_stream.ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(session_stream.STATE_STORE)
        else:
            spark.conf.set(session_stream.STATE_STORE, before)


@query(
    state._recursive(
        with_views(
            f"""
select s.shop, s.client_id, s.event_id, s.anonymous, s.reset, s.epoch, s.session_us, i.distinct_id, s.window_id
from fx_window s join fx_identity i on i.event_id = s.event_id and i.is_event
""",
            *state.STATE_VIEWS,
            state.IDENTITY,
            *state._session_views(bs.IDLE_US, bs.LENGTH_US),
            state.WINDOWS,
        )
    )
)
def stream_sessions(spark, sf_dir):
    """Identity, epochs and sessions as keyed state; equals the batch answer."""
    frame = landed(spark, sf_dir, "browser_rows", _browser_rows, heartbeat, spread=False)
    with rocks(spark):
        states = session_stream.stream_browser_state(_stream(spark, frame, 2), lateness="30 days")
        out = _run(states, "sessions", partition_by=None)
    return out.where("shop <> 'heartbeat' and not late").select(
        "shop", "client_id", "event_id", "anonymous", "reset", "epoch", "session_us", "distinct_id", "window_id"
    )


# Rows that arrive in pieces of time: a stream takes one piece per micro-batch.

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
PIECES = 4


def _append(rows: DataFrame, path: str, files: int) -> None:
    """Append the rows in exactly that many files, empty ones included: so many make one micro-batch."""
    spark = rows.sparkSession

    def held() -> int:
        try:
            return len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        except AnalysisException:
            return 0

    before = held()
    rows.coalesce(files).write.mode("append").parquet(path)
    if files > 1:
        empty = spark.createDataFrame([], rows.schema).coalesce(1)
        for _ in range(held() - before, files):
            empty.write.mode("append").parquet(path)


def arriving(
    spark: SparkSession, frame: DataFrame, arrival_us: Column, bounds: tuple[int, int], last: DataFrame | None = None
) -> DataFrame:
    """A stream over the rows in PIECES equal parts of the time between the bounds, then `last`."""
    path = f"{shared_folder(spark)}/arrivals/{uuid.uuid4().hex}"
    first, end = bounds
    piece = F.floor((arrival_us - first) * PIECES / F.lit(end - first + 1))
    placed = frame.withColumn("_piece", F.greatest(F.lit(0), F.least(piece, F.lit(PIECES - 1))))
    sizes = {r["_piece"]: r["count"] for r in placed.groupBy("_piece").count().collect()}
    files = 1 + max(sizes.values(), default=0) // sample.ROWS_PER_FILE
    for n in range(PIECES):
        _append(placed.where(F.col("_piece") == n).drop("_piece"), path, files)
    if last is not None:
        _append(last.select(*frame.columns), path, 1)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(path)


def _bounds(frame: DataFrame, column: str = "ts_us") -> tuple[int, int]:
    return tuple(frame.agg(F.min(column), F.max(column)).first())


def _pixel_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events and page loads up to six hours out of order; a last event with its load follows 40 days later."""
    events, loads = pixel_sample.pixel_events(spark, sf_dir), pixel_sample.page_loads(spark, sf_dir)
    settings = pixel_settings.pixel_shops(sample.pixel_settings(spark, sf_dir))
    bounds = _bounds(events)
    later = F.lit(40 * DAY_US)
    wanted = pixel_settings.subscribed_events(events, settings).select(*events.columns)
    load = page_context.working_loads(loads).where("customer.email is not null")
    pair = wanted.join(load.select(*browser_stream.LOAD_KEYS), list(browser_stream.LOAD_KEYS)).orderBy("event_id").limit(1)
    beat = {"client_id": F.lit("heartbeat"), "page_load_id": F.lit("heartbeat")}
    last_event = pair.withColumns(beat | {"ts_us": F.lit(bounds[1]) + later})
    last_load = (
        load.join(pair.select("shop", "page_load_id"), ["shop", "page_load_id"], "left_semi")
        .withColumns(beat | {"loaded_us": F.lit(bounds[1]) + later})
    )
    jitter = F.pmod(F.col("event_id"), F.lit(7)) * HOUR_US
    load_jitter = F.pmod(F.xxhash64("page_load_id"), F.lit(7)) * HOUR_US
    return (
        arriving(spark, events, F.col("ts_us") + jitter, bounds, last_event),
        arriving(spark, loads, F.col("loaded_us") + load_jitter, bounds, last_load),
    )


_BODY = """api_key string, batch array<struct<event: string, timestamp: string, uuid: string, properties: struct<
  shop: string, distinct_id: string, `$session_id`: string, `$window_id`: string, client_id: string,
  `$current_url`: string, `$host`: string, totalQuantity: int>>>"""


@query(
    f"""
select regexp_replace(api_host, '/$', '') || '/batch/' as url, api_key, shop, event, distinct_id, timestamp, uuid,
  session_id, window_id, client_id, current_url, host, load_quantity from ({pixel.catalog.oracles["pixel_event_feed"]})
"""
)
def stream_pixel_feed(spark, sf_dir):
    """The browser pipeline as a stream, up to the bodies of its requests: the events of the batch table."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events, loads = _pixel_streams(spark, sf_dir)
    send = sink.request_writer(f"{folder}/out")
    with rocks(spark):
        stream = browser_stream.BrowserStream(
            events, loads, sample.pixel_settings(spark, sf_dir), folder,
            lateness="12 hours", page_life="3 days", state_lateness="9 days",
        )
        stream.start_join(availableNow=True).awaitTermination()
        # The join writes a file per task and day: as in `_stream`, a large table comes in BATCHES parts.
        files = max(60, -(-len(spark.read.parquet(stream.payloads).inputFiles()) // BATCHES))
        stream.start_events(
            f"{folder}/out", lambda rows, n: send(envelope.enveloped(rows), n), files, availableNow=True
        ).awaitTermination()
    body = F.from_json("request", _BODY)
    sent = sink.read_sink(spark, f"{folder}/out").select("url", body.alias("r"))
    sent = sent.select("url", "r.api_key", F.explode("r.batch").alias("e")).where("e.properties.client_id <> 'heartbeat'")
    p = F.col("e.properties")
    return sent.select(
        "url", "api_key", p["shop"].alias("shop"), "e.event", p["distinct_id"].alias("distinct_id"), "e.timestamp", "e.uuid",
        p["$session_id"].alias("session_id"), p["$window_id"].alias("window_id"), p["client_id"].alias("client_id"),
        p["$current_url"].alias("current_url"), p["$host"].alias("host"), p["totalQuantity"].alias("load_quantity"),
    )


@query(pixel.catalog.oracles["orphan_events"])
def stream_orphans(spark, sf_dir):
    """Events whose page load did not come, known once the watermark has passed its time."""
    events, loads = _pixel_streams(spark, sf_dir)
    keyed = events.select(*browser_stream.LOAD_KEYS, "event_id", "ts_us")
    with rocks(spark):
        joined = browser_stream.join_page_loads(keyed, page_context.narrow_contexts(loads), "12 hours", "3 days")
        out = _run(browser_stream.orphans(joined).drop("context"), "orphans", partition_by=None)
    return out.select("shop", "event_id", "page_load_id")


_LATE_DAYS = 6
_ARRIVAL = f"ts_us + case when event_id % 23 = 5 then {_LATE_DAYS * DAY_US} else 0 end + greatest(event_id, 0) % 7 * {HOUR_US}"
# A row is late if its minute ends before the watermark: the latest earlier piece less a day.
LATE = (
    "fx_late",
    f"""
select *, coalesce(((ts_us // 60000000) + 1) * 60000 <= seen_us // 1000 - {DAY_US // 1000}, false) as late from (
  select l.*, (select max(e.ts_us) from fx_pieces e where e.piece < l.piece) as seen_us from fx_pieces l)""",
)
PIECED = (
    "fx_pieces",
    f"""
select *, greatest(0, least({PIECES - 1},
  floor((arrival_us - first_us) * {PIECES} / (end_us - first_us + 1))))::int as piece
from (select *, {_ARRIVAL} as arrival_us, min(ts_us) over () as first_us, max(ts_us) over () as end_us from fx_line)""",
)
ACCEPTED = ("fx_accepted", "select * from fx_late where not late")


@query(
    with_views(
        """
select is_event, late, event_id, epoch, ts_us from (
  select is_event, late, event_id, cast(null as bigint) as epoch, ts_us from fx_late where late
  union all select is_event, late, event_id, epoch, ts_us from fx_epoch where is_event)
""",
        *state.STATE_VIEWS[:7],
        PIECED,
        LATE,
        ACCEPTED,
        *state._epoch_views("fx_accepted"),
    )
)
def stream_late_rows(spark, sf_dir):
    """Rows up to six days late: those behind the watermark come out aside, all others as if they had not been."""
    frame = landed(spark, sf_dir, "browser_rows_plain", _browser_rows, spread=False)
    rows = arriving(spark, frame, F.expr(_ARRIVAL), _bounds(frame), heartbeat(frame))
    with rocks(spark):
        out = _run(session_stream.stream_browser_state(rows, lateness="1 day"), "late", partition_by=None)
    return out.where("shop <> 'heartbeat'").select("is_event", "late", "event_id", "epoch", "ts_us")


@query(catalog.oracles["stream_sessions"])
def stream_warm_start(spark, sf_dir):
    """The first half in batch, the second as a stream that starts from what the first left behind."""
    frame = landed(spark, sf_dir, "browser_rows_plain", _browser_rows, spread=False)
    first, end = _bounds(frame)
    middle = (first + end) // 2
    before = frame.where(F.col("ts_us") <= middle)
    after = arriving(spark, frame.where(F.col("ts_us") > middle), F.col("ts_us"), (middle + 1, end), heartbeat(frame))
    with rocks(spark):
        states = session_stream.stream_browser_state(after, "1 day", initial=bs.closing_state(before))
        streamed = _run(states, "warm", partition_by=None)
    columns = (
        "shop", "client_id", "event_id", "anonymous", "reset", "epoch", "session_us", "distinct_id", "window_id",
    )
    old = bs.browser_state(before).select(*columns)
    return old.unionByName(streamed.where("shop <> 'heartbeat' and not late").select(*columns))
