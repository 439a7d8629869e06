"""Queries over identity, consent, sessions and windows of browser events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import pixel_sample, sample
from registry.common import Catalog
from registry.sample import view, with_views
from storewake.operators import browser_state as bs
from storewake.operators import buffers, envelope, pixel_settings
from storewake.operators.joins import lookup_join
from storewake.plans import pixel

catalog = Catalog()
query = catalog.query

HOUR_US = 3_600_000_000

SHOPS = view("fx_shops", sample.SHOPS)
PX = view("fx_px", pixel_sample.PIXEL)
LOADS = ("fx_loads", pixel_sample.LOADS)
FACTS = ("fx_facts", pixel_sample.LOAD_FACTS)
CONTEXTS = (
    "fx_contexts",
    r"""
select f.*, s.shop, s.tracked_events, s.on_checkout, s.on_page, s.on_search, s.spec = 'true' as spec_enabled,
  epoch_us(loaded) as loaded_us, s.api_key, s.api_host,
  case strategy when 'non-anonymized' then false
    when 'non-anonymized-by-consent' then not coalesce(analytics_allowed, false) else true end as anonymous
from fx_facts f join fx_shops s using (shop_no)
where coalesce(api_key, '') <> '' and regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')""",
)
# Events with a working page load, before the subscription filter.
ROWS = (
    "fx_rows",
    """
select e.event_id, e.client_id, e.tab_id, e.name, c.shop, c.anonymous, epoch_us(e.ts) as ts_us,
  case when e.name like 'checkout%' or e.name = 'payment_info_submitted' then
    case when e.event_id % 5 = 0 then null
      when e.event_id % 7 = 0 then 'Buyer' || cast(e.user_id as varchar) || '@Example.com'
      else 'user' || cast(e.user_id as varchar) || '@example.com' end
    when e.name = 'form_submitted' then
      case when e.event_id % 4 = 0 then 'second@example.com'
        when e.event_id % 3 = 0 then null
        else 'Form' || cast(e.user_id as varchar) || '@example.com' end end as post_email
from fx_px e join fx_contexts c using (page_load_id)""",
)
LINE = (
    "fx_line",
    """
select event_id, client_id, tab_id, name, shop, anonymous, ts_us, true as is_event,
  cast(null as varchar) as login, case when not anonymous then post_email end as post from fx_rows
union all
select -1, client_id, cast(null as varchar), cast(null as varchar), shop, anonymous, loaded_us, false,
  case when not anonymous then customer_email end, cast(null as varchar)
from fx_contexts where has_customer and customer_email is not null""",
)


def _epoch_views(line: str = "fx_line") -> tuple[tuple[str, str], ...]:
    over = "(partition by shop, client_id order by ts_us, is_event, event_id rows between unbounded preceding and"
    return (
        (
            "fx_prev",
            f"""
select *, row_number() over {over} current row) = 1 as first_row,
  last_value(case when is_event then anonymous end ignore nulls) over {over} 1 preceding) as prev_anonymous,
  last_value(case when is_event then ts_us end ignore nulls) over {over} 1 preceding) as prev_us
from {line}""",
        ),
        (
            "fx_epoch",
            f"""
select *, (sum(reset::int) over {over} current row))::bigint as epoch from (
  select *, is_event and anonymous and coalesce(not prev_anonymous, false) as reset from fx_prev)""",
        ),
    )




def _sql_key(us: str, parts: str) -> str:
    """The time key: milliseconds, then a hash of parts and time."""
    ms = f"lpad(lower(to_hex(({us}) // 1000)), 12, '0')"
    tail = f"md5({parts} || '|' || cast({us} as varchar))"
    nibble = f"substr('89ab', (('0x'||substr({tail},5,1))::int % 4) + 1, 1)"
    return (
        f"substr({ms},1,8)||'-'||substr({ms},9,4)||'-7'||substr({tail},2,3)||'-'||{nibble}"
        f"||substr({tail},6,3)||'-'||substr({tail},9,12)"
    )


IDENTITY = (
    "fx_identity",
    f"""
select *, coalesce(login,
  last_value(coalesce(post, login) ignore nulls) over
    (partition by shop, client_id, epoch order by ts_us, is_event, event_id
     rows between unbounded preceding and 1 preceding),
  {_sql_key('epoch_us', "shop || '|' || client_id || '|' || cast(epoch as varchar)")}) as distinct_id
from (select *, min(ts_us) over (partition by shop, client_id, epoch) as epoch_us from fx_epoch)""",
)
# Who the browser was just before a row.
KNOWN = (
    "fx_known",
    f"""
select *, coalesce(last_value(coalesce(post, login) ignore nulls) over
    (partition by shop, client_id, epoch order by ts_us, is_event, event_id
     rows between unbounded preceding and 1 preceding),
  {_sql_key('epoch_us', "shop || '|' || client_id || '|' || cast(epoch as varchar)")}) as known
from (select *, min(ts_us) over (partition by shop, client_id, epoch) as epoch_us from fx_epoch)""",
)
STATE_VIEWS = (SHOPS, PX, LOADS, FACTS, CONTEXTS, ROWS, LINE, *_epoch_views())


def _session_views(idle_us: int, length_us: int) -> tuple[tuple[str, str], ...]:
    """Sessions by the plain definition: from each start, the first event past the length."""
    over = "(partition by shop, client_id order by ts_us, event_id rows between unbounded preceding and current row)"
    return (
        (
            "fx_segment",
            f"""
select *, sum(opens::int) over {over} as segment from (
  select *, prev_us is null or reset or ts_us - prev_us > {idle_us} as opens from fx_epoch where is_event)""",
        ),
        (
            "fx_starts",
            f"""
select shop, client_id, epoch, segment, min(ts_us) as start_us from fx_segment group by all
union all
select s.shop, s.client_id, s.epoch, s.segment, min(e.ts_us) from fx_starts s join fx_segment e
  on e.shop = s.shop and e.client_id is not distinct from s.client_id and e.segment = s.segment
  and e.ts_us > s.start_us + {length_us}
group by s.shop, s.client_id, s.epoch, s.segment, s.start_us""",
        ),
        (
            "fx_session",
            """
select e.*, (select max(start_us) from fx_starts s where s.shop = e.shop and s.client_id is not distinct from e.client_id
  and s.segment = e.segment and s.start_us <= e.ts_us) as session_us
from fx_segment e""",
        ),
    )


_TAB = "(partition by shop, client_id, tab_id order by ts_us, event_id"
WINDOWS = (
    "fx_window",
    f"""
select *, {_sql_key("session_us", "shop || '|' || client_id || '|' || cast(epoch as varchar)")} as session_id,
  {_sql_key("wstart.us", "shop || '|' || client_id || '|' || tab_id || '|' || cast(wstart.epoch as varchar)")} as window_id
from (select *, last_value(case when window_opens then {{'us': ts_us, 'epoch': epoch}} end ignore nulls) over
    {_TAB} rows between unbounded preceding and current row) as wstart
  from (select *, new_session or row_number() over {_TAB}) = 1 as window_opens
    from (select *, row_number() over (partition by shop, client_id, epoch, session_us order by ts_us, event_id) = 1 as new_session
      from fx_session)))
""",
)


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with a working page load and the logins, on one timeline."""
    events = pixel_sample.pixel_events(spark, sf_dir)
    shops = pixel_settings.pixel_shops(sample.pixel_settings(spark, sf_dir))
    contexts = pixel.consents_of(pixel_sample.page_loads(spark, sf_dir), shops)
    joined = pixel.join_context(events, contexts)
    keep = ["shop", "client_id", "tab_id", "event_id", "ts_us", "name", "anonymous"]
    rows = pixel.state_rows(joined, contexts)
    return rows.select(*keep, "is_event", "login_email", "post_email")


_EPOCHS_SQL = with_views(
    "select shop, client_id, event_id, anonymous, reset, epoch from fx_epoch where is_event",
    *STATE_VIEWS,
)


def _epochs(rows: DataFrame, **limits) -> DataFrame:
    t = bs.add_epochs(bs.timeline(rows, **limits))
    return t.result().where("is_event").select(
        "shop", "client_id", "event_id", "anonymous", "reset", "epoch"
    )


@query(_EPOCHS_SQL)
def consent_epochs(spark, sf_dir):
    return _epochs(_all_rows(spark, sf_dir))


@query(_EPOCHS_SQL)
def consent_epochs_hot_clients(spark, sf_dir):
    """The same with every client treated as hot, cut into slices of some hundred rows."""
    return _epochs(_all_rows(spark, sf_dir), hot_rows=0, slice_rows=500)


# Rows as they also come: no browser id, bursts of one instant and, for epochs, no time.
_NO_CLIENT = "case when client_id like '%7' then null else client_id end"
_BURST = "case when client_id like '%3' then ts_us - ts_us % 86400000000 else ts_us end"
_NO_TIME = f"case when is_event and event_id % 11 = 0 then null else {_BURST} end"


def _awkward(time: str) -> tuple[str, str]:
    return (
        "fx_awkward",
        f"select * replace ({_NO_CLIENT} as client_id, {time} as ts_us) from fx_line",
    )


def _awkward_rows(spark: SparkSession, sf_dir: str, time: str) -> DataFrame:
    return _all_rows(spark, sf_dir).withColumns(
        {"client_id": F.expr(_NO_CLIENT), "ts_us": F.expr(time)}
    )


# Spark puts nulls first; the load rows, which have one event id, are told apart by nothing else.
def _nulls_first(text: str) -> str:
    return text.replace("order by ts_us", "order by ts_us nulls first")


@query(
    _nulls_first(
        with_views(
            "select shop, client_id, event_id, anonymous, reset, epoch from fx_epoch where is_event",
            *STATE_VIEWS[:7],
            _awkward(_NO_TIME),
            *_epoch_views("fx_awkward"),
        )
    )
)
def consent_epochs_awkward_rows(spark, sf_dir):
    """Null times, null browser ids and bursts, with every client cut into slices."""
    return _epochs(_awkward_rows(spark, sf_dir, _NO_TIME), hot_rows=0, slice_rows=300)


_IDENTITY_SQL = with_views(
    "select shop, client_id, event_id, distinct_id from fx_identity where is_event",
    *STATE_VIEWS,
    IDENTITY,
)


def _identity(rows: DataFrame, **limits) -> DataFrame:
    t = bs.add_identity(bs.add_epochs(bs.timeline(rows, **limits)))
    return t.result().where("is_event").select("shop", "client_id", "event_id", "distinct_id")


@query(_IDENTITY_SQL)
def stitched_identity(spark, sf_dir):
    return _identity(_all_rows(spark, sf_dir))


@query(_IDENTITY_SQL)
def stitched_identity_hot_clients(spark, sf_dir):
    return _identity(_all_rows(spark, sf_dir), hot_rows=0, slice_rows=500)


def _sessions(rows: DataFrame, idle_us: int, length_us: int, fold_rows: int, **limits) -> DataFrame:
    t = bs.add_segments(bs.add_epochs(bs.timeline(rows, **limits)), idle_us)
    state = bs.add_sessions(t, length_us, fold_rows).result().where("is_event")
    return state.groupBy("shop", "client_id", "session_id", "session_us").agg(
        F.count("*").alias("events"),
        F.max("ts_us").alias("last_us"),
        F.sum(F.col("new_session").cast("int")).alias("opened"),
    )


def _sessions_sql(idle_us: int, length_us: int) -> str:
    key = _sql_key("session_us", "shop || '|' || client_id || '|' || cast(epoch as varchar)")
    return _recursive(
        with_views(
            f"""
select shop, client_id, {key} as session_id, session_us, count(*) as events, max(ts_us) as last_us,
  1 as opened
from fx_session group by shop, client_id, epoch, session_us
""",
            *STATE_VIEWS,
            *_session_views(idle_us, length_us),
        )
    )


LONG_IDLE_US = 12 * HOUR_US


@query(_sessions_sql(bs.IDLE_US, bs.LENGTH_US))
def sessions(spark, sf_dir):
    return _sessions(_all_rows(spark, sf_dir), bs.IDLE_US, bs.LENGTH_US, bs.FOLD_ROWS)


@query(_sessions_sql(LONG_IDLE_US, bs.LENGTH_US))
def sessions_capped(spark, sf_dir):
    """An idle time of 12 hours makes segments that the length limit must cut."""
    return _sessions(_all_rows(spark, sf_dir), LONG_IDLE_US, bs.LENGTH_US, bs.FOLD_ROWS)


@query(_sessions_sql(LONG_IDLE_US, bs.LENGTH_US))
def sessions_capped_hot_clients(spark, sf_dir):
    """The same by the distributed way only: sliced clients and doubled jumps."""
    rows = _all_rows(spark, sf_dir)
    limits = {"hot_rows": 0, "slice_rows": 500}
    return _sessions(rows, LONG_IDLE_US, bs.LENGTH_US, 0, **limits)


@query(
    _recursive(
        with_views(
            """
select shop, client_id, session_us, count(*) as events, max(ts_us) as last_us
from fx_session group by shop, client_id, epoch, session_us
""",
            *STATE_VIEWS[:7],
            _awkward(_BURST),
            *_epoch_views("fx_awkward"),
            *_session_views(LONG_IDLE_US, bs.LENGTH_US),
        )
    )
)
def sessions_capped_awkward_rows(spark, sf_dir):
    """The length limit holds for rows without a browser id and for bursts, in slices too."""
    rows = _awkward_rows(spark, sf_dir, _BURST)
    limits = {"hot_rows": 0, "slice_rows": 300}
    made = _sessions(rows, LONG_IDLE_US, bs.LENGTH_US, 0, **limits)
    return made.select("shop", "client_id", "session_us", "events", "last_us")


@query(
    _recursive(
        with_views(
            "select shop, client_id, event_id, window_id from fx_window",
            *STATE_VIEWS,
            *_session_views(bs.IDLE_US, bs.LENGTH_US),
            WINDOWS,
        )
    )
)
def window_ids(spark, sf_dir):
    state = bs.browser_state(_all_rows(spark, sf_dir))
    return state.select("shop", "client_id", "event_id", "window_id")


@query(
    with_views(
        """
select shop, client_id, event_id, ts_us, distinct_id as from_id, post as to_id
from fx_identity where is_event and post <> '' and post <> distinct_id
union all
select shop, client_id, event_id, ts_us, known, login from fx_known
where not is_event and login <> '' and login <> known
""",
        *STATE_VIEWS,
        IDENTITY,
        KNOWN,
    )
)
def pixel_identity_links(spark, sf_dir):
    """Emails of checkouts and forms, and logins, that differ from who the browser was before."""
    t = bs.add_identity(bs.add_epochs(bs.timeline(_all_rows(spark, sf_dir))))
    return bs.identity_links(t.result())


@query(
    with_views(
        f"""
select shop, client_id, event_id, ts_us // 1000 as ms,
  {_sql_key('ts_us', "shop || '|' || client_id || '|0'")} as key
from fx_rows
""",
        *STATE_VIEWS[:6],
    )
)
def session_key(spark, sf_dir):
    rows = _all_rows(spark, sf_dir).where("is_event")
    key = bs.time_key(F.col("ts_us"), F.col("shop"), F.col("client_id"), F.lit(0))
    ms = F.conv(F.replace(F.substring(key, 1, 13), F.lit("-"), F.lit("")), 16, 10).cast("long")
    return rows.select("shop", "client_id", "event_id", ms.alias("ms"), key.alias("key"))


@query(
    with_views(
        """
select api_host, api_key, (place - 1) // 10 as batch_no, place, event_id from (
  select r.event_id, s.api_host, s.api_key, row_number() over (partition by s.api_host, s.api_key
      order by case when event_id % 11 > 0 then r.ts_us end nulls first, r.event_id) as place
  from fx_rows r join fx_shops s using (shop))
""",
        *STATE_VIEWS[:6],
    )
)
def capture_batches(spark, sf_dir):
    """Events numbered per host and key, ten to a batch; hot keys are numbered in slices.

    One event in eleven has no time.
    """
    rows = _all_rows(spark, sf_dir).where("is_event").select("shop", "ts_us", "event_id")
    rows = rows.withColumn("ts_us", F.when(F.col("event_id") % 11 > 0, F.col("ts_us")))
    settings = sample.pixel_settings(spark, sf_dir).select("shop", "api_host", "api_key")
    joined = lookup_join(rows, settings, "shop")
    numbered = envelope.numbered_batches(
        joined, ["api_host", "api_key"], ["ts_us", "event_id"], hot_rows=2000, slice_rows=1000
    )
    return numbered.select("api_host", "api_key", "batch_no", "place", "event_id")


# Time runs 400,000 times faster, so that buffers fill up and wait.
_FAST = 400_000
BUFFERED = (
    "fx_buffered",
    f"""
select shop, client_id, event_id, at_us, row_number() over (partition by {{keys}} order by at_us nulls first, event_id) as place
from (select r.*, case when event_id % 11 > 0 then ts_us // {_FAST} end as at_us from fx_rows r)""",
)
BUFFER_STARTS = (
    "fx_buffer_starts",
    """
select {keys}, 1::bigint as place, at_us from fx_buffered where place = 1
union all
select {same}, min(m.place), arg_min(coalesce(m.at_us, -2305843009213693952), m.place) from fx_buffer_starts s join fx_buffered m
  on {on} and m.place > s.place and m.place <= s.place + 10
  and (m.place = s.place + 10 or coalesce(m.at_us, -2305843009213693952) >= coalesce(s.at_us, -2305843009213693952) + 100000)
group by {same}, s.place""",
)


def _buffer_oracle(keys: str) -> str:
    names = keys.split(", ")
    parts = {
        "keys": keys,
        "same": ", ".join(f"s.{k}" for k in names),
        "on": " and ".join(f"m.{k} is not distinct from s.{k}" for k in names),
    }
    views = [(name, text.format(**parts)) for name, text in (BUFFERED, BUFFER_STARTS)]
    return _recursive(
        with_views(
            f"""
select m.shop, m.client_id, m.event_id, m.place, count(*) - 1 as batch_no from fx_buffered m join fx_buffer_starts s
  on {parts["on"]} and s.place <= m.place group by all
""",
            *STATE_VIEWS[:6],
            *views,
        )
    )


def _buffered(spark: SparkSession, sf_dir: str, keys: list[str], **limits: int) -> DataFrame:
    rows = _all_rows(spark, sf_dir).where("is_event").select("shop", "client_id", "event_id", "ts_us")
    at = F.when(F.col("event_id") % 11 > 0, F.floor(F.col("ts_us") / F.lit(_FAST)))
    batches = buffers.timed_batches(rows.withColumn("at_us", at), keys, ["at_us", "event_id"], "at_us", **limits)
    return batches.select("shop", "client_id", "event_id", "place", "batch_no")


@query(_buffer_oracle("shop, client_id"))
def timed_batches(spark, sf_dir):
    """Every browser's buffer: ten events, or what comes within 100 ms of the first."""
    return _buffered(spark, sf_dir, ["shop", "client_id"])


@query(_buffer_oracle("shop"))
def timed_batches_hot(spark, sf_dir):
    """The same with one buffer per shop, of which one has a third of all events, numbered in slices."""
    return _buffered(spark, sf_dir, ["shop"], hot_rows=200, slice_rows=100)
