"""Browser events as a stream, from landed payloads to the sink.

Two queries, so that heavy payloads never go through Python state:

1. events meet the context of their page load in a stream-stream join with event-time
   bounds and are written to a table by day. An event whose load does not come in
   time is written without a context: an orphan.
2. The narrow part of that table and the logins of page loads feed the keyed state
   of identity, sessions and windows. Each micro-batch of it fetches the
   payloads of its own events from the table (by day and key), maps them to
   properties and hands the events to a writer.

Rows that come too late for the state are written aside and counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from storewake.operators import pixel_events, pixel_settings
from storewake.operators.browser_state import KEYS
from storewake.operators.page_context import page_contexts
from storewake.plans.pixel import login_rows, with_consent
from storewake.session import land
from storewake.streaming.session_stream import stream_browser_state, with_event_time
from storewake.streaming.sink import batch_writer, start_sink

LOAD_KEYS = ("shop", "client_id", "page_load_id")
STATE_COLUMNS = (
    "event_id", "ts_us", "reset", "epoch", "session_us", "distinct_id", "session_id", "new_session", "window_id",
)


def join_page_loads(
    events: DataFrame,
    contexts: DataFrame,
    lateness: str = "10 minutes",
    page_life: str = "1 day",
    early: str = "1 minute",
) -> DataFrame:
    """Every event with the `context` columns of its page load, or with nulls once none can come any more.

    An event belongs to a load from `early` before it until `page_life` after it. Rows are kept in state
    for that time and the lateness; both sides may be late by `lateness`.
    """
    left = with_event_time(events, lateness)
    theirs = {k: f"_load_{k}" for k in LOAD_KEYS}
    loaded = F.timestamp_micros("context.loaded_us")
    right = contexts.withColumnsRenamed(theirs).withColumn("_load_at", loaded).withWatermark("_load_at", lateness)
    on = [F.col(k) == F.col(t) for k, t in theirs.items()]
    on.append(F.col("_at") >= F.col("_load_at") - F.expr(f"interval {early}"))
    on.append(F.col("_at") <= F.col("_load_at") + F.expr(f"interval {page_life}"))
    return left.join(right, on, "left_outer").drop("_at", "_load_at", *theirs.values())


def land_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write rows by the day of `ts_us`; every row once, whatever fails in between."""
    dated = rows.withColumn("day", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd"))
    writer = dated.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
    return writer.option("path", path).outputMode("append").trigger(**trigger).start()


def orphans(landed: DataFrame) -> DataFrame:
    """The events that were written without a context."""
    return landed.where(F.col("context").isNull())


def state_input(landed: DataFrame, contexts: DataFrame, lateness: str) -> DataFrame:
    """The rows of the keyed state: events with a context, and logins on page loads.

    Each side has a watermark of its own; the state follows the slower one.
    """
    with_context = landed.where(F.col("context").isNotNull())
    none = F.lit(None).cast("string")
    events = with_context.select(
        *KEYS, "tab_id", "event_id", "ts_us", F.lit(True).alias("is_event"), "anonymous",
        none.alias("login_email"), pixel_events.post_event_email().alias("post_email"),
    )
    timed_loads = with_event_time(contexts, lateness, F.col("context.loaded_us"))
    logins = login_rows(timed_loads, "_at").select(
        *KEYS, none.alias("tab_id"), "event_id", "ts_us", "is_event", "anonymous", "login_email",
        none.alias("post_email"), "_at",
    )
    return with_event_time(events, lateness).unionByName(logins)


def payload_writer(
    payloads: str, write: Callable[[DataFrame, int], None], late: str, strict: bool = False
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: state rows become canonical events and go to `write`; late rows go aside.

    Payloads are read from the days that the micro-batch has events of. Copies of an event that
    landed twice share their payload, and both stay.
    """
    aside = batch_writer(late, None)

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            aside(rows.where("late").drop("late"), batch_id)
            day = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd")
            state = rows.where("not late").select(*KEYS, *STATE_COLUMNS, day.alias("day"))
            days = state.agg(F.min("day"), F.max("day")).first()
            landed = rows.sparkSession.read.parquet(payloads).where(F.col("context").isNotNull())
            landed = landed.where(F.col("day").cast("string").between(F.lit(days[0]), F.lit(days[1])))
            keys = [*KEYS, "day", "event_id", "ts_us"]
            whole = landed.withColumn("day", F.col("day").cast("string")).dropDuplicates(keys)
            write(land(pixel_events.pixel_events(state.join(whole, keys), strict)), batch_id)
        finally:
            rows.unpersist()

    return handle


class BrowserStream:
    """The two queries over streams of browser events and page loads, with `settings` as the static side."""

    def __init__(
        self,
        events: DataFrame,
        loads: DataFrame,
        settings: DataFrame,
        folder: str,
        lateness: str = "10 minutes",
        page_life: str = "1 day",
        state_lateness: str | None = None,
        strict: bool = False,
        **state,
    ):
        """`state_lateness` (by default `lateness`) is how far the joined events may be out of order;
        `state` goes to `stream_browser_state`."""
        self.spark = events.sparkSession
        self.folder, self.strict, self.state = folder, strict, state
        self.state_lateness = state_lateness or lateness
        shops = pixel_settings.pixel_shops(settings)
        self.contexts = with_consent(page_contexts(loads), shops)
        wanted = pixel_settings.subscribed_events(events, shops)
        self.joined = join_page_loads(wanted, self.contexts, lateness, page_life)

    @property
    def payloads(self) -> str:
        return f"{self.folder}/payloads"

    @property
    def late(self) -> str:
        return f"{self.folder}/late"

    def start_join(self, **trigger) -> StreamingQuery:
        return land_stream(self.joined, self.payloads, f"{self.folder}/join-checkpoint", **trigger)

    def state_stream(self, files_per_trigger: int = 1000) -> DataFrame:
        reader = self.spark.readStream.schema(_landed_schema(self.joined))
        landed = reader.option("maxFilesPerTrigger", files_per_trigger).parquet(self.payloads)
        return stream_browser_state(state_input(landed, self.contexts, self.state_lateness), **self.state)

    def start_events(
        self, path: str, write: Callable[[DataFrame, int], None], files_per_trigger: int = 1000, **trigger
    ) -> StreamingQuery:
        """`write` takes the canonical events of a micro-batch, for instance a `sink` writer into `path`."""
        handler = payload_writer(self.payloads, write, self.late, self.strict)
        return start_sink(
            self.state_stream(files_per_trigger), path, f"{self.folder}/state-checkpoint", write=handler, **trigger
        )


def _landed_schema(joined: DataFrame) -> StructType:
    return joined.withColumn("day", F.lit("")).schema
