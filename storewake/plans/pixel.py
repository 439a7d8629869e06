"""The browser event pipeline as one event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewake.functions.objects import object_text
from storewake.operators import pixel_events, pixel_settings
from storewake.operators.agents import with_agents
from storewake.operators.browser_state import (
    add_epochs,
    add_identity,
    browser_state,
    identity_links,
    timeline,
)
from storewake.operators.joins import lookup_join
from storewake.operators.page_context import bare_contexts, join_context, narrow_contexts, with_contexts
from storewake.operators.server_events import IDENTIFY
from storewake.operators.shops import is_anonymous


def with_consent(contexts: DataFrame, shops: DataFrame) -> DataFrame:
    """Page loads whose shop has a working pixel, with `anonymous` from strategy and consent."""
    known = lookup_join(contexts, shops.select("shop", "strategy"), "shop")
    allowed = F.col("context.analytics_allowed")
    return known.withColumn("anonymous", is_anonymous(F.col("strategy"), allowed)).drop("strategy")


def contexts_of(loads: DataFrame, shops: DataFrame) -> DataFrame:
    """What contexts are made of, with consent; `with_contexts` makes them once the rows are where they stay."""
    return with_consent(bare_contexts(loads, with_agents), shops)


def consents_of(loads: DataFrame, shops: DataFrame) -> DataFrame:
    """The part of the contexts that identity and sessions need."""
    return with_consent(narrow_contexts(loads), shops)


def context_rows(events: DataFrame, loads: DataFrame, settings: DataFrame) -> DataFrame:
    """Subscribed events with their context: the input of the property mappings."""
    shops = pixel_settings.pixel_shops(settings)
    wanted = pixel_settings.subscribed_events(events, shops)
    return with_contexts(join_context(wanted, contexts_of(loads, shops)))


def login_rows(contexts: DataFrame, *more: str) -> DataFrame:
    """The page loads that bring a login email, as rows of the timeline."""
    return contexts.where(F.col("context.customer.email").isNotNull()).select(
        "shop",
        "client_id",
        *more,
        F.lit(-1).cast("long").alias("event_id"),
        F.col("context.loaded_us").alias("ts_us"),
        "anonymous",
        F.lit(False).alias("is_event"),
        F.col("context.customer.email").alias("login_email"),
    )


def state_rows(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Events and page loads on one timeline: a load can bring a login email.

    Besides the state columns a load row only carries nulls.
    """
    post = pixel_events.post_event_email()
    none = F.lit(None).cast("string")
    stated = rows.withColumns(
        {"is_event": F.lit(True), "login_email": none, "post_email": post}
    )
    logins = login_rows(contexts, "page_load_id")
    return stated.unionByName(logins, allowMissingColumns=True)


def pixel_event_table(
    events: DataFrame,
    loads: DataFrame,
    settings: DataFrame,
    strict: bool = False,
    **limits: int,
) -> DataFrame:
    """Every event the subscribed browser events give rise to.

    `strict` also removes personal fields that the sender leaves on anonymous
    events; `limits` goes to `browser_state`.
    """
    shops = pixel_settings.pixel_shops(settings)
    contexts = contexts_of(loads, shops)
    rows = join_context(pixel_settings.subscribed_events(events, shops), contexts)
    # The logins need little of a load, and the rows in state do without the texts of their contexts.
    state = browser_state(state_rows(rows, consents_of(loads, shops)), **limits)
    return pixel_events.pixel_events(with_contexts(state), strict)


def pixel_identify_table(
    events: DataFrame, loads: DataFrame, settings: DataFrame, **limits: int
) -> DataFrame:
    """The person links of browsers as events: a checkout's or form's email, or a login.

    The event belongs to the email and names the id that the browser had before.
    It needs only the narrow part of the contexts.
    """
    shops = pixel_settings.pixel_shops(settings)
    contexts = consents_of(loads, shops)
    rows = join_context(pixel_settings.subscribed_events(events, shops), contexts)
    state = add_identity(add_epochs(timeline(state_rows(rows, contexts), **limits))).result()
    links = lookup_join(identity_links(state), settings.select("shop", "api_key", "api_host"), "shop")
    return links.select(
        "shop",
        F.lit(IDENTIFY).alias("event"),
        F.col("to_id").alias("distinct_id"),
        object_text(F.struct(F.col("from_id").alias("$anon_distinct_id"))).alias("properties"),
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(None).cast("string").alias("uuid"),
        "api_key",
        "api_host",
        F.col("event_id").alias("arrival_seq"),
    )
