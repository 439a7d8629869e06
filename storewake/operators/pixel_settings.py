"""Which browser events a shop has switched on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.operators.joins import lookup_join
from storewake.operators.shops import with_pixel_key

# Event names.
CHECKOUT_EVENTS = (
    "checkout_started",
    "checkout_completed",
    "checkout_shipping_info_submitted",
    "checkout_contact_info_submitted",
    "checkout_address_info_submitted",
    "payment_info_submitted",
)
CART_LINE_EVENTS = ("product_added_to_cart", "product_removed_from_cart")
DOM_EVENTS = ("clicked", "input_blurred", "input_changed")
HANDLED_EVENTS = (
    *CHECKOUT_EVENTS,
    *CART_LINE_EVENTS,
    *DOM_EVENTS,
    "page_viewed",
    "collection_viewed",
    "product_viewed",
    "cart_viewed",
    "search_submitted",
    "form_submitted",
)
# Names that an own setting can switch on. input_changed is not
# among them, and input_focused can be switched on but is handled nowhere.
SWITCHABLE_EVENTS = (
    "cart_viewed",
    "checkout_address_info_submitted",
    "checkout_completed",
    "checkout_contact_info_submitted",
    "checkout_shipping_info_submitted",
    "checkout_started",
    "clicked",
    "collection_viewed",
    "form_submitted",
    "input_blurred",
    "input_focused",
    "page_viewed",
    "payment_info_submitted",
    "product_added_to_cart",
    "product_removed_from_cart",
    "product_viewed",
    "search_submitted",
)


def text_list(json_text: Column) -> Column:
    """A JSON array of texts; anything else counts as empty."""
    parsed = F.from_json(json_text, "array<string>", {"mode": "PERMISSIVE"})
    is_array = F.ltrim(json_text).startswith("[")
    return F.coalesce(F.when(is_array, parsed), F.array())


def active_events(switches: Column, tracked_events: Column) -> Column:
    """Names switched on by their own setting 'true', then the tracked list, without repeats."""
    switched = F.filter(
        F.array(*[F.lit(n) for n in SWITCHABLE_EVENTS]),
        lambda n: F.element_at(switches, n).eqNullSafe("true"),
    )
    return F.array_union(switched, text_list(tracked_events))


def opted_out(switches: Column, name: Column) -> Column:
    """The event's own setting is the text 'false'; it wins over the tracked list."""
    return F.element_at(switches, name).eqNullSafe("false")


def pixel_shops(settings: DataFrame) -> DataFrame:
    """One row per shop whose pixel can send, with its list of active events.

    `settings` has shop, api_key, api_host, strategy, tracked_events, spec (text)
    and switches (map of event name to 'true' or 'false').
    """
    return with_pixel_key(settings).select(
        "shop",
        "api_key",
        "api_host",
        "strategy",
        "switches",
        active_events(F.col("switches"), F.col("tracked_events")).alias("active"),
        F.col("spec").eqNullSafe("true").alias("spec_enabled"),
    )


def subscribed_events(events: DataFrame, shops: DataFrame) -> DataFrame:
    """Handled events that their shop has active and not opted out of."""
    handled = events.where(F.col("name").isin(*HANDLED_EVENTS))
    joined = lookup_join(handled, shops, "shop")
    wanted = F.array_contains("active", F.col("name"))
    return joined.where(wanted & ~opted_out(F.col("switches"), F.col("name"))).drop(
        "active", "switches"
    )
