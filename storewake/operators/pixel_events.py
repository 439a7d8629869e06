"""Browser events to analytics events with their merged properties.

Input rows carry the shop columns of `pixel_settings.subscribed_events`, the
`context` of `page_context.join_context` and the identity and session columns
of `browser_state.browser_state`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storewake.functions.ids import event_uuid
from storewake.functions.objects import JsonObject, members_or_null, object_text
from storewake.functions.values import text_or_null
from storewake.operators import spec_events
from storewake.operators.page_context import context_conditions, context_object, spread
from storewake.operators.pixel_settings import CART_LINE_EVENTS, CHECKOUT_EVENTS, DOM_EVENTS

# Fixed value: reported with every event, in milliseconds.
SESSION_TIMEOUT_MS = 30 * 60 * 1000
# Fields of an element that only a form has.
FORM_FIELDS = ("action", "elements")

def _session(o: JsonObject) -> None:
    o.put("$session_id", F.col("session_id"))
    o.put("$configured_session_timeout_ms", F.lit(SESSION_TIMEOUT_MS))
    o.put("$window_id", F.col("window_id"))


def _page(o: JsonObject) -> None:
    o.put("client_id", F.col("client_id"))
    o.put("url", F.col("href"))
    o.put("$current_url", F.col("href"))


def _spec(o: JsonObject, name: str) -> JsonObject:
    return o.put_all(spec_events.spec_fields(name), when="spec")


def _start(schema: StructType, strict: bool, **more: Column) -> JsonObject:
    return context_object(schema, context_conditions(schema) | more, strict)


def _order_without_ids(schema: StructType, strict: bool) -> Column:
    """The order of an anonymous checkout: its id and its customer's are null, the rest stays.

    `strict` leaves nothing but the two.
    """
    bare = F.lit('{"customer":{"id":null},"id":null}')
    if strict:
        return bare
    none = F.lit(None).cast("string").alias("id")
    order = spread(schema, "checkout.order")
    customer = spread(schema, "checkout.order.customer")
    kept = [v.alias(n) for n, v in order.items() if n not in ("id", "customer")]
    theirs = [v.alias(n) for n, v in customer.items() if n != "id"]
    cleared = object_text(F.struct(*kept, F.struct(*theirs, none).alias("customer"), none))
    return F.when(F.col("checkout.order").isNull(), bare).otherwise(cleared)


def checkout_properties(schema: StructType, strict: bool = False) -> Column:
    """A checkout with all its fields; on anonymous rows the personal ones are null.

    The vocabulary fields of checkouts have names of their own.
    """
    o = _start(schema, strict)
    o.put_nulls("customer", "purchasingCompany", when="anonymous")
    o.put_nulls("cart")
    _page(o)
    _session(o)
    o.put_all(spread(schema, "checkout"))
    o.put_nulls("billingAddress", "email", when="anonymous")
    o.put_json("order", _order_without_ids(schema, strict), when="anonymous")
    o.put_nulls("phone", "shippingAddress", "smsMarketingPhone", when="anonymous")
    change = _redacted if strict else dict
    spec = spec_events.spec_text(F.col("name"), CHECKOUT_EVENTS, change)
    o.put_members(F.when(F.col("spec_enabled"), members_or_null(spec)))
    return o.text()


def _redacted(fields: spec_events.Fields) -> spec_events.Fields:
    """Without the order's id on anonymous rows; a checkout token in its place stays."""
    if "order_id" in fields and "checkout_id" in fields:
        fields["order_id"] = F.when(~F.col("anonymous"), fields["order_id"])
    return fields


def cart_line_properties(schema: StructType, strict: bool = False) -> Column:
    o = _start(schema, strict, line=F.col("cart_line").isNotNull())
    _page(o)
    _session(o)
    o.put_all(spread(schema, "cart_line.merchandise"), when="line")
    o.put("cost", F.col("cart_line.cost.totalAmount.amount"), when="line")
    o.put("quantity", F.col("cart_line.quantity"), when="line")
    return _spec(o, CART_LINE_EVENTS[0]).text()


def dom_properties(schema: StructType, strict: bool = False) -> Column:
    """Clicks and input changes know no page of their own: the page load's address stays."""
    o = _start(schema, strict, element=F.col("element").isNotNull())
    _session(o)
    o.put("client_id", F.col("client_id"))
    own = {n: v for n, v in spread(schema, "element").items() if n not in FORM_FIELDS}
    return o.put_all(own, when="element").text()


def page_view_properties(schema: StructType, strict: bool = False) -> Column:
    known = F.col("context.customer").isNotNull() & ~F.col("anonymous")
    o = _start(schema, strict, known=known)
    o.put_nulls("customer", "purchasingCompany", when="anonymous")
    o.put("$process_person_profile", F.lit(False), when="anonymous")
    _page(o)
    _session(o)
    o.put_all(spread(schema, "event_data"))
    o.put_json("$set", F.col("context.customer_text"), when="known")
    return o.text()


# The column that each browsing event spreads.
BROWSE_EVENTS = {
    "collection_viewed": "collection",
    "product_viewed": "product_variant",
    "cart_viewed": "cart",
    "search_submitted": "search_result",
}


def browse_properties(schema: StructType, name: str, strict: bool = False) -> Column:
    payload = BROWSE_EVENTS[name]
    o = _start(schema, strict, seen=F.col(payload).isNotNull())
    _page(o)
    _session(o)
    o.put_all(spread(schema, payload), when="seen")
    return _spec(o, name).text()


def form_email(elements: Column) -> Column:
    """Value of the first form field whose id or name speaks of an email."""
    named = F.filter(
        elements,
        lambda e: F.coalesce(e["id"], F.lit("")).rlike("(?i)email")
        | F.coalesce(e["name"], F.lit("")).rlike("(?i)email"),
    )
    return F.get(named, F.lit(0))["value"]


def form_body(elements: Column) -> Column:
    """Field values by name; unnamed fields are left out, the last of a name wins."""
    named = F.filter(elements, lambda e: F.coalesce(e["name"], F.lit("")) != "")
    later = F.transform(named, lambda e, i: F.slice(named, i + 2, F.size(named)))
    last = F.filter(
        F.arrays_zip(named.alias("field"), later.alias("later")),
        lambda z: ~F.exists(z["later"], lambda y: y["name"] == z["field"]["name"]),
    )
    return F.map_from_entries(
        F.transform(
            last,
            lambda z: F.struct(z["field"]["name"], F.coalesce(z["field"]["value"], F.lit(""))),
        )
    )


def form_properties(schema: StructType, strict: bool = False) -> Column:
    """A form; its contents are sent on anonymous rows too unless strict."""
    elements = F.col("element.elements")
    email = text_or_null(form_email(elements))
    o = _start(schema, strict, email=email.isNotNull() & ~F.col("anonymous"))
    _session(o)
    o.put_nulls("customer", "purchasingCompany", when="anonymous")
    o.put("client_id", F.col("client_id"))
    o.put("form", elements)
    o.put_json("form_body", F.to_json(form_body(elements)))
    o.put("action", F.col("element.action"))
    o.put_json("$set", object_text(F.struct(email.alias("email"))), when="email")
    if strict:
        o.put_nulls("form", "form_body", when="anonymous")
    return o.text()


def pixel_properties(schema: StructType, strict: bool = False) -> Column:
    """Properties of any handled event as JSON text, in one pass over all names.

    `schema` is that of the rows: whatever fields their payload objects have are spread.
    """
    name = F.col("name")
    result = F.when(name.isin(*CHECKOUT_EVENTS), checkout_properties(schema, strict))
    result = result.when(name.isin(*CART_LINE_EVENTS), cart_line_properties(schema, strict))
    result = result.when(name.isin(*DOM_EVENTS), dom_properties(schema, strict))
    result = result.when(name == "page_viewed", page_view_properties(schema, strict))
    for browse in BROWSE_EVENTS:
        result = result.when(name == browse, browse_properties(schema, browse, strict))
    return result.when(name == "form_submitted", form_properties(schema, strict))


def pixel_events(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The canonical event columns, with the session and window of each event."""
    return spec_events.rename_events(rows).select(
        "shop",
        "event",
        "distinct_id",
        pixel_properties(rows.schema, strict).alias("properties"),
        "timestamp",
        event_uuid(F.col("id")).alias("uuid"),
        "api_key",
        "api_host",
        F.col("event_id").alias("arrival_seq"),
        "name",
        "session_id",
        "window_id",
    )


def post_event_email() -> Column:
    """The email an event reveals about its sender, known from the next event on."""
    form = F.when(F.col("name") == "form_submitted", form_email(F.col("element.elements")))
    checkout = F.when(F.col("name").isin(*CHECKOUT_EVENTS), F.col("checkout.email"))
    return text_or_null(F.coalesce(checkout, form))
