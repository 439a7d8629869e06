"""Order, refund and customer payloads to analytics events.

Payload rows already carry the shop columns of `operators.shops.with_shop`.
A Mapping says what one kind of event takes from such a row. `typed_events`
gives one kind with its properties as a struct; `event_table` gives several
kinds in one pass over the rows, with the properties as JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.functions import ids
from storewake.functions.objects import object_text
from storewake.functions.values import (
    first_text,
    id_text,
    join_text,
    joined_or_null,
    number_or_null,
    parse_number,
    parse_spend,
    parse_truthy_number,
    text_or_null,
)
from storewake.operators.shops import identify_allowed

IDENTIFY = "$identify"
ALIAS = "$create_alias"


def _text(name: str) -> Column:
    return text_or_null(F.col(name))


@dataclass(frozen=True)
class Mapping:
    """One kind of event: when a row gives rise to it, and what it holds.

    A sparse mapping leaves null properties out of the JSON text.
    """

    event: str
    properties: Column
    timestamp: Column
    uuid: Column | None = None
    when: Column | None = None
    sparse: bool = False

    def uuid_or_null(self) -> Column:
        return F.lit(None).cast("string") if self.uuid is None else self.uuid

    def text(self) -> Column:
        return F.to_json(self.properties) if self.sparse else object_text(self.properties)


def only(condition: Column, mapping: Mapping) -> Mapping:
    """The mapping for the rows that meet a condition."""
    return replace(mapping, when=condition if mapping.when is None else condition & mapping.when)


def typed_events(rows: DataFrame, mapping: Mapping) -> DataFrame:
    wanted = rows if mapping.when is None else rows.where(mapping.when)
    return wanted.select(
        "shop",
        F.lit(mapping.event).alias("event"),
        "distinct_id",
        mapping.properties.alias("properties"),
        mapping.timestamp.alias("timestamp"),
        mapping.uuid_or_null().alias("uuid"),
        "api_key",
        "api_host",
        "arrival_seq",
    )


def event_table(rows: DataFrame, *mappings: Mapping) -> DataFrame:
    """All events the rows give rise to; the rows are read once.

    Rows of a stream keep the time of their arrival.
    """

    def entry(m: Mapping) -> Column:
        event = F.struct(
            F.lit(m.event).alias("event"),
            m.text().alias("properties"),
            m.timestamp.alias("timestamp"),
            m.uuid_or_null().alias("uuid"),
        )
        return event if m.when is None else F.when(m.when, event)

    entries = F.array_compact(F.array(*[entry(m) for m in mappings]))
    arrived = [c for c in ("arrived_at",) if c in rows.columns]
    kept = ("shop", "distinct_id", "api_key", "api_host", "arrival_seq", *arrived)
    # An inner explode would evaluate the entries a second time to filter empty ones.
    opened = rows.select(*kept, entries.alias("entries")).select(
        *kept, F.explode_outer("entries").alias("e")
    )
    return opened.where(F.col("e").isNotNull()).select(
        "shop",
        "e.event",
        "distinct_id",
        "e.properties",
        "e.timestamp",
        "e.uuid",
        "api_key",
        "api_host",
        "arrival_seq",
        *arrived,
    )


def with_order_person(orders: DataFrame) -> DataFrame:
    """Add distinct_id and drop the orders that have none."""
    return orders.withColumn("distinct_id", ids.order_person_id()).where(
        F.col("distinct_id").isNotNull()
    )


def not_web() -> Column:
    """Web orders are left to the browser events; a missing source is not web."""
    return ~F.col("source_name").eqNullSafe("web")


def non_web(orders: DataFrame) -> DataFrame:
    return orders.where(not_web())


def _order_codes() -> Column:
    return F.transform("discount_codes", lambda code: code["code"])


def order_coupon() -> Column:
    """All codes of an order; '' when the only code is null."""
    return joined_or_null(_order_codes())


def _line_coupon(line: Column) -> Column:
    """A discounted line carries the codes of the whole order."""
    return F.when(F.size(line["discount_allocations"]) > 0, text_or_null(join_text(_order_codes())))


def order_products() -> Column:
    nothing = F.lit(None).cast("string")

    def product(line: Column, index: Column) -> Column:
        return F.struct(
            id_text(line["product_id"]).alias("product_id"),
            id_text(line["variant_id"]).alias("variant_id"),
            text_or_null(line["sku"]).alias("sku"),
            nothing.alias("category"),
            text_or_null(line["title"]).alias("name"),
            text_or_null(line["vendor"]).alias("brand"),
            text_or_null(line["variant_title"]).alias("variant"),
            parse_number(line["price"]).alias("price"),
            number_or_null(line["quantity"]).alias("quantity"),
            _line_coupon(line).alias("coupon"),
            (index + 1).alias("position"),
            nothing.alias("url"),
            nothing.alias("image_url"),
        )

    return F.coalesce(F.transform("line_items", product), F.array())


def order_completed_mapping() -> Mapping:
    """Non-web orders as "Order Completed"."""
    subtotal = parse_number(F.col("subtotal_price"))
    properties = F.struct(
        _text("checkout_token").alias("checkout_id"),
        F.col("id").cast("string").alias("order_id"),
        number_or_null(F.col("order_number")).alias("order_number"),
        _text("name").alias("order_name"),
        F.col("shop").alias("affiliation"),
        subtotal.alias("subtotal"),
        parse_number(F.col("total_price")).alias("total"),
        subtotal.alias("revenue"),
        parse_number(F.col("total_shipping_price_set.shop_money.amount")).alias("shipping"),
        parse_number(F.col("total_tax")).alias("tax"),
        parse_number(F.col("total_discounts")).alias("discount"),
        order_coupon().alias("coupon"),
        _text("currency").alias("currency"),
        _text("source_name").alias("source_name"),
        _text("financial_status").alias("financial_status"),
        _text("fulfillment_status").alias("fulfillment_status"),
        F.col("payment_gateway_names").alias("payment_gateway_names"),
        _text("tags").alias("tags"),
        _text("referring_site").alias("referring_site"),
        _text("landing_site").alias("landing_site"),
        F.col("customer.orders_count").alias("customer_orders_count"),
        _text("presentment_currency").alias("presentment_currency"),
        F.lit("server").alias("event_source"),
        order_products().alias("products"),
    )
    return Mapping(
        "Order Completed",
        properties,
        F.col("created_at"),
        ids.order_completed_uuid(F.col("shop"), F.col("checkout_token")),
        when=not_web(),
    )


def order_completed(orders: DataFrame) -> DataFrame:
    return typed_events(with_order_person(orders), order_completed_mapping())


def order_updated_mapping() -> Mapping:
    properties = F.struct(
        F.col("id").cast("string").alias("order_id"),
        number_or_null(F.col("order_number")).alias("order_number"),
        _text("name").alias("order_name"),
        _text("financial_status").alias("financial_status"),
        _text("fulfillment_status").alias("fulfillment_status"),
        parse_truthy_number(F.col("total_price")).alias("total"),
        _text("currency").alias("currency"),
        _text("source_name").alias("source_name"),
        F.col("shop").alias("affiliation"),
    )
    return Mapping(
        "Order Updated",
        properties,
        F.col("updated_at"),
        ids.order_updated_uuid(F.col("shop"), F.col("id"), F.col("updated_at")),
    )


def order_updated(orders: DataFrame) -> DataFrame:
    return typed_events(with_order_person(orders), order_updated_mapping())


def order_cancelled_mapping() -> Mapping:
    """No stable id: a repeated notice is a second event."""
    properties = F.struct(
        F.col("id").cast("string").alias("order_id"),
        number_or_null(F.col("order_number")).alias("order_number"),
        _text("name").alias("order_name"),
        parse_number(F.col("total_price")).alias("total"),
        _text("currency").alias("currency"),
        _text("cancel_reason").alias("cancel_reason"),
        _text("cancelled_at").alias("cancelled_at"),
        F.col("shop").alias("affiliation"),
        _text("source_name").alias("source_name"),
    )
    when = F.coalesce(_text("cancelled_at"), F.col("updated_at"))
    return Mapping("Order Cancelled", properties, when)


def order_cancelled(orders: DataFrame) -> DataFrame:
    return typed_events(with_order_person(orders), order_cancelled_mapping())


def _refund_amount(line: Column) -> Column:
    """The amount text decides when it is there, even when it is no number."""
    amount = line["subtotal_set"]["shop_money"]["amount"]
    return F.when(amount.isNotNull(), parse_number(amount)).otherwise(
        F.when(~F.isnan(line["subtotal"]), line["subtotal"])
    )


def refund_products() -> Column:
    def product(line: Column) -> Column:
        item = line["line_item"]
        return F.struct(
            id_text(item["product_id"]).alias("product_id"),
            text_or_null(item["sku"]).alias("sku"),
            text_or_null(item["title"]).alias("name"),
            text_or_null(item["variant_title"]).alias("variant"),
            text_or_null(item["vendor"]).alias("brand"),
            number_or_null(line["quantity"]).alias("quantity"),
            _refund_amount(line).alias("subtotal"),
        )

    return F.coalesce(F.transform("refund_line_items", product), F.array())


def refund_total() -> Column:
    """Sum of the line amounts, null when it is 0."""
    amounts = F.transform(
        F.coalesce("refund_line_items", F.array()),
        lambda line: F.coalesce(_refund_amount(line), F.lit(0.0)),
    )
    return number_or_null(F.aggregate(amounts, F.lit(0.0), lambda total, a: total + a))


def with_refund_email(refunds: DataFrame) -> DataFrame:
    """The first email found is the person; a refund without one is dropped.

    Placeholder texts are not refused here, unlike for orders.
    """
    return refunds.withColumn("distinct_id", refund_person_id()).where(F.col("distinct_id").isNotNull())


def refund_person_id() -> Column:
    return ids.normal_email(first_text(F.col("customer.email"), F.col("order.email"), F.col("email")))


def order_refunded_mapping() -> Mapping:
    properties = F.struct(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("id").cast("string").alias("refund_id"),
        refund_total().alias("total"),
        _text("note").alias("note"),
        F.col("shop").alias("affiliation"),
        refund_products().alias("products"),
    )
    return Mapping("Order Refunded", properties, F.col("created_at"))


def order_refunded(refunds: DataFrame) -> DataFrame:
    return typed_events(with_refund_email(refunds), order_refunded_mapping())


def _person_set(person: str, address: Column) -> list[Column]:
    p = f"{person}." if person else ""
    return [
        _text(f"{p}email").alias("email"),
        _text(f"{p}first_name").alias("first_name"),
        _text(f"{p}last_name").alias("last_name"),
        _text(f"{p}phone").alias("phone"),
        F.col(f"{p}orders_count").alias("orders_count"),
        parse_spend(F.col(f"{p}total_spent")).alias("total_spent"),
        _text(f"{p}tags").alias("tags"),
        text_or_null(address["city"]).alias("city"),
        text_or_null(address["country"]).alias("country"),
        text_or_null(address["country_code"]).alias("country_code"),
    ]


def order_identify_mapping(timestamp: str = "created_at") -> Mapping:
    """Person updates of orders; a null field stands for a field that is not sent."""
    address = F.coalesce("customer.default_address", "billing_address")
    properties = F.struct(
        F.struct(
            *_person_set("customer", address),
            F.col("created_at").alias("last_order_date"),
            F.col("id").alias("last_order_id"),
        ).alias("$set"),
        F.struct(
            F.col("created_at").alias("first_order_date"),
            F.col("id").alias("first_order_id"),
        ).alias("$set_once"),
    )
    allowed = identify_allowed(F.col("strategy"))
    return Mapping(IDENTIFY, properties, F.col(timestamp), when=allowed, sparse=True)


def order_identify(orders: DataFrame, timestamp: str = "created_at") -> DataFrame:
    return typed_events(with_order_person(orders), order_identify_mapping(timestamp))


def with_customer_person(customers: DataFrame) -> DataFrame:
    return customers.withColumn("distinct_id", customer_person_id()).where(F.col("distinct_id").isNotNull())


def customer_person_id() -> Column:
    return ids.person_id(F.col("email"), customer_id=F.col("id"))


def customer_identify_mapping() -> Mapping:
    properties = F.struct(
        F.struct(
            *_person_set("", F.col("default_address")),
            _text("state").alias("customer_state"),
        ).alias("$set"),
        F.struct(F.col("created_at").alias("shopify_customer_created_at")).alias("$set_once"),
    )
    allowed = identify_allowed(F.col("strategy"))
    return Mapping(IDENTIFY, properties, F.col("updated_at"), when=allowed, sparse=True)


def customer_identify(customers: DataFrame) -> DataFrame:
    return typed_events(with_customer_person(customers), customer_identify_mapping())


def alias_events(links: DataFrame) -> DataFrame:
    """Links (distinct_id, alias) that merge two ids of one person."""
    properties = F.struct(F.col("alias").alias("alias"))
    return typed_events(links, Mapping(ALIAS, properties, F.lit(None).cast("string")))
