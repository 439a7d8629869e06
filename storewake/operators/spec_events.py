"""Browser events to the common e-commerce vocabulary.

Each mapping gives the extra fields of an event as columns over its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.functions.objects import object_text
from storewake.functions.values import joined_or_null, number_or_null, text_or_null

# Browser event name and its name in the vocabulary.
EVENT_NAMES = {
    "page_viewed": "$pageview",
    "search_submitted": "Product List Filtered",
    "collection_viewed": "Product List Viewed",
    "product_viewed": "Product Viewed",
    "product_added_to_cart": "Product Added",
    "product_removed_from_cart": "Product Removed",
    "cart_viewed": "Cart Viewed",
    "checkout_started": "Checkout Started",
    "checkout_address_info_submitted": "Checkout Step Completed",
    "checkout_contact_info_submitted": "Checkout Step Completed",
    "checkout_shipping_info_submitted": "Checkout Step Completed",
    "payment_info_submitted": "Payment Info Entered",
    "checkout_completed": "Order Completed",
}

# Checkout steps in order; a step's number is its place.
CHECKOUT_STEPS = (
    "checkout_contact_info_submitted",
    "checkout_address_info_submitted",
    "checkout_shipping_info_submitted",
    "payment_info_submitted",
)
STEP_EVENTS = CHECKOUT_STEPS[:3]


Fields = dict[str, Column]


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def spec_name(name: Column) -> Column:
    """The vocabulary name, the name itself where there is none."""
    pairs = [F.lit(x) for pair in EVENT_NAMES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def rename_events(events: DataFrame) -> DataFrame:
    """Set `event` from `name` for shops that use the vocabulary."""
    renamed = F.when(F.col("spec_enabled"), spec_name(F.col("name"))).otherwise(F.col("name"))
    return events.withColumn("event", renamed)


def step_number(name: Column) -> Column:
    """1 to 4, 0 for other events."""
    return F.array_position(F.array(*[F.lit(s) for s in CHECKOUT_STEPS]), name).cast("int")


def _listed_product(variant: Column, index: Column) -> Column:
    return F.struct(
        _none().alias("category"),
        _none().alias("brand"),
        _none().alias("coupon"),
        text_or_null(variant["product"]["title"]).alias("name"),
        text_or_null(variant["image"]["src"]).alias("image_url"),
        (index + 1).alias("position"),
        variant["price"]["amount"].alias("price"),
        variant["id"].alias("product_id"),
        text_or_null(variant["sku"]).alias("sku"),
        text_or_null(variant["product"]["url"]).alias("url"),
        F.lit(1).alias("quantity"),
        text_or_null(variant["title"]).alias("variant"),
    )


def product_list_filtered() -> Fields:
    query = F.struct(F.lit("q").alias("type"), F.col("search_result.query").alias("value"))
    no_sorts = F.array().cast("array<struct<type: string, value: string>>")
    return {
        "list_id": _none(),
        "category": _none(),
        "filters": F.array(query),
        "sorts": no_sorts,
        "products": F.transform("search_result.productVariants", _listed_product),
    }


def product_list_viewed() -> Fields:
    return {
        "list_id": F.col("collection.id"),
        "category": _none(),
        "products": F.transform("collection.productVariants", _listed_product),
    }


def product_viewed() -> Fields:
    v = F.col("product_variant")
    return {
        "brand": _none(),
        "category": _none(),
        "coupon": _none(),
        "position": _none("int"),
        "image_url": text_or_null(v["image"]["src"]),
        "name": text_or_null(v["product"]["title"]),
        "price": number_or_null(v["price"]["amount"]),
        "value": number_or_null(v["price"]["amount"]),
        "product_id": text_or_null(v["product"]["id"]),
        "quantity": F.lit(1),
        "sku": text_or_null(v["sku"]),
        "url": text_or_null(v["product"]["url"]),
        "variant": text_or_null(v["title"]),
        "currency": text_or_null(v["price"]["currencyCode"]),
    }


def product_added_or_removed() -> Fields:
    """Every field is null when the event has no cart line."""
    line = F.col("cart_line")
    v = line["merchandise"]
    return {
        "brand": _none(),
        "cart_id": _none(),
        "category": _none(),
        "coupon": _none(),
        "position": _none("int"),
        "image_url": text_or_null(v["image"]["src"]),
        "name": text_or_null(v["product"]["title"]),
        "price": number_or_null(v["price"]["amount"]),
        "product_id": text_or_null(v["product"]["id"]),
        "quantity": number_or_null(line["quantity"]),
        "sku": text_or_null(v["sku"]),
        "url": text_or_null(v["product"]["url"]),
        "variant": text_or_null(v["title"]),
    }


def cart_viewed() -> Fields:
    """The name is the variant title here, and a price of 0 stays."""

    def product(line: Column, index: Column) -> Column:
        v = line["merchandise"]
        return F.struct(
            _none().alias("brand"),
            _none().alias("category"),
            _none().alias("coupon"),
            text_or_null(v["image"]["src"]).alias("image_url"),
            text_or_null(v["title"]).alias("name"),
            (index + 1).alias("position"),
            v["price"]["amount"].alias("price"),
            text_or_null(v["product"]["id"]).alias("product_id"),
            line["quantity"].alias("quantity"),
            text_or_null(v["sku"]).alias("sku"),
            text_or_null(v["product"]["url"]).alias("url"),
            text_or_null(v["title"]).alias("variant"),
        )

    return {
        "cart_id": text_or_null(F.col("cart.id")),
        "products": F.coalesce(F.transform("cart.lines", product), F.array()),
    }


def _titles(items: Column) -> Column:
    return F.transform(items, lambda item: item["title"])


def checkout_coupon() -> Column:
    return joined_or_null(_titles(F.col("checkout.discountApplications")))


def payment_method() -> Column:
    methods = F.transform("checkout.transactions", lambda t: t["paymentMethod"])
    return joined_or_null(methods)


def shipping_method() -> Column:
    """Several delivery options are joined by '?', as the sender does."""
    return joined_or_null(_titles(F.col("checkout.delivery.selectedDeliveryOptions")), "?")


def _checkout_products() -> Column:
    def product(line: Column, index: Column) -> Column:
        v = line["variant"]
        applied = F.transform(line["discountAllocations"], lambda a: a["discountApplication"])
        return F.struct(
            line["id"].alias("product_id"),
            text_or_null(v["sku"]).alias("sku"),
            _none().alias("category"),
            line["title"].alias("name"),
            _none().alias("brand"),
            F.coalesce(text_or_null(v["untranslatedTitle"]), text_or_null(v["title"])).alias(
                "variant"
            ),
            line["finalLinePrice"]["amount"].alias("price"),
            line["quantity"].alias("quantity"),
            joined_or_null(_titles(applied)).alias("coupon"),
            (index + 1).alias("position"),
            text_or_null(v["product"]["url"]).alias("url"),
            text_or_null(v["image"]["src"]).alias("image_url"),
        )

    return F.coalesce(F.transform("checkout.lineItems", product), F.array())


def _amount(path: str) -> Column:
    return number_or_null(F.col(f"checkout.{path}.amount"))


def _checkout_amounts() -> Fields:
    return {
        "revenue": _amount("subtotalPrice"),
        "shipping": _amount("shippingLine.price"),
        "tax": _amount("totalTax"),
        "discount": _amount("discountsAmount"),
        "coupon": checkout_coupon(),
        "currency": F.col("checkout.currencyCode"),
        "products": _checkout_products(),
    }


def checkout_started() -> Fields:
    """The checkout token takes the place of the order id."""
    return {
        "order_id": F.col("checkout.token"),
        "affiliation": F.col("shop"),
        "value": _amount("totalPrice"),
        **_checkout_amounts(),
    }


def order_completed() -> Fields:
    return {
        "checkout_id": text_or_null(F.col("checkout.token")),
        "order_id": text_or_null(F.col("checkout.order.id")),
        "affiliation": F.col("shop"),
        "subtotal": _amount("subtotalPrice"),
        "total": _amount("totalPrice"),
        **_checkout_amounts(),
    }


def _step_fields() -> Fields:
    return {
        "payment_method": payment_method(),
        "shipping_method": shipping_method(),
        "step": step_number(F.col("name")),
    }


def checkout_step_completed() -> Fields:
    return {"checkout_id": F.col("checkout.token"), **_step_fields()}


def payment_info_entered() -> Fields:
    return {
        "checkout_id": F.col("checkout.token"),
        "order_id": text_or_null(F.col("checkout.order.id")),
        **_step_fields(),
    }


# Which mapping serves which event names.
SPEC_MAPPINGS = (
    (("search_submitted",), product_list_filtered),
    (("collection_viewed",), product_list_viewed),
    (("product_viewed",), product_viewed),
    (("product_added_to_cart", "product_removed_from_cart"), product_added_or_removed),
    (("cart_viewed",), cart_viewed),
    (("checkout_started",), checkout_started),
    (STEP_EVENTS, checkout_step_completed),
    (("payment_info_submitted",), payment_info_entered),
    (("checkout_completed",), order_completed),
)


def as_struct(fields: Fields) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def spec_fields(name: str) -> Fields:
    """The extra fields of an event name, none for names without a mapping."""
    for names, mapping in SPEC_MAPPINGS:
        if name in names:
            return mapping()
    return {}


def spec_text(
    name: Column,
    only: Sequence[str] | None = None,
    change: Callable[[Fields], Fields] = lambda fields: fields,
) -> Column:
    """The extra fields as JSON text, '{}' for names without a mapping; one pass over all names.

    `only` limits the names that can occur, `change` adapts the fields.
    """
    result = F
    for names, mapping in SPEC_MAPPINGS:
        if only is None or set(names) & set(only):
            result = result.when(name.isin(*names), object_text(as_struct(change(mapping()))))
    return result.otherwise(F.lit("{}"))
