"""Identifiers: person ids, stable event ids and session keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storewake.functions.values import js_trim, text_or_null

# They decide results and must not change.
EVENT_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
CUSTOMER_ID_PREFIX = "shopify_customer_"
SHOP_DOMAIN_SUFFIX = ".myshopify.com"
BLOCKED_PERSON_IDS = (
    "",
    "anonymous",
    "guest",
    "null",
    "undefined",
    "none",
    "unknown",
    "distinctid",
    "distinct_id",
    "id",
    "not_authenticated",
    "email",
    "true",
    "false",
)

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def normal_email(email: Column) -> Column:
    return js_trim(F.lower(email))


def is_person_id(email: Column) -> Column:
    """True for a usable id; placeholders such as 'guest' are refused. Never null."""
    return F.coalesce(~normal_email(email).isin(*BLOCKED_PERSON_IDS), F.lit(False))


def _customer_id(customer_id: Column) -> Column:
    return F.when(customer_id != 0, F.concat(F.lit(CUSTOMER_ID_PREFIX), customer_id.cast("string")))


def person_id(*emails: Column, customer_id: Column) -> Column:
    """The first usable email, else an id made from the customer number, else null."""
    usable = [F.when(is_person_id(e), normal_email(e)) for e in emails]
    return F.coalesce(*usable, _customer_id(customer_id))


def order_person_id(order: str = "") -> Column:
    prefix = f"{order}." if order else ""
    return person_id(
        F.col(f"{prefix}customer.email"),
        F.col(f"{prefix}email"),
        customer_id=F.col(f"{prefix}customer.id"),
    )


def uuid5(name: Column, namespace: str = EVENT_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a text, from built-in hashing only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    return _uuid_text(digest, "5")


def _uuid_text(hex_digits: Column, version: str) -> Column:
    """The first 32 hex digits as a UUID with its version and variant digits set."""
    part = lambda first, size: F.substring(hex_digits, first, size)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit(f"-{version}"), part(14, 3), F.lit("-"),
        variant, part(18, 3), F.lit("-"), part(21, 12),
    )


def order_completed_uuid(shop: Column, checkout_token: Column) -> Column:
    """Same for every retry of one checkout; null without a token."""
    token = text_or_null(checkout_token)
    return F.when(token.isNotNull(), uuid5(F.concat_ws(":", shop, token, F.lit("Order Completed"))))


def order_updated_uuid(shop: Column, order_id: Column, updated_at: Column) -> Column:
    """Same for every retry of one status change; null without a change time."""
    changed = text_or_null(updated_at)
    name = F.concat_ws(":", shop, order_id.cast("string"), changed, F.lit("Order Updated"))
    return F.when(changed.isNotNull(), uuid5(name))


def event_uuid(event_id: Column) -> Column:
    """The id if it is a UUID, else what follows its first '-' if that is one."""
    rest = F.substr(event_id, F.instr(event_id, "-") + F.lit(1))
    return F.when(event_id.rlike(_UUID), event_id).when(rest.rlike(_UUID), rest)


def time_key(start_us: Column, *parts: Column) -> Column:
    """A version 7 shaped UUID: 48 bits of milliseconds, then a hash of the parts.

    Reruns give the same key, unlike a random one.
    """
    millis = F.lpad(F.lower(F.hex(F.floor(start_us / F.lit(1000)).cast("long"))), 12, "0")
    tail = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], start_us.cast("string")))
    return F.when(start_us.isNotNull(), _uuid_text(F.concat(millis, tail), "7"))
