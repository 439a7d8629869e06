"""What a page load knows: address, referrer, screen, device, customer and flags."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storewake.functions import urls
from storewake.functions.device import BROWSERS, DEVICE_TYPES, SYSTEMS, AgentRule, device_struct
from storewake.functions.objects import JsonObject, object_text, quoted
from storewake.operators.joins import HOT_ROWS, detail_join

TEXTS = ("base", "person_set", "person_bare", "customer_text")
KEYS = ("shop", "client_id", "page_load_id")
# Facts that only the device is made of.
UNUSED = ("user_agent",)


def with_device(
    loads: DataFrame,
    browsers: Sequence[AgentRule] = BROWSERS,
    systems: Sequence[AgentRule] = SYSTEMS,
    device_types: Sequence[AgentRule] = DEVICE_TYPES,
) -> DataFrame:
    """Add `device`; runs once per page load, not once per event."""
    return loads.withColumn(
        "device", device_struct(F.col("user_agent"), browsers, systems, device_types)
    )


def working_loads(loads: DataFrame) -> DataFrame:
    """A load whose address is no absolute URL never starts its pixel: it has no events."""
    return loads.where(urls.url_host(F.col("href")).isNotNull())


def with_page_facts(loads: DataFrame) -> DataFrame:
    """Add the columns derived from the page address and the referrer."""
    return loads.withColumns(
        {
            "host": urls.url_host(F.col("href")),
            "pathname": urls.url_path(F.col("href")),
            "referrer_shown": urls.referrer_or_direct(F.col("referrer")),
            "referring_domain": urls.referring_domain(F.col("referrer")),
            "search_engine": urls.search_engine(F.col("referrer")),
            "campaign": urls.campaign_struct(F.col("href"), ""),
        }
    )


def _flag_names(flags: Column) -> Column:
    """Flag names in language order, as the sender sorts them."""
    names = F.transform(F.map_keys(flags), lambda k: F.collate(k, "UNICODE"))
    return F.transform(F.array_sort(names), lambda k: F.collate(k, "UTF8_BINARY"))


def active_flags(flags: Column) -> Column:
    """Names of the flags whose variant is not false, null when there is none."""
    names = F.filter(_flag_names(flags), lambda k: F.element_at(flags, k) != "false")
    return F.when(F.size(names) > 0, names)


def flag_members(flags: Column) -> Column:
    """The flags as inside of a JSON object: one member per flag and the active list."""

    def member(name: Column) -> Column:
        value = F.element_at(flags, name)
        shown = F.when(value.isin("true", "false"), value).otherwise(quoted(value))
        return F.concat(quoted(F.concat(F.lit("$feature/"), name)), F.lit(":"), shown)

    listed = F.to_json(active_flags(flags))
    active = F.when(listed.isNotNull(), F.concat(F.lit('"$active_feature_flags":'), listed))
    members = F.array_join(F.transform(_flag_names(flags), member), ",")
    return F.when(F.size(flags) > 0, F.concat_ws(",", members, active))


def _person_facts(prefix: str) -> dict[str, Column]:
    """Device and page facts that describe the person, first or latest."""
    return {
        f"${prefix}browser": F.col("device.browser"),
        f"${prefix}browser_version": F.col("device.browser_version"),
        f"${prefix}os": F.col("device.os"),
        f"${prefix}os_version": F.col("device.os_version"),
        f"${prefix}device_type": F.col("device.device_type"),
        f"${prefix}current_url": F.col("href"),
        f"${prefix}pathname": F.col("pathname"),
        f"${prefix}referrer": F.col("referrer_shown"),
        f"${prefix}referring_domain": F.col("referring_domain"),
    }


def _campaign(prefix: str, struct: str = "campaign") -> dict[str, Column]:
    return {f"${prefix}{p}": F.col(f"{struct}.{p}") for p in urls.CAMPAIGN_PARAMS}


def field_names(schema: StructType, path: str) -> list[str]:
    """All fields of a payload object: payloads are open, so the rows' own schema names them.

    A path that the schema does not have has none.
    """
    for part in path.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return []
        schema = schema[part].dataType
    return schema.names if isinstance(schema, StructType) else []


def spread(schema: StructType, path: str) -> dict[str, Column]:
    """Every field of a payload object as a property of its own."""
    return {n: F.col(path)[n] for n in field_names(schema, path)}


def with_texts(loads: DataFrame) -> DataFrame:
    """Add what all events of a load share as JSON text, so that it is written once per load.

    base: members no event replaces. person_set: the person update of the load;
    person_bare is the same without the customer's own fields.
    """
    conditions = {"customer": F.col("customer").isNotNull()}
    first = JsonObject(conditions).put_all(_campaign("initial_"))
    first.put_all(_person_facts("initial_"))
    latest = JsonObject(conditions).put_all(_campaign(""))
    customer = spread(loads.schema, "customer")
    latest.put_all(customer, when="customer").put_all(_person_facts(""))
    base = JsonObject(conditions)
    base.put_members(flag_members(F.col("feature_flags")))
    base.put_all(
        {
            "$os": F.col("device.os"),
            "$os_version": F.col("device.os_version"),
            "$browser": F.col("device.browser"),
            "$browser_version": F.col("device.browser_version"),
            "$device_type": F.col("device.device_type"),
            "$host": F.col("host"),
            "$pathname": F.col("pathname"),
            "$screen_height": F.col("screen_height"),
            "$screen_width": F.col("screen_width"),
            "$viewport_height": F.col("inner_height"),
            "$viewport_width": F.col("inner_width"),
            "$search_engine": F.col("search_engine"),
            "$referrer": F.col("referrer_shown"),
            "$referring_domain": F.col("referring_domain"),
            "shop": F.col("shop"),
        }
    )
    base.put_json("$set_once", first.text()).put_all(_campaign(""))
    return loads.withColumns(
        {
            "base": base.members(),
            "person_set": latest.text(),
            "person_bare": latest.copy().drop(*customer).text(),
            "customer_text": object_text(F.col("customer")),
        }
    )


def page_contexts(loads: DataFrame, device: Callable[[DataFrame], DataFrame] = with_device) -> DataFrame:
    """One row per page load with a `context` struct that events join to; `device` adds that column."""
    rich = with_texts(device(with_page_facts(working_loads(loads))))
    return rich.select(*KEYS, _context(rich))


def _context(rich: DataFrame) -> Column:
    cart = [c for c in ("cart",) if c in rich.columns]
    return F.struct("loaded_us", "href", "customer", *cart, "analytics_allowed", *TEXTS).alias("context")


def bare_contexts(loads: DataFrame, device: Callable[[DataFrame], DataFrame] = with_device) -> DataFrame:
    """One row per page load with what its context is made of, a tenth of the bytes of the context itself.

    Events join to these, and `with_contexts` makes the context where it is used: its texts go
    through no exchange and no file.
    """
    rich = device(working_loads(loads))
    facts = [c for c in rich.columns if c not in KEYS and c not in UNUSED]
    return rich.select(*KEYS, F.struct(*facts).alias("context"))


def with_contexts(rows: DataFrame) -> DataFrame:
    """Rows with the facts of `bare_contexts` as `context` get the context of `page_contexts` in its place."""
    own = [c for c in rows.columns if c != "context"]
    apart = rows.select(F.struct(*own).alias("_row"), "shop", "context.*")
    rich = with_texts(with_page_facts(apart))
    return rich.select("_row.*", _context(rich)).select(*rows.columns)


def narrow_contexts(loads: DataFrame) -> DataFrame:
    """The same rows with only what identity and sessions need."""
    facts = F.struct("loaded_us", "customer", "analytics_allowed")
    return working_loads(loads).select(
        "shop", "client_id", "page_load_id", facts.alias("context")
    )


def join_context(events: DataFrame, contexts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every event carries the context of its page load; one row per load on the right."""
    return detail_join(events, contexts, ["shop", "client_id", "page_load_id"], hot_rows)


def orphan_events(events: DataFrame, loads: DataFrame) -> DataFrame:
    """Events that `join_context` leaves out because their page load is missing or never worked."""
    keys = ["shop", "client_id", "page_load_id"]
    return events.join(working_loads(loads).select(*keys), keys, "left_anti")


def context_conditions(schema: StructType) -> dict[str, Column]:
    known = {"customer": F.col("context.customer").isNotNull()}
    if field_names(schema, "context.cart"):
        known["load_cart"] = F.col("context.cart").isNotNull()
    return known | {"anonymous": F.col("anonymous"), "spec": F.col("spec_enabled")}


def context_object(
    schema: StructType, conditions: dict[str, Column], strict: bool = False
) -> JsonObject:
    """The properties every event of a page load starts from.

    All fields of the customer and then all of the load's cart are spread, so the
    cart wins where both have a field (`id`). By default the customer fields stay
    on anonymous rows, as the sender leaves them; `strict` leaves them out there.
    """
    c = F.col("context")
    o = JsonObject(conditions)
    o.put_members(c["base"])
    o.put("$current_url", c["href"])
    customer = spread(schema, "context.customer")
    o.put_all(customer, when="customer")
    person = c["person_set"]
    if strict:
        o.drop(*customer, when="anonymous")
        person = F.when(F.col("anonymous"), c["person_bare"]).otherwise(person)
    if "load_cart" in conditions:
        o.put_all(spread(schema, "context.cart"), when="load_cart")
    return o.put_json("$set", person)
