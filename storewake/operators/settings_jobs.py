"""Jobs over the settings of the whole shop fleet."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.functions.values import js_trim, text_or_null
from storewake.operators.joins import lookup_join
from storewake.operators.pixel_settings import text_list
from storewake.operators.shops import ANONYMIZED, STRATEGIES, valid_strategy
from storewake.sources.settings import SETTING_TYPES, theme_blocks

# Event switches in order, with their defaults.
EVENT_DEFAULTS = {
    "page_viewed": True,
    "collection_viewed": False,
    "product_viewed": False,
    "product_added_to_cart": True,
    "cart_viewed": True,
    "product_removed_from_cart": True,
    "checkout_started": True,
    "checkout_contact_info_submitted": True,
    "checkout_address_info_submitted": False,
    "checkout_shipping_info_submitted": False,
    "payment_info_submitted": False,
    "checkout_completed": True,
    "search_submitted": False,
    "clicked": False,
    "form_submitted": False,
}

# The console addresses a deployment allows; the first is the default.
CONSOLE_HOSTS = ("https://us.example.com", "https://eu.example.com")

# Fields of the page script's configuration, by kind, with defaults.
SCRIPT_SWITCHES = {
    "capture_pageview": False,
    "capture_pageleave": False,
    "cross_subdomain_cookie": True,
    "disable_persistence": False,
    "disable_surveys": False,
    "disable_session_recording": False,
    "disable_web_experiments": True,
    "enable_recording_console_log": False,
    "enable_heatmaps": None,
    "mask_all_text": False,
    "mask_all_element_attributes": False,
    "opt_out_capturing_by_default": False,
    "opt_out_persistence_by_default": False,
    "advanced_disable_decide": False,
    "advanced_disable_feature_flags": False,
    "advanced_disable_feature_flags_on_first_load": False,
    "secure_cookie": False,
}
SCRIPT_CHOICES = {
    "persistence": (
        "localStorage+cookie",
        ("localStorage", "sessionStorage", "cookie", "memory", "localStorage+cookie"),
    ),
    "person_profiles": ("always", ("always", "identified_only")),
}
SCRIPT_NUMBERS = {"session_idle_timeout_seconds": 1800, "feature_flag_request_timeout_ms": 3000}
SCRIPT_LISTS = ("property_denylist", "custom_campaign_params")
SCRIPT_NULLABLE = ("ui_host", "enable_heatmaps")

# Fixed value: how an API key starts.
KEY_START = "phc_"


def script_defaults(console_hosts: tuple[str, ...] = CONSOLE_HOSTS) -> dict[str, object]:
    return {
        "ui_host": console_hosts[0],
        **SCRIPT_SWITCHES,
        **{name: default for name, (default, _) in SCRIPT_CHOICES.items()},
        **SCRIPT_NUMBERS,
        **{name: [] for name in SCRIPT_LISTS},
    }


def _json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"))


def seed_defaults(console_hosts: tuple[str, ...] = CONSOLE_HOSTS) -> dict[str, str]:
    """The settings a new shop starts with, as stored text."""
    return {
        "js_web_feature_toggle": "false",
        "web_pixel_feature_toggle": "true",
        "web_pixel_events_settings": _json(EVENT_DEFAULTS),
        "tracked_events": _json([n for n, on in EVENT_DEFAULTS.items() if on]),
        "js_web_config": _json(script_defaults(console_hosts)),
        "server_side_feature_toggle": "false",
        "ecommerce_spec": "true",
    }


def event_toggles(stored: Column) -> Column:
    """All event switches of a shop: the stored JSON over the defaults."""
    given = F.from_json(stored, "map<string, boolean>")
    entries = [
        F.struct(
            F.lit(name).alias("name"),
            F.coalesce(F.try_element_at(given, F.lit(name)), F.lit(on)).alias("on"),
        )
        for name, on in EVENT_DEFAULTS.items()
    ]
    return F.map_from_entries(F.array(*entries))


def tracked_from_toggles(toggles: Column) -> Column:
    """Names of the switches that are on."""
    return F.map_keys(F.map_filter(toggles, lambda _, on: F.coalesce(on, F.lit(False))))


def seed_settings(
    shops: DataFrame, settings: DataFrame, defaults: Mapping[str, str] | None = None
) -> DataFrame:
    """The settings table with the missing defaults of every shop filled in."""
    given = dict(defaults or seed_defaults())

    def of(texts: Mapping[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(t) for pair in texts.items() for t in pair]), F.col("key"))

    # The texts follow after the join. Stored settings can be many, however small their files look, so they
    # are never broadcast.
    wanted = shops.select("shop", F.explode(F.array(*[F.lit(key) for key in given])).alias("key"))
    stored = settings.select("shop", "key").hint("merge")
    missing = wanted.join(stored, ["shop", "key"], "left_anti")
    return settings.unionByName(
        missing.select("shop", "key", of({key: SETTING_TYPES[key] for key in given}).alias("type"), of(given).alias("value"))
    )


def shops_from_settings(wide: DataFrame) -> DataFrame:
    """Shop rows as an installation writes them: the strategy is not checked here."""
    return wide.select(
        "shop",
        text_or_null(F.col("api_key")).alias("api_key"),
        text_or_null(F.col("api_host")).alias("api_host"),
        F.coalesce(text_or_null(F.col("data_collection_strategy")), F.lit(ANONYMIZED)).alias(
            "strategy"
        ),
        F.col("server_side_feature_toggle").eqNullSafe("true").alias("server_enabled"),
    )


def upsert_shops(shops: DataFrame, changes: DataFrame) -> DataFrame:
    """The shop table after the latest saved form of each shop.

    `changes` has shop, change_seq, api_key, api_host, strategy and
    server_enabled as JSON text: only the JSON value true switches it on.
    """
    saved = F.struct(
        text_or_null(F.col("api_key")).alias("api_key"),
        text_or_null(F.col("api_host")).alias("api_host"),
        valid_strategy(F.col("strategy")).alias("strategy"),
        F.col("server_enabled").eqNullSafe("true").alias("server_enabled"),
    )
    latest = changes.groupBy("shop").agg(F.max_by(saved, "change_seq").alias("new"))
    columns = ("api_key", "api_host", "strategy", "server_enabled")
    joined = shops.join(latest, "shop", "full")
    return joined.select(
        "shop",
        *[
            F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
            for c in columns
        ],
    )


def is_url(text: Column) -> Column:
    web = text.rlike(r"(?i)^(https?|wss?|ftp):/*[^/?#\s]\S*$")
    other = text.rlike(r"(?i)^(?!(https?|wss?|ftp):)[a-z][a-z0-9+.-]*:\S*$")
    return web | other


def validated_settings(wide: DataFrame) -> DataFrame:
    """Add `bad_keys` and the settings a pixel would get, as texts.

    A key or an event list that is missing makes the settings invalid, a missing
    host or strategy takes its default.
    """
    key = js_trim(text_or_null(F.col("api_key")))
    host = js_trim(text_or_null(F.col("api_host")))
    strategy = text_or_null(F.col("data_collection_strategy"))
    tracked = F.when(F.ltrim("tracked_events").startswith("["), F.col("tracked_events"))
    bad = [
        F.when(~F.coalesce(key.startswith(KEY_START), F.lit(False)), F.lit("api_key")),
        F.when(~is_url(host), F.lit("api_host")),
        F.when(~strategy.isin(*STRATEGIES), F.lit("data_collection_strategy")),
        F.when(tracked.isNull(), F.lit("tracked_events")),
    ]
    return wide.withColumns(
        {
            "bad_keys": F.array_compact(F.array(*bad)),
            "pixel_settings": F.struct(
                key.alias("api_key"),
                F.coalesce(host, F.lit("")).alias("api_host"),
                F.coalesce(strategy, F.lit(ANONYMIZED)).alias("data_collection_strategy"),
                F.to_json(text_list(tracked)).alias("tracked_events"),
                F.col("ecommerce_spec").eqNullSafe("true").cast("string").alias("ecommerce_spec"),
            ),
        }
    )


def good_settings(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("bad_keys") == 0)


def rejected_settings(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("bad_keys") > 0)


def all_disabled(tracked_events: Column) -> Column:
    return F.size(text_list(tracked_events)) == 0


def reconcile_pixels(wide: DataFrame, pixels: DataFrame) -> DataFrame:
    """What to do with each shop's live pixel: (shop, action, status, settings).

    Action and status are null when nothing is to be done.
    """
    wanted = (
        F.col("web_pixel_feature_toggle").eqNullSafe("true")
        & (F.size("bad_keys") == 0)
        & ~all_disabled(F.col("tracked_events"))
    )
    live = text_or_null(F.col("pixel_id")).isNotNull()
    joined = validated_settings(wide).join(pixels.select("shop", "pixel_id"), "shop", "left")

    def choose(delete: str, update: str, create: str) -> Column:
        return (
            F.when(wanted & live, update)
            .when(wanted, create)
            .when(live, delete)
        )

    return joined.select(
        "shop",
        choose("delete", "update", "create").alias("action"),
        choose("disconnected", "updated", "connected").alias("status"),
        F.when(wanted, F.col("pixel_settings")).alias("settings"),
    )


def merged_tracked_events(stored: Column, live: Column) -> Column:
    """Stored and live tracked events without repeats."""
    return F.array_union(text_list(stored), text_list(live))


def shown_toggles(stored: Column, live: Column, merged: Column) -> Column:
    """A switch shows as on when either source or the merged list has it on."""
    kept = F.from_json(stored, "map<string, boolean>")
    running = F.try_parse_json(live)
    entries = []
    for name in EVENT_DEFAULTS:
        sources = [
            F.try_element_at(kept, F.lit(name)),
            F.try_variant_get(running, f"$.{name}", "variant").cast("string").eqNullSafe("true")
            & (F.schema_of_variant(F.try_variant_get(running, f"$.{name}", "variant")) == "BOOLEAN"),
            F.array_contains(merged, name),
        ]
        on = F.lit(False)
        for source in sources:
            on = on | F.coalesce(source, F.lit(False))
        entries.append(F.struct(F.lit(name).alias("name"), on.alias("on")))
    return F.map_from_entries(F.array(*entries))


def any_block_enabled(blocks: Column, embed_id: str) -> Column:
    """Some block of the embed is there and not disabled; false without blocks."""
    found = F.exists(
        F.map_values(blocks),
        lambda b: b["type"].contains(embed_id) & ~F.coalesce(b["disabled"], F.lit(False)),
    )
    return F.coalesce(found, F.lit(False))


def embed_status(themes: DataFrame, embed_id: str) -> DataFrame:
    """(shop, enabled) from the first file of each shop's first main theme.

    `themes` has shop, position, role and files (array of filename and content).
    """
    first = F.get("files", F.lit(0))["content"]
    main = themes.groupBy("shop").agg(
        F.min_by(first, F.when(F.col("role") == "MAIN", F.col("position"))).alias("content")
    )
    return main.select(
        "shop", any_block_enabled(theme_blocks(F.col("content")), embed_id).alias("enabled")
    )


def without_uninstalled(table: DataFrame, uninstalled: DataFrame) -> DataFrame:
    """Rows of shops that stay; repeating the notice changes nothing."""
    return lookup_join(table, uninstalled.select("shop").distinct(), "shop", "left_anti")


def script_config_errors(config: Column, console_hosts: tuple[str, ...] = CONSOLE_HOSTS) -> Column:
    """Names of the fields of a page script configuration that have a wrong value.

    A missing field takes its default; null is allowed for SCRIPT_NULLABLE only.
    """
    parsed = F.try_parse_json(config)

    def wrong(name: str, good) -> Column:
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        fine = good(F.schema_of_variant(value), value.try_cast("string"))
        if name in SCRIPT_NULLABLE:
            fine = fine | F.is_variant_null(value)
        return F.when(value.isNotNull() & ~F.coalesce(fine, F.lit(False)), F.lit(name))

    checks = [wrong("ui_host", lambda kind, text: (kind == "STRING") & text.isin(*console_hosts))]
    checks += [wrong(n, lambda kind, _: kind == "BOOLEAN") for n in SCRIPT_SWITCHES]
    checks += [
        wrong(n, lambda kind, text, allowed=allowed: (kind == "STRING") & text.isin(*allowed))
        for n, (_, allowed) in SCRIPT_CHOICES.items()
    ]
    checks += [
        wrong(n, lambda kind, _: kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"))
        for n in SCRIPT_NUMBERS
    ]
    checks += [wrong(n, lambda kind, _: kind.isin("ARRAY<STRING>", "ARRAY<VOID>")) for n in SCRIPT_LISTS]
    return F.when(parsed.isNull(), F.array(F.lit("config"))).otherwise(
        F.array_compact(F.array(*checks))
    )
