"""The shop table: gates, consent and the join that brings it to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.functions.ids import SHOP_DOMAIN_SUFFIX
from storewake.functions.values import text_or_null
from storewake.operators.joins import lookup_join

# Data collection strategies.
ANONYMIZED = "anonymized"
NON_ANONYMIZED = "non-anonymized"
BY_CONSENT = "non-anonymized-by-consent"
STRATEGIES = (ANONYMIZED, NON_ANONYMIZED, BY_CONSENT)

SHOP_COLUMNS = ("shop", "api_key", "api_host", "strategy")


def eligible_shops(shops: DataFrame) -> DataFrame:
    """Shops that send server events: key, host and the server switch are set."""
    return shops.where(
        text_or_null(F.col("api_key")).isNotNull()
        & text_or_null(F.col("api_host")).isNotNull()
        & F.col("server_enabled")
    )


def with_shop(events: DataFrame, shops: DataFrame, how: str = "inner") -> DataFrame:
    """Bring the shop columns to each event; an unknown shop drops it."""
    return lookup_join(events, shops.select(*SHOP_COLUMNS), "shop", how)


def identify_allowed(strategy: Column) -> Column:
    """On the server, consent cannot be known: only the open strategy sends person updates."""
    return F.coalesce(strategy == NON_ANONYMIZED, F.lit(False))


def is_anonymous(strategy: Column, analytics_allowed: Column) -> Column:
    """In the browser; an unknown strategy counts as anonymous."""
    return F.coalesce(
        F.when(strategy == NON_ANONYMIZED, F.lit(False)).when(
            strategy == BY_CONSENT, ~F.coalesce(analytics_allowed, F.lit(False))
        ),
        F.lit(True),
    )


def valid_strategy(strategy: Column) -> Column:
    return F.when(strategy.isin(*STRATEGIES), strategy).otherwise(F.lit(ANONYMIZED))


def has_usual_domain(shop: Column) -> Column:
    """A quality flag only: events of other domains still pass."""
    return shop.endswith(SHOP_DOMAIN_SUFFIX)


def with_pixel_key(shops: DataFrame) -> DataFrame:
    """Shops whose pixel can send at all."""
    return shops.where(text_or_null(F.col("api_key")).isNotNull())
