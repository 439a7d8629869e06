"""URL, referrer and campaign columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storewake.functions.values import text_or_null

# The advertising parameters that are kept from a landing URL.
CAMPAIGN_PARAMS = (
    "gclid",
    "gclsrc",
    "dclid",
    "gbraid",
    "wbraid",
    "fbclid",
    "msclkid",
    "twclid",
    "li_fat_id",
    "igshid",
    "ttclid",
    "rdt_cid",
    "epik",
    "qclid",
    "sccid",
    "irclid",
    "_kx",
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_content",
    "utm_term",
    "gad_source",
    "mc_cid",
)

# Engines in the order they are tried. The pattern runs over the
# whole referrer, so an engine named in a query text matches too.
SEARCH_ENGINES = (
    ("google", r"^https?://(.*)google.([^/?]*)"),
    ("bing", r"^https?://(.*)bing.com"),
    ("yahoo", r"^https?://(.*)yahoo.com"),
    ("duckduckgo", r"^https?://(.*)duckduckgo.com"),
)

DIRECT = "$direct"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"


def _usable(url: Column) -> Column:
    """The URL when it is absolute, else null."""
    return F.when(url.rlike(_SCHEME), url)


def url_host(url: Column) -> Column:
    """Lower-case host with its port; user info and the default port are left out."""
    u = _usable(url)
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = (
        F.when(scheme == "http", F.regexp_replace(host, r":(?:0*80)?$", ""))
        .when(scheme == "https", F.regexp_replace(host, r":(?:0*443)?$", ""))
        .otherwise(host)
    )
    return text_or_null(host)


def url_path(url: Column) -> Column:
    """The path, '/' when it is empty."""
    u = _usable(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(u.isNotNull(), F.coalesce(text_or_null(path), F.lit("/")))


def _query(url: Column) -> Column:
    return F.regexp_extract(_usable(url), r"^[^?#]*\?([^#]*)", 1)


def query_params(url: Column) -> Column:
    """The query parameters in order as (name, value) pairs; null for a URL that is not absolute.

    '+' is a space and %XX is decoded; a text that cannot be decoded is kept as it is.
    """

    def decode(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))

    def entry(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        value = F.when(
            F.instr(part, "=") > 0, F.substr(part, F.instr(part, "=") + F.lit(1))
        ).otherwise(F.lit(""))
        return F.struct(decode(name).alias("name"), decode(value).alias("value"))

    parts = F.filter(F.split(_query(url), "&"), lambda p: p != "")
    return F.transform(parts, entry)


def query_param(params: Column, name: str) -> Column:
    """First value of a parameter in the result of query_params; null when absent."""
    return F.get(F.filter(params, lambda p: p["name"] == name), F.lit(0))["value"]


def campaign_struct(url: Column, prefix: str = "$") -> Column:
    def fields(params: Column) -> Column:
        return F.struct(*[query_param(params, p).alias(f"{prefix}{p}") for p in CAMPAIGN_PARAMS])

    # Within an array the address is read once for all of its parameters.
    return F.transform(F.array(query_params(url)), fields)[0]


def search_engine(referrer: Column) -> Column:
    result = None
    for name, pattern in SEARCH_ENGINES:
        hit = referrer.rlike(pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def referrer_or_direct(referrer: Column) -> Column:
    return F.coalesce(text_or_null(referrer), F.lit(DIRECT))


def referring_domain(referrer: Column) -> Column:
    return F.coalesce(url_host(referrer), F.lit(DIRECT))


def batch_url(api_host: Column) -> Column:
    """Endpoint of a host; one trailing '/' of the host is dropped."""
    return F.concat(F.regexp_replace(api_host, "/$", ""), F.lit("/batch/"))
