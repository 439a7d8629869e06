"""Per-shop settings, live pixels and theme documents as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The settings of a shop and the type each is stored with. A store
# with other key names passes its own mapping to wide_settings.
SETTING_TYPES = {
    "api_key": "single_line_text_field",
    "api_host": "single_line_text_field",
    "data_collection_strategy": "single_line_text_field",
    "web_pixel_feature_toggle": "boolean",
    "web_pixel_events_settings": "json",
    "tracked_events": "json",
    "ecommerce_spec": "boolean",
    "js_web_feature_toggle": "boolean",
    "js_web_config": "json",
    "server_side_feature_toggle": "boolean",
}

JSON5_OPTIONS = {
    "mode": "PERMISSIVE",
    "allowComments": "true",
    "allowUnquotedFieldNames": "true",
    "allowSingleQuotes": "true",
}
BLOCKS = "map<string, struct<type: string, disabled: boolean>>"


def wide_settings(settings: DataFrame, stored_names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per shop with a text column per setting; (shop, key) is unique.

    `stored_names` maps the names used here to the key names in the table.
    """
    names = {n: n for n in SETTING_TYPES} | dict(stored_names or {})
    return settings.groupBy("shop").agg(
        *[F.max(F.when(F.col("key") == stored, F.col("value"))).alias(n) for n, stored in names.items()]
    )


# Texts, which stay, and what the reader does not know between tokens: comments, and commas before a bracket.
_COMMENT = r"/\*(?s:.*?)\*/|//[^\n]*+"
_TOKENS = (
    r"""("(?:[^"\\]++|\\(?s:.))*+"|'(?:[^'\\]++|\\(?s:.))*+')|"""
    rf"{_COMMENT}|,(?=(?:\s|{_COMMENT})*+[}}\]])"
)
_BROKEN = "_broken"


def plain_json5(content: Column) -> Column:
    """JSON5 text without comments and without commas that no value follows."""
    return F.regexp_replace(content, _TOKENS, "$1")


def is_readable(content: Column) -> Column:
    """Whether a text is an object in JSON or JSON5; false for null."""
    plain = plain_json5(content)
    read = F.from_json(plain, f"current string, {_BROKEN} string", JSON5_OPTIONS | {"columnNameOfCorruptRecord": _BROKEN})
    return F.coalesce(plain.rlike(r"^\s*\{") & read.isNotNull() & read[_BROKEN].isNull(), F.lit(False))


def theme_quarantine(themes: DataFrame) -> DataFrame:
    """The theme files whose content does not read as an object, one row per file, with their text.

    Files without content are not there to be read and are left out.
    """
    files = themes.select("shop", "position", "role", F.posexplode("files").alias("file_no", "file"))
    named = files.select("shop", "position", "role", "file_no", "file.filename", "file.content")
    return named.where(F.col("content").isNotNull() & ~is_readable(F.col("content")))


def theme_blocks(content: Column) -> Column:
    """The blocks of a theme's current settings; null when there are none.

    `current` may be a plain text, which has no blocks.
    """
    current = F.from_json(plain_json5(content), "current string", JSON5_OPTIONS)["current"]
    return F.from_json(current, f"blocks {BLOCKS}", JSON5_OPTIONS)["blocks"]
