"""Column rules for values that were produced by a JavaScript sender.

The senders treat '', 0 and NaN as "no value" in some places and only null in
others; each helper names which of the two it applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JavaScript trim() removes.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

_TRIM = rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$"
_NUMBER_PREFIX = rf"^[{JS_SPACE}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def text_or_null(col: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(col != "", col)


def number_or_null(col: Column) -> Column:
    """Zero and NaN count as missing."""
    return F.when((col != 0) & ~F.isnan(col.cast("double")), col)


def id_text(col: Column) -> Column:
    """A numeric id as text; 0 counts as missing."""
    return F.when(col != 0, col.cast("string"))


def js_trim(col: Column) -> Column:
    return F.regexp_replace(col, _TRIM, "")


def parse_number(col: Column) -> Column:
    """The numeric prefix of a text as a double, null without one.

    An overflow to infinity is null too: it cannot be written as JSON.
    """
    value = F.regexp_extract(col, _NUMBER_PREFIX, 1).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_truthy_number(col: Column) -> Column:
    """Like parse_number; '' is null anyway, '0.00' stays 0."""
    return parse_number(text_or_null(col))


def parse_spend(col: Column) -> Column:
    """Null stays null, '' means zero."""
    return F.when(col.isNotNull(), parse_number(F.coalesce(text_or_null(col), F.lit("0"))))


def join_text(texts: Column, separator: str = ",") -> Column:
    """Join an array; a null element leaves an empty place."""
    return F.array_join(texts, separator, "")


def joined_or_null(texts: Column, separator: str = ",") -> Column:
    """Join a non-empty array, null for an empty or missing one."""
    return F.when(F.size(texts) > 0, join_text(texts, separator))


def first_text(*cols: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[text_or_null(c) for c in cols])
