"""Joins against a dimension whose size is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType

from storewake.session import cut_lineage

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
HOT_ROWS = 5_000_000
# Groups in which hot keys are looked for, and the least number of rows of a key that this pays for.
HOT_GROUPS = 4096
MIN_HOT_ROWS = 100_000


def fits_broadcast(
    small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measures at most max_rows + 1 rows, by number and by the bytes of their texts."""
    some = small.limit(max_rows + 1)
    if all(isinstance(f.dataType, AtomicType) for f in small.schema.fields):
        size = sum((F.coalesce(F.length(c.cast("binary")), F.lit(0)) for c in _texts(small)), F.lit(8))
    else:
        size = F.length(F.to_json(F.struct(*small.columns)))
    n, total = some.agg(F.count(F.lit(1)), F.sum(size)).first()
    return n <= max_rows and (total or 0) <= max_bytes


def _texts(frame: DataFrame) -> list[Column]:
    return [F.col(f.name) for f in frame.schema.fields if isinstance(f.dataType, StringType)]


def join_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = False
) -> DataFrame:
    """A join on columns of both frames, which appear once; `null_safe` matches null with null."""
    if not null_safe:
        return left.join(right, list(keys), how)
    theirs = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(theirs)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(t)) for k, t in theirs.items()])
    return left.join(renamed, on, how).drop(*theirs.values())


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The keys with more than `hot_rows` rows and their `count`, or nothing where no key can have that many.

    Rows are counted by a bounded number of groups of keys first, which merge before the exchange; only
    groups that are large enough to hold such a key are counted by key.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(HOT_GROUPS)).cast("int")
    if hot_rows >= MIN_HOT_ROWS:
        sizes = rows.groupBy(group.alias("_group")).count().where(F.col("count") > hot_rows)
        large = [r["_group"] for r in sizes.collect()]
        if not large:
            return None
        rows = rows.where(group.isin(*large))
    return rows.groupBy(*keys).count().where(F.col("count") > hot_rows)


def lookup_join(
    rows: DataFrame,
    dimension: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 32,
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many rows to a dimension that is unique on the key.

    A dimension of checked size is broadcast, so rows of a hot key stay where
    they are. A larger one is joined by shuffle: the rows of keys with more than
    `hot_rows` rows, which are few, are spread over `salts` parts, and their
    dimension rows alone are repeated once per part. Of a stream, whose rows
    cannot be counted before, every key is spread.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dimension, max_rows):
        return join_keys(rows, F.broadcast(dimension), keys, how, null_safe)
    atoms = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    salt = F.pmod(F.xxhash64(*atoms), F.lit(salts)).cast("int")
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    if not rows.isStreaming:
        counts = hot_keys(rows, keys, hot_rows)
        hot = None if counts is None else counts.select(*keys, F.lit(True).alias("_hot"))
        if hot is None or hot.isEmpty():
            return join_keys(rows, dimension.hint("merge"), keys, how, null_safe)
        hot = F.broadcast(cut_lineage(hot))
        rows = join_keys(rows, hot, keys, "left", null_safe=True)
        dimension = join_keys(dimension, hot, keys, "left", null_safe=True)
        salt = F.when(F.col("_hot"), salt).otherwise(0)
        parts = F.when(F.col("_hot"), parts).otherwise(F.array(F.lit(0)))
    salted = rows.withColumn("_salt", salt).drop("_hot")
    repeated = dimension.withColumn("_salt", F.explode(parts)).drop("_hot")
    return join_keys(salted, repeated.hint("merge"), [*keys, "_salt"], how, null_safe).drop("_salt")


def detail_join(
    rows: DataFrame, details: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of two large tables, where `details` has one row per key.

    Keys with more than `hot_rows` rows are few, so their details are brought to
    the rows; all other keys are joined by shuffle.
    """
    hot = hot_keys(rows, keys, hot_rows)
    if hot is None or hot.isEmpty():
        return rows.join(details, list(keys), "inner")
    hot = cut_lineage(hot.drop("count"))
    cold_rows = lookup_join(rows, hot, keys, "left_anti")
    hot_details = cut_lineage(lookup_join(details, hot, keys, "left_semi"))
    cold = cold_rows.join(details, list(keys), "inner")
    return cold.unionByName(lookup_join(rows, hot_details, keys))
