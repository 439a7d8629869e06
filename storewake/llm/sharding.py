"""Shards by a hierarchical weighted hash tree, in DataFrame operations only.

A key descends region, rack and shard levels. At each level every child draws
an exponential with its weight from a hash of (key, child), and the smallest
draw wins, so a child gets keys in proportion to its weight and a change of one
weight moves keys only into or out of that child's subtree.

A fleet starts with `BASE` shards in two-by-two-by-two; every further shard
opens a region of its own, so growing by one moves keys into that shard only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewake.llm.common import land, work_folder

BASE = 8


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def fleet(shards: int, base: int = BASE) -> list[Leaf]:
    """The tree of `shards` shards: the base in regions of two racks of two, the rest alone."""
    return [
        Leaf(s // 4, s // 2 % 2, s) if s < base else Leaf((base + 3) // 4 + s - base, 0, s)
        for s in range(shards)
    ]


def _choose(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the smallest weighted draw."""
    draws = []
    for child, weight in sorted(children.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11)
        uniform = (bits.cast("double") + 0.5) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(uniform) / F.lit(weight)).alias("d"), F.lit(child).alias("c")))
    return draws[0]["c"] if len(draws) == 1 else F.least(*draws)["c"]


def _grouped(leaves: Sequence[Leaf], field: str) -> dict[int, list[Leaf]]:
    out: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        out.setdefault(getattr(leaf, field), []).append(leaf)
    return out


def _descend(key: Column, leaves: Sequence[Leaf], levels: Sequence[str], path: str = "") -> Column:
    level, *rest = levels
    below = _grouped(leaves, level)
    weights = {child: sum(x.weight for x in xs) for child, xs in below.items()}
    chosen = _choose(key, f"{path}/{level}", weights)
    if not rest:
        return chosen
    if len(below) == 1:
        ((child, xs),) = below.items()
        return _descend(key, xs, rest, f"{path}/{child}")
    out = F.when(F.lit(False), F.lit(0))
    for child, xs in sorted(below.items()):
        out = out.when(chosen == child, _descend(key, xs, rest, f"{path}/{child}"))
    return out


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key. Leaves without a positive weight get nothing; a null key is a key."""
    live = [leaf for leaf in leaves if leaf.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a positive weight")
    return _descend(key, live, ("region", "rack", "shard"))


def sharded(
    docs: DataFrame,
    shards: int = BASE,
    id_column: str = "doc_id",
    text_column: str = "text",
    leaves: Sequence[Leaf] | None = None,
    grown: Sequence[Leaf] | None = None,
) -> DataFrame:
    """Id, `size`, `text_crc32`, `law`, `shard`, `slot`, `grown_shard`, one row per input row.

    The law is `key`: id and tree decide, so equal ids meet in a shard and a null
    id is one key. Size is the UTF-8 bytes of the text plus 1; null texts have no
    bytes. `slot` numbers the rows of a shard without gaps from 0; repeated rows
    get slots of their own. Slots are counted per input partition first, so a
    shard of any size is numbered by many tasks. Other columns are not read.
    """
    key = F.col(id_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    folder = work_folder(docs.sparkSession)
    rows = land(
        docs.select(
            key.alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_of(key, leaves or fleet(shards)).cast("int").alias("shard"),
            shard_of(key, grown or fleet(shards + 1)).cast("int").alias("grown_shard"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{folder}/rows",
    )
    earlier = (
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy("shard", "part")
        .count()
        .select("shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (
        rows.withColumn("place", place.cast("long") - 1)
        .join(starts, ["shard", "part"])
        .select(
            F.col("id").alias(id_column),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).alias("slot"),
            "grown_shard",
        )
    )
