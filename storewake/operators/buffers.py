"""A sender's buffer as batches: sent when it is full or when its first row has waited long enough.

Where one batch ends decides where the next begins, so the cut is sequential. But a batch
has a fixed number of rows at most, so it ends in the block of that many places in
which it begins or in the next one. A block is therefore a small function: from the
place at which the first batch of the block begins to the same in the next block, and to the
number of batches that begin in between. Functions of neighbouring blocks are composed,
64 at a time, level by level; what enters a block comes back the same way. Every
group is bounded, whatever a key's size, and the levels grow with the logarithm
of the largest key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.operators.joins import join_keys
from storewake.operators.timeline import Timeline
from storewake.session import cut_lineage

# Fixed values of the sender: rows of a full buffer, and microseconds that its first row waits.
FULL_ROWS = 10
WAIT_US = 100_000
#: Blocks, or groups of blocks, that are composed at a time.
FAN = 64

_BLOCK = "_block"


def _hops(times: Column, size: int, wait_us: int) -> Column:
    """For each place of a block the place at which the batch after the one that begins there begins.

    `times` are those of the block and of the next one. Rows less than `wait_us` after the first are in.
    """

    def hop(i: Column) -> Column:
        first = F.get(times, i)
        more = F.filter(F.slice(times, i + 2, size - 1), lambda t: t < first + wait_us)
        return F.when(i < F.size(times), i + 1 + F.size(more)).otherwise(i + size)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), hop)


def _block_function(hops: Column, size: int) -> Column:
    """Per entry place: the entry into the next block and the number of batches that begin on the way."""

    def leave(entry: Column) -> Column:
        start = F.struct(entry.alias("x"), F.lit(0).cast("bigint").alias("n"))
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(size)),
            start,
            lambda at, _: F.when(
                at["x"] < size, F.struct(F.get(hops, at["x"]).alias("x"), (at["n"] + 1).alias("n"))
            ).otherwise(at),
        )
        return F.struct((walk["x"] - size).alias("x"), walk["n"].alias("n"))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), leave)


def _grouped(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring blocks as lists in order."""
    return blocks.groupBy(*keys, (F.col(_BLOCK) / FAN).cast("bigint").alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct(_BLOCK, F.col("_f").alias("f")))).alias("_parts")
    )


def _composed(parts: Column, size: int) -> Column:
    same = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda x: F.struct(x.alias("x"), F.lit(0).cast("bigint").alias("n"))
    )

    def after(done: Column, part: Column) -> Column:
        return F.transform(
            done,
            lambda d: F.struct(
                F.get(part["f"], d["x"])["x"].alias("x"), (d["n"] + F.get(part["f"], d["x"])["n"]).alias("n")
            ),
        )

    return F.aggregate(parts, same, after)


def _entered(grouped: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The entry (`x`, and `n` batches before) of every block, from the entries of the groups."""
    both = join_keys(grouped, entries.withColumnRenamed(_BLOCK, "_group"), [*keys, "_group"], "inner", null_safe=True)
    none = F.array().cast(f"array<struct<{_BLOCK}:bigint,x:int,n:bigint>>")
    start = F.struct(F.col("_x").alias("x"), F.col("_n").alias("n"), none.alias("seen"))

    def enter(at: Column, part: Column) -> Column:
        to = F.get(part["f"], at["x"])
        here = F.struct(part[_BLOCK].alias(_BLOCK), at["x"].alias("x"), at["n"].alias("n"))
        return F.struct(
            to["x"].alias("x"), (at["n"] + to["n"]).alias("n"), F.concat(at["seen"], F.array(here)).alias("seen")
        )

    walked = F.aggregate("_parts", start, enter)["seen"]
    return both.select(*keys, F.explode(walked).alias("_e")).select(
        *keys, f"_e.{_BLOCK}", F.col("_e.x").alias("_x"), F.col("_e.n").alias("_n")
    )


def timed_batches(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    at_us: str,
    size: int = FULL_ROWS,
    wait_us: int = WAIT_US,
    **limits: int,
) -> DataFrame:
    """Add batch_no (from 0 per key) and place (from 1): a batch ends with `size` rows or `wait_us` after its first.

    `order` must follow `at_us`. Rows without a time stand first and count as one instant. Null keys
    are keys. `limits` goes to the timeline that numbers the rows.
    """
    t = Timeline(rows, keys, order, **limits).sum_through(place=F.lit(1).cast("bigint"))
    numbered = cut_lineage(
        t.result().withColumns(
            {_BLOCK: ((F.col("place") - 1) / size).cast("bigint"), "_off": ((F.col("place") - 1) % size).cast("int")}
        )
    )
    long_ago = F.lit(-(1 << 61)).cast("bigint")
    narrow = numbered.select(*keys, _BLOCK, "_off", F.coalesce(at_us, long_ago).alias("_at"))
    ahead = narrow.where(F.col(_BLOCK) > 0).select(
        *keys, (F.col(_BLOCK) - 1).alias(_BLOCK), (F.col("_off") + size).alias("_off"), "_at"
    )
    listed = narrow.unionByName(ahead).groupBy(*keys, _BLOCK).agg(
        F.array_sort(F.collect_list(F.struct("_off", "_at"))).alias("_rows")
    )
    hops = cut_lineage(listed.select(*keys, _BLOCK, _hops(F.col("_rows._at"), size, wait_us).alias("_hops")))
    functions = hops.select(*keys, _BLOCK, _block_function(F.col("_hops"), size).alias("_f"))
    last = hops.agg(F.max(_BLOCK)).first()[0] or 0
    grouped = []
    while last > 0:
        grouped.append(cut_lineage(_grouped(functions, keys)))
        functions = grouped[-1].select(*keys, F.col("_group").alias(_BLOCK), _composed(F.col("_parts"), size).alias("_f"))
        last //= FAN
    entries = functions.select(*keys, _BLOCK, F.lit(0).alias("_x"), F.lit(0).cast("bigint").alias("_n"))
    for level in reversed(grouped):
        entries = _entered(level, entries, keys)

    def begin(at: Column, i: Column) -> Column:
        on = F.struct(F.get(F.col("_hops"), i).alias("x"), F.concat(at["starts"], F.array(i)).alias("starts"))
        return F.when(at["x"] == i, on).otherwise(at)

    begun = F.struct(F.col("_x").alias("x"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), begun, begin)["starts"]
    cuts = join_keys(hops, entries, [*keys, _BLOCK], "inner", null_safe=True).select(
        *keys, _BLOCK, "_n", starts.alias("_starts")
    )
    joined = join_keys(numbered, cuts, [*keys, _BLOCK], "inner", null_safe=True)
    number = F.col("_n") + F.size(F.filter("_starts", lambda s: s <= F.col("_off"))) - 1
    return joined.withColumn("batch_no", number.cast("bigint")).drop(_BLOCK, "_off", "_n", "_starts")
