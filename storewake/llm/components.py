"""Connected components of large graphs, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewake.llm.common import BROADCAST_ROWS, land

#: Least number of neighbours of a centre whose smallest one goes to the neighbours.
HOT_LINKS = 64


def _with_least(links: DataFrame, n_links: int, path: str, hot_links: int = HOT_LINKS) -> DataFrame:
    """Links with `m`, the smallest `v` of their `u`.

    Up to BROADCAST_ROWS centres are broadcast, so all links stay where they are. Of more centres
    those with very many links are (at most BROADCAST_ROWS have so many); the others meet by shuffle.
    """
    least = land(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), path)
    if least.count() <= BROADCAST_ROWS:
        return links.join(F.broadcast(least.drop("n")), "u")
    bound = max(hot_links, 2 * n_links // BROADCAST_ROWS)
    hot = F.broadcast(least.where(F.col("n") > bound).drop("n"))
    near = links.join(hot, "u")
    rest = links.join(hot.drop("m"), "u", "left_anti").join(least.where(F.col("n") <= bound).drop("n"), "u")
    return near.unionByName(rest)


def components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """`node` and `root` (the smallest node that it reaches) for every node of the edges `u`, `v`.

    A large star links the larger neighbours of a node to the smallest of its
    neighbourhood, a small star the smaller ones; together they turn every
    component into a star in a number of rounds that grows with the logarithm of
    its size. Each round is written once, so a lost executor repeats one round.
    """
    now = land(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        f"{folder}/round0",
    )
    state = _state(now)
    for i in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = land(
            _with_least(both, state[0], f"{folder}/least{i}")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct(),
            f"{folder}/large{i}",
        )
        small = (
            _with_least(large, state[0], f"{folder}/smaller{i}")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = land(small, f"{folder}/round{i}")
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges, equal only if a round changed nothing."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
    ).first()
    return tuple(row)
