"""Exact copies by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: one row per digest with its smallest
identifier and its number of rows. Runs then merge in binomial rounds: in a
round, run r goes to the run whose number has the round's bits cleared, and a
multiway merge keeps the smallest identifier of each digest. A digest has at
most one row per run at every level, so a text with a third of all rows costs
no more than its number of runs. The way back goes down the same tree: first to
(run, digest), then to the rows of that run.

A digest is verified by a second hash and the length of the text, which are
part of every key: texts that differ in any of them never merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewake.llm.common import SPACE, fresh, land, same, work_folder

FAN_BITS = 3
_DIGEST = ["digest", "second", "length"]


def normalised(text) -> F.Column:
    """Each run of white space as one blank; null as empty."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), rf"{SPACE}{{2,}}|[\x09-\x0D]", " "
    )


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """One row per input row: id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when their normalised forms are. Null texts count as empty.
    The smallest id stays, a null id only if all are null; of repeated rows with
    that id exactly one stays. Other columns of `docs` are not read. An empty
    table gives an empty result.
    """
    folder = work_folder(docs.sparkSession)
    text = normalised(F.col(text_column))
    rows = land(
        docs.select(
            F.col(id_column).alias("id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.xxhash64(text).alias("second"),
            F.length(text).alias("length"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{folder}/rows",
    )
    smallest = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    runs = land(
        rows.groupBy("run", *_DIGEST).agg(
            F.min(smallest).alias("keep"), F.count(F.lit(1)).alias("n")
        ),
        f"{folder}/runs",
    )
    top = runs.agg(F.max("run")).first()[0] or 0
    merged = runs
    for _ in range(0, top.bit_length(), fan_bits):
        merged = (
            merged.withColumn("run", F.shiftright("run", fan_bits))
            .groupBy("run", *_DIGEST)
            .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        )
    root = merged.select(*_DIGEST, "keep", F.col("n").alias("group_size"))
    leaves = runs.select("run", *_DIGEST).join(root, _DIGEST)
    return rows.join(leaves, ["run", *_DIGEST]).select(
        F.col("id").alias(id_column),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns and one row of repeated ones."""
    mark, key, sha, place = fresh(docs, "_text_sha256", "_id", "_sha", "_place")
    kept = (
        exact_groups(docs, id_column, text_column)
        .where("kept")
        .select(F.col(id_column).alias(key), F.col("text_sha256").alias(sha))
    )
    with_mark = docs.withColumn(mark, F.sha2(normalised(F.col(text_column)), 256))
    same_row = Window.partitionBy(id_column, mark).orderBy(F.lit(1))
    return (
        with_mark.join(kept, same(F.col(id_column), F.col(key)) & (F.col(mark) == F.col(sha)), "left_semi")
        .withColumn(place, F.row_number().over(same_row))
        .where(F.col(place) == 1)
        .select(*docs.columns)
    )
