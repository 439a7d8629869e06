"""The training-data pipeline: five stages over `documents`, each on what its predecessor kept.

All stages but the last return the columns of `documents`. A stage is a function
of (spark, docs, sf_dir); `run` writes each one's result as Parquet in the shared
folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storewake.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from storewake.llm.common import fresh, land, same, sized, table, work_folder

#: Documents with at least this score go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; rows with equal id and text share a verdict.

    Null ids and null texts are judged like others. Without usable labels nothing is rejected.
    """
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    mark = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    (key,) = fresh(docs, "_mark")
    judged = toxicity.scored(docs.select(mark.alias("mark"), "text"), model, id_column="mark")
    rejected = land(
        judged.where(F.col("score") >= TOXIC).select(F.col("mark").alias(key)).distinct(),
        f"{work_folder(spark)}/rejected",
    )
    return docs.join(sized(rejected), same(mark, F.col(key)), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the one with the smallest id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL cannot score, align or pack; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = land(stage(spark, docs, sf_dir), f"{folder}/stage{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
