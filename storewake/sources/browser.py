"""Browser events and page loads, landed as JSON lines, in batch and as a stream.

The default schemas hold the usual fields. Payloads are open: whoever sends more
passes the schema with them, and the property mappings spread whatever is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storewake.sources import schemas

PIXEL_EVENTS = f"shop string, {schemas.PIXEL_EVENT}"
PAGE_LOADS = f"shop string, {schemas.PAGE_LOAD}"


def read_pixel_events(spark: SparkSession, path: str, schema: str = PIXEL_EVENTS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_pixel_events(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, schema: str = PIXEL_EVENTS
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def read_page_loads(spark: SparkSession, path: str, schema: str = PAGE_LOADS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_shops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SHOP).json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SETTING).json(path)
