"""Events in the form the receiving host takes, and their batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storewake.functions.objects import inside, members_or_null, object_text, quoted
from storewake.functions.urls import batch_url
from storewake.operators.timeline import Timeline

LIBRARY = "storewake"
LIBRARY_VERSION = "1.0.0"
BATCH_SIZE = 10
CANONICAL = (
    "shop",
    "event",
    "distinct_id",
    "properties",
    "timestamp",
    "uuid",
    "api_key",
    "api_host",
    "arrival_seq",
)


def properties_text(events: DataFrame) -> DataFrame:
    """Properties as JSON text.

    Person updates leave out the fields that were not sent; all other events
    write them as null.
    """
    kind = events.schema["properties"].dataType
    if not isinstance(kind, StructType):
        return events.select(*CANONICAL)
    if "$set" in kind.names:
        text = F.to_json("properties")
    else:
        text = object_text(F.col("properties"))
    return events.withColumn("properties", text).select(*CANONICAL)


def all_events(*feeds: DataFrame) -> DataFrame:
    """One event table from feeds of any channel."""
    union = properties_text(feeds[0])
    for feed in feeds[1:]:
        union = union.unionByName(properties_text(feed))
    return union


def event_body(library: str = LIBRARY, version: str = LIBRARY_VERSION) -> Column:
    """One event as JSON text; `uuid` and `timestamp` are left out when null."""
    base = F.map_from_arrays(
        F.array(F.lit("distinct_id"), F.lit("$lib"), F.lit("$lib_version")),
        F.array(F.col("distinct_id"), F.lit(library), F.lit(version)),
    )
    own = F.coalesce(F.json_object_keys("properties"), F.array())
    added = F.to_json(F.map_filter(base, lambda name, _: ~F.array_contains(own, name)))

    given = F.coalesce("properties", F.lit("{}"))
    merged = F.concat_ws(",", members_or_null(added), members_or_null(given))
    head = F.to_json(F.struct("event"))
    tail = F.to_json(F.struct("timestamp", "uuid"))
    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            inside(head),
            F.concat(F.lit('"properties":{'), merged, F.lit("}")),
            members_or_null(tail),
        ),
        F.lit("}"),
    )


def enveloped(
    events: DataFrame, library: str = LIBRARY, version: str = LIBRARY_VERSION
) -> DataFrame:
    """(url, api_key, body) of every event."""
    return events.select(
        batch_url(F.col("api_host")).alias("url"),
        "api_key",
        "shop",
        "arrival_seq",
        "timestamp",
        "uuid",
        event_body(library, version).alias("body"),
    )


def numbered_batches(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int = BATCH_SIZE,
    **limits: int,
) -> DataFrame:
    """Add batch_no: rows of a key in order, `size` to a batch.

    A key of any size is numbered, because the count runs over a timeline.
    """
    t = Timeline(rows, keys, order, **limits).sum_through(_place=F.lit(1).cast("long"))
    number = F.floor((F.col("_place") - 1) / F.lit(size)).cast("long")
    return t.add(batch_no=number, place=F.col("_place")).result().drop("_place")


def batch_requests(batched: DataFrame, keys: Sequence[str] = ("url", "api_key")) -> DataFrame:
    """One request body per batch; a batch has a fixed number of events at most."""
    in_order = F.array_sort(F.collect_list(F.struct("place", "body")))
    listed = F.array_join(F.transform(in_order, lambda e: e["body"]), ",")
    grouped = batched.groupBy(*keys, "batch_no").agg(listed.alias("events"))
    return grouped.select(
        *keys,
        "batch_no",
        F.concat(
            F.lit('{"api_key":'),
            quoted(F.col("api_key")),
            F.lit(',"batch":['),
            F.col("events"),
            F.lit("]}"),
        ).alias("request"),
    )
