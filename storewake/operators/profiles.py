"""Person profiles folded from person updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def person_profiles(
    updates: DataFrame,
    latest: Sequence[str],
    first: Sequence[str],
    order: Sequence[str] = ("timestamp", "arrival_seq"),
) -> DataFrame:
    """Per person the latest value of each `latest` column and the first of each `first` one.

    A null is a field that was not sent. Each field is its own aggregate, so
    updates are merged before the exchange, however many a person has.
    """
    place = F.struct(*order)

    def place_of(name: str):
        return F.when(F.col(name).isNotNull(), place)

    return updates.groupBy("shop", "distinct_id").agg(
        *[F.max_by(n, place_of(n)).alias(n) for n in latest],
        *[F.min_by(n, place_of(n)).alias(n) for n in first],
    )
