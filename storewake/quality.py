"""Counts of what passes and what is left out, taken along in the pass that does the work."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from storewake.functions.values import text_or_null
from storewake.operators.joins import lookup_join
from storewake.operators.shops import SHOP_COLUMNS, has_usual_domain
from storewake.sources.webhooks import is_object


def tallies(**tests: Column) -> list[Column]:
    """Metrics: all rows, and those where each test holds."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(test, 1)).alias(name) for name, test in tests.items()]]


def landed_tests() -> dict[str, Column]:
    """Landed lines that have no readable payload or no usual shop domain."""
    return {
        "unreadable": ~is_object(),
        "unusual_domain": ~F.coalesce(has_usual_domain(F.col("shop")), F.lit(False)),
    }


def gated(events: DataFrame, shops: DataFrame, observer: Observation | str) -> DataFrame:
    """The events of `with_shop(events, eligible_shops(shops))`, with counts of why the others are left out.

    Each event counts for the first reason: unknown_shop, no_key, no_host, switched_off. The metrics are
    there after the first action on the result (an Observation), or after every micro-batch (a name).
    """
    details = shops.select(*SHOP_COLUMNS, "server_enabled", F.lit(True).alias("_known"))
    joined = lookup_join(events, details, "shop", "left")
    reasons = {
        "unknown_shop": F.col("_known").isNull(),
        "no_key": text_or_null(F.col("api_key")).isNull(),
        "no_host": text_or_null(F.col("api_host")).isNull(),
        "switched_off": ~F.coalesce("server_enabled", F.lit(False)),
    }
    first = F.coalesce(*[F.when(test, F.lit(name)) for name, test in reasons.items()])
    marked = joined.withColumn("_reason", first)
    counts = tallies(
        passed=F.col("_reason").isNull(),
        **{name: F.col("_reason") == name for name in reasons},
        unusual_domain=~F.coalesce(has_usual_domain(F.col("shop")), F.lit(False)),
    )
    return marked.observe(observer, *counts).where(F.col("_reason").isNull()).drop("_reason", "_known", "server_enabled")


class StreamCounts(StreamingQueryListener):
    """Sums a stream's observed metrics over its micro-batches, by the name of the observation."""

    def __init__(self):
        self.totals: dict[str, Counter[str]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                self.totals.setdefault(name, Counter()).update(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Listeners hear of a batch after it is done: wait until the end of a query has come through."""
        if not self._end(run_id).wait(seconds):
            raise TimeoutError(f"no end of query {run_id} was heard")
