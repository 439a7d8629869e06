"""Ordered running columns over keyed rows, exact for keys of any size.

A window over a key runs in one task. Keys with more than `hot_rows` rows are
therefore cut into slices of about `slice_rows` rows: their rows are sorted over
all tasks by key and order, every task's part is a slice and its own window
partition, and what a slice inherits from the ones before it is computed from
one summary row per slice. All other keys keep a single slice, so the common
plan is one exchange and one sort. Null keys are keys, null times come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewake.operators.joins import HOT_ROWS, hot_keys, lookup_join
from storewake.session import cut_lineage, land

SLICE = "_slice"
# More slices than that are made only where a slice would hold more than HOT_ROWS rows.
MANY_SLICES = 512


class Timeline:
    """Rows of `keys` in the order of `order`."""

    def __init__(
        self,
        rows: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot_rows: int = HOT_ROWS,
        slice_rows: int | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        self.limits = {"hot_rows": hot_rows, "slice_rows": slice_rows}
        self.sliced = False
        sizes = hot_keys(rows, self.keys, hot_rows)
        n_hot = 0 if sizes is None else sizes.agg(F.sum("count")).first()[0]
        if not n_hot:
            self.rows = rows.withColumn(SLICE, F.lit(0).cast("long"))
        else:
            self.sliced = True
            hot = cut_lineage(sizes.drop("count"))
            # Parts are even up to a sample, so they aim at half of what they may hold.
            slices = 1 + 2 * n_hot // max(slice_rows or hot_rows, 1)
            # Every part costs a sample on the driver and a place in every exchange, so their number is held.
            slices = min(slices, max(MANY_SLICES, 2 * n_hot // HOT_ROWS))
            parts = lookup_join(rows, hot, self.keys, "left_semi", null_safe=True)
            parts = parts.repartitionByRange(int(slices), *self.keys, *self.order)
            numbered = land(parts.withColumn(SLICE, F.spark_partition_id().cast("long") + 1))
            rest = lookup_join(rows, hot, self.keys, "left_anti", null_safe=True)
            self.rows = rest.withColumn(SLICE, F.lit(0).cast("long")).unionByName(numbered)

    def within(self, *more: str) -> Timeline:
        """A timeline of finer keys over the same slices, so without another exchange."""
        finer = copy(self)
        finer.keys = [*self.keys, *more]
        return finer

    @property
    def _window(self):
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def _before(self):
        return self._window.rowsBetween(Window.unboundedPreceding, -1)

    def _through(self):
        return self._window.rowsBetween(Window.unboundedPreceding, 0)

    def _with_carry(self, carry: dict[str, tuple[Column, Column]]) -> None:
        """Join, per slice, a value computed over the summaries of the earlier slices.

        Each entry maps a column to its aggregate over one slice and to the
        function over the earlier slices' aggregates.
        """
        hot_rows = self.rows.where(F.col(SLICE) != 0)
        summary = hot_rows.groupBy(*self.keys, SLICE).agg(
            *[aggregate.alias(name) for name, (aggregate, _) in carry.items()]
        )
        earlier = (
            Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )
        inherited = summary.select(
            *self.keys, SLICE, *[over.over(earlier).alias(n) for n, (_, over) in carry.items()]
        )
        # Nothing to inherit is what a missing row says: at most one row per slice stays, however many the keys.
        inherited = cut_lineage(inherited.where(reduce(or_, [F.col(n).isNotNull() for n in carry])))
        self.rows = lookup_join(self.rows, inherited, [*self.keys, SLICE], "left", null_safe=True)

    def add(self, **columns: Column) -> Timeline:
        self.rows = self.rows.withColumns(columns)
        return self

    def last_before(self, **values: Column) -> Timeline:
        """The latest non-null value of the earlier rows."""
        return self._latest(values, self._before())

    def last_through(self, **values: Column) -> Timeline:
        """The latest non-null value up to and including the row."""
        return self._latest(values, self._through())

    def _latest(self, values: dict[str, Column], window) -> Timeline:
        source = {f"_v_{n}": v for n, v in values.items()}
        self.rows = self.rows.withColumns(source)
        found = {n: F.last(f"_v_{n}", ignorenulls=True).over(window) for n in values}
        if self.sliced:
            order = F.struct(*self.order)
            self._with_carry(
                {
                    f"_c_{n}": (
                        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), order)),
                        F.last(f"_c_{n}", ignorenulls=True),
                    )
                    for n in values
                }
            )
            found = {n: F.coalesce(v, F.col(f"_c_{n}")) for n, v in found.items()}
        self.rows = self.rows.withColumns(found).drop(
            *source, *([f"_c_{n}" for n in values] if self.sliced else [])
        )
        return self

    def sum_through(self, **values: Column) -> Timeline:
        """The sum of a non-null value up to and including the row."""
        source = {f"_v_{n}": v for n, v in values.items()}
        self.rows = self.rows.withColumns(source)
        found = {n: F.sum(f"_v_{n}").over(self._through()) for n in values}
        if self.sliced:
            self._with_carry({f"_c_{n}": (F.sum(f"_v_{n}"), F.sum(f"_c_{n}")) for n in values})
            found = {n: v + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n, v in found.items()}
        self.rows = self.rows.withColumns(found).drop(
            *source, *([f"_c_{n}" for n in values] if self.sliced else [])
        )
        return self

    def result(self) -> DataFrame:
        return self.rows.drop(SLICE)
