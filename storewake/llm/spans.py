"""Spans of pattern matches in code points, in DataFrame operations only.

A text is cut at the matches, so the lengths of the gaps and of the matches give
every place. All columns work on one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: kind, first code point, end (exclusive), matched text, rank of the kind.
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,rank:int>>"


#: Items that a running step takes at a time, and code points of a piece of text.
_CHUNK = 64
_PIECE = 256


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(
    items: Column,
    first: Column,
    advance: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    kind: str,
) -> Column:
    """What `emit` makes of every item and the state before it, as an array; `advance` gives the state after it.

    Items are taken in chunks, so a long array is not copied for every item. `kind` is the
    type of what is emitted.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(at: Column, item: Column) -> Column:
        out = F.concat(at["out"], F.array(emit(at["at"], item)))
        return F.struct(advance(at["at"], item).alias("at"), out.alias("out"))

    def chunk(at: Column, part: Column) -> Column:
        start = F.struct(at["at"].alias("at"), none.alias("out"))
        return F.aggregate(
            part, start, within, lambda r: F.struct(r["at"].alias("at"), F.concat(at["outs"], F.array(r["out"])).alias("outs"))
        )

    def whole(all_: Column) -> Column:
        count = F.ceil(F.size(all_) / F.lit(_CHUNK)).cast("int")
        parts = F.transform(
            F.sequence(F.lit(0), count - 1), lambda c: F.slice(all_, c * _CHUNK + 1, F.lit(_CHUNK))
        )
        begin = F.struct(first.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        made = F.flatten(F.aggregate(parts, begin, chunk, lambda r: r["outs"]))
        return F.when(F.size(all_) == 0, none).otherwise(made)

    return _bound(items, whole)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(
    text: Column,
    pattern: str | Column,
    kind: str,
    rank: int,
    group: int = 0,
    gate: Column | None = None,
) -> Column:
    """The leftmost non-overlapping matches as spans; `value` is the given group.

    `pattern` must not match the empty string. `gate` is a cheap necessary
    condition that spares the search. A null text has no spans.
    """
    expression = F.lit(pattern) if isinstance(pattern, str) else pattern
    gap_lengths = F.transform(F.split(text, expression, -1), lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all(text, expression, F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, expression, F.lit(group))
    parts = F.arrays_zip(
        gap_lengths.alias("gap"),
        F.transform(whole, lambda x: F.length(x).cast("long")).alias("size"),
        values.alias("value"),
    )

    def span(at: Column, part: Column) -> Column:
        begin = at + part["gap"]
        return F.struct(
            F.lit(kind).alias("kind"),
            begin.alias("start"),
            (begin + part["size"]).alias("end"),
            part["value"].alias("value"),
            F.lit(rank).alias("rank"),
        )

    found = running(
        F.filter(parts, lambda x: x["size"].isNotNull()),
        F.lit(0).cast("long"),
        lambda at, part: at + part["gap"] + part["size"],
        span,
        SPAN[len("array<") : -1],
    )
    asked = F.regexp_like(text, expression) if gate is None else gate
    return F.when(asked, found).otherwise(no_spans())


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    """The spans whose matched text passes the test."""
    return F.filter(spans, lambda s: F.coalesce(test(s["value"]), F.lit(False)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def in_order(spans: Column, by: Sequence[str]) -> Column:
    """Spans sorted by the given fields."""
    keyed = F.transform(spans, lambda s: F.struct(*[s[f].alias(f"k{i}") for i, f in enumerate(by)], s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def listing(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def disjoint(spans: Column, others: Column) -> Column:
    """The spans, by start and rank, that overlap none of the others; the others' ranks are lower."""
    marked = F.concat(
        F.transform(others, lambda s: s.withField("rank", F.lit(-1))), F.filter(spans, lambda s: s["end"] > s["start"])
    )
    far = 1 << 60
    kind = SPAN[len("array<") : -1]
    seen = running(
        in_order(marked, ("start", "rank")),
        F.lit(0).cast("long"),
        lambda at, s: F.when(s["rank"] == -1, F.greatest(at, s["end"])).otherwise(at),
        lambda at, s: F.struct(s.alias("s"), at.alias("before")),
        f"struct<s:{kind},before:bigint>",
    )
    judged = running(
        F.reverse(seen),
        F.lit(far).cast("long"),
        lambda at, x: F.when(x["s"]["rank"] == -1, x["s"]["start"]).otherwise(at),
        lambda at, x: F.when(
            (x["s"]["rank"] != -1) & (x["before"] <= x["s"]["start"]) & (at >= x["s"]["end"]), x["s"]
        ),
        kind,
    )
    return F.filter(F.reverse(judged), lambda s: s.isNotNull())


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, put together from pieces of _PIECE code points."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")

    def part(k: Column) -> Column:
        low = F.greatest(start - k * _PIECE, F.lit(0)).cast("int")
        high = F.least(end - k * _PIECE, F.lit(_PIECE)).cast("int")
        return F.substring(F.get(pieces, k), low + 1, high - low)

    return F.when(start >= end, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, last), part), ""))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span as `[KIND]`; a span that overlaps an earlier one goes with it."""

    def whole(pieces: Column) -> Column:
        def piece(at: Column, s: Column) -> Column:
            mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= at, F.concat(_between(pieces, at, s["start"]), mark)).otherwise(F.lit(""))

        marked = running(
            in_order(spans, ("start", "rank")),
            F.lit(0).cast("long"),
            lambda at, s: F.greatest(at, s["end"]),
            piece,
            "string",
        )
        rest = _between(pieces, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("long"))
        return F.concat(F.array_join(marked, ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(_bound(pieces, whole))
