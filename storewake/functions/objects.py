"""JSON objects in which a key may be null on some rows and absent on others."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def object_text(struct: Column) -> Column:
    """A struct as JSON with its null fields written."""
    return F.to_json(struct, _KEEP_NULLS)


def inside(json_text: Column) -> Column:
    """The members of a JSON object or array without the outer brackets."""
    # Within an array the text is made once for both of its uses.
    return F.transform(F.array(json_text), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))[0]


def members_or_null(json_text: Column) -> Column:
    """Like inside, null for an object without members."""
    return F.when(json_text != "{}", inside(json_text))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return inside(F.to_json(F.array(text)))


class JsonObject:
    """Keys in the order they are put; a later key replaces an earlier one.

    `when` names a condition of `conditions`. A key put under a condition
    replaces earlier ones on the rows where the condition holds and is absent
    elsewhere.
    """

    def __init__(self, conditions: Mapping[str, Column]):
        self._conditions = dict(conditions)
        self._entries: list[tuple[str, Column, bool, frozenset]] = []
        self._members: list[Column] = []

    def copy(self) -> JsonObject:
        twin = JsonObject(self._conditions)
        twin._entries = list(self._entries)
        twin._members = list(self._members)
        return twin

    def _narrow(self, name: str, when: str | None) -> None:
        kept = []
        for key, value, raw, terms in self._entries:
            if key != name:
                kept.append((key, value, raw, terms))
            elif when is not None and (when, True) not in terms:
                kept.append((key, value, raw, terms | {(when, False)}))
        self._entries = kept

    def put(self, name: str, value: Column, when: str | None = None) -> JsonObject:
        self._narrow(name, when)
        terms = frozenset() if when is None else frozenset({(when, True)})
        self._entries.append((name, value, False, terms))
        return self

    def put_json(self, name: str, text: Column, when: str | None = None) -> JsonObject:
        """A value that is JSON text already."""
        self.put(name, text, when)
        key, value, _, terms = self._entries.pop()
        self._entries.append((key, value, True, terms))
        return self

    def put_all(self, values: Mapping[str, Column], when: str | None = None) -> JsonObject:
        for name, value in values.items():
            self.put(name, value, when)
        return self

    def put_nulls(self, *names: str, when: str | None = None) -> JsonObject:
        return self.put_all({n: F.lit(None).cast("string") for n in names}, when)

    def drop(self, *names: str, when: str | None = None) -> JsonObject:
        for name in names:
            self._narrow(name, when)
        return self

    def put_members(self, text: Column) -> JsonObject:
        """Members that are JSON text already; their names are not put otherwise."""
        self._members.append(text)
        return self

    def members(self) -> Column:
        """The object without its brackets; a key under a condition may leave it empty."""
        groups: dict[frozenset, list[tuple[str, Column, bool]]] = {}
        for name, value, raw, terms in self._entries:
            groups.setdefault(terms, []).append((name, value, raw))
        parts = list(self._members)
        for terms, entries in groups.items():
            plain = [value.alias(name) for name, value, raw in entries if not raw]
            pieces = [inside(object_text(F.struct(*plain)))] if plain else []
            for name, value, raw in entries:
                if raw:
                    member = F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))
                    pieces.append(member)
            for piece in pieces:
                for term, wanted in sorted(terms):
                    holds = self._conditions[term]
                    piece = F.when(holds if wanted else ~holds, piece)
                parts.append(piece)
        return F.concat_ws(",", *parts)

    def text(self) -> Column:
        return F.concat(F.lit("{"), self.members(), F.lit("}"))
