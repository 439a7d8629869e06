"""Repair of conversations by the cheapest edits: a Viterbi search whose survivors coalesce.

A conversation's roles must read `(s?(ua)+)?` by their initials. Rows are kept (0),
get the role of a user or an assistant (2) or go (3, the only way for blank rows and
repeats); turns without text may be put in anywhere (2); a truncated row that stays
costs 1 more. Of equally cheap repairs the one whose edits' initials are least in
ASCII order is taken.

Four states (nothing yet, after s, u, a) each keep one survivor, a leaf of a tree of
back pointers whose nodes count their references. As soon as all survivors share an
ancestor, the edits down to it are certain: they are handed on and their nodes go, as
do nodes that no survivor reaches; a survivor that another one beats whatever follows ends. So a task holds the unresolved rows of one
conversation only, however long it is. Ties are settled by the whole unresolved
suffixes, back to where the two part.

Rows are dealt by conversation and sorted by Spark, which spills; a task reads them once, as a
stream. The checksum of a repaired conversation is a chain over its rows, so one
conversation is always one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role initial; a missing one is not allowed.
STEPS = (
    {"s": SYSTEM, "u": USER},
    {"u": USER},
    {"a": ASSISTANT},
    {"u": USER},
)
ACCEPTING = (NOTHING, ASSISTANT)
#: What it costs a state at most to go on as another would: a survivor that is dearer than
#: another one by more than that can win no more.
AHEAD = (
    (0, 0, 2, 0),
    (4, 0, 2, 4),
    (5, 2, 0, 2),
    (3, 0, 2, 0),
)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of a result batch.
BATCH = 2048

_BLANK = " \t\n\x0b\x0c\r"
_STOPS = ".!?"


@dataclass(eq=False, slots=True)
class Node:
    """One edit. References are the edits that follow it and the survivors that end with it."""

    parent: Node | None
    edit: str
    role: str | None = None
    row: tuple | None = None
    cost: int = 0
    depth: int = 0
    survivors: int = 0
    following: list[Node] = field(default_factory=list)


class Repair:
    """The search over one conversation: `add` rows, which returns certain edits, then `finish`."""

    def __init__(self):
        self.root = Node(None, "", survivors=1)
        self.best: list[Node | None] = [self.root, None, None, None]
        self.live = self.most = 1
        self._insert(self.best)

    def _release(self, node: Node) -> None:
        node.survivors -= 1
        while node is not self.root and not node.survivors and not node.following:
            node.parent.following.remove(node)
            node = node.parent
            self.live -= 1

    @staticmethod
    def _less(left: Node, right: Node) -> bool:
        """Whether the edits of one node come before the other's; only what differs is walked."""
        ours, theirs = [], []
        while left is not right:
            if left.depth >= right.depth:
                ours.append(left.edit)
                left = left.parent
            else:
                theirs.append(right.edit)
                right = right.parent
        return ours[::-1] < theirs[::-1]

    def _offer(self, states: list, state: int, node: Node) -> bool:
        """Whether a new edit becomes a state's survivor: cheaper, or as cheap and before the old."""
        old = states[state]
        if old is not None and (old.cost < node.cost or old.cost == node.cost and not self._less(node, old)):
            return False
        node.parent.following.append(node)
        node.survivors = 1
        self.live += 1
        states[state] = node
        if old is not None:
            self._release(old)
        return True

    def _after(self, node: Node, edit: str, cost: int, role: str | None = None, row: tuple | None = None) -> Node:
        return Node(node, edit, role, row, node.cost + cost, node.depth + 1)

    def _insert(self, states: list) -> None:
        """Turns without text, until no state gains by one."""
        gained = True
        while gained:
            gained = False
            for state in range(4):
                for initial in "ua":
                    if states[state] is not None and initial in STEPS[state]:
                        made = self._after(states[state], "I", INSERT, NAMES[initial])
                        gained |= self._offer(states, STEPS[state][initial], made)

    def _prune(self) -> None:
        """Survivors that another one beats whatever rows follow."""
        for state, node in enumerate(self.best):
            if node is not None and any(
                other is not None and other.cost + AHEAD[at][state] < node.cost for at, other in enumerate(self.best)
            ):
                self.best[state] = None
                self._release(node)

    def add(self, row: tuple, initial: str, must_go: bool, truncated: bool) -> list[Node]:
        """One more row; returns the edits that are certain now, in order."""
        states: list[Node | None] = [None] * 4
        more = TRUNCATED if truncated else 0
        for state, node in enumerate(self.best):
            if node is None:
                continue
            self._offer(states, state, self._after(node, "D", DELETE, None, row))
            if must_go:
                continue
            if initial in STEPS[state]:
                self._offer(states, STEPS[state][initial], self._after(node, "K", more, None, row))
            for to in "ua":
                if to in STEPS[state]:
                    self._offer(states, STEPS[state][to], self._after(node, "R", REROLE + more, NAMES[to], row))
        self._insert(states)
        for node in self.best:
            if node is not None:
                self._release(node)
        self.best = states
        self._prune()
        self.most = max(self.most, self.live)
        certain = []
        while not self.root.survivors and len(self.root.following) == 1:
            self.root = self.root.following[0]
            self.root.parent = None
            self.live -= 1
            certain.append(self.root)
        return certain

    def finish(self) -> list[Node]:
        """The edits that were still open, of the cheapest whole repair."""
        leaf = None
        for state in ACCEPTING:
            node = self.best[state]
            if node is not None and (
                leaf is None or node.cost < leaf.cost or node.cost == leaf.cost and self._less(node, leaf)
            ):
                leaf = node
        out = []
        while leaf is not self.root:
            out.append(leaf)
            leaf = leaf.parent
        return out[::-1]


def _fault(text: str, repeated: bool) -> str | None:
    solid = text.strip(_BLANK)
    if not solid:
        return "blank"
    if repeated:
        return "duplicate"
    return None if solid[-1] in _STOPS else "truncated"


_EDITS = (
    "conv_id {id}, step bigint, edit string, cost int, turn {turn}, role string, text string, "
    "fault string, was_role string"
)


def _edit_rows(conv, step: int, nodes: list[Node], paid: int) -> Iterator[tuple]:
    for node in nodes:
        turn, role, text, fault = node.row or (None, None, "", None)
        stays = node.edit != "D"
        yield (
            conv, step, node.edit, node.cost - paid, turn,
            (node.role or role) if stays else None, text if stays else None, fault, role,
        )
        step, paid = step + 1, node.cost


def _edited(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Edit rows of sorted conversation rows (conversation, marker, turn, role, text, repeated)."""
    current, repair, step, paid, seen = object(), None, 0, 0, False

    def handed(nodes: list[Node]) -> Iterator[tuple]:
        nonlocal step, paid
        yield from _edit_rows(current, step, nodes, paid)
        if nodes:
            step, paid = step + len(nodes), nodes[-1].cost

    def closed() -> Iterator[tuple]:
        if repair is None:
            return
        if not seen:
            yield (current, *[None] * 8)
        yield from handed(repair.finish() if seen else [])

    for conv, marker, turn, role, text, repeated in rows:
        if repair is None or conv != current:
            yield from closed()
            current, repair, step, paid, seen = conv, Repair(), 0, 0, False
        if marker:
            continue
        seen = True
        fault = _fault(text, repeated)
        yield from handed(
            repair.add((turn, role, text, fault), role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        )
    yield from closed()


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema
            )
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema
        )


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def repaired(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    marker: Column | None = None,
) -> DataFrame:
    """The edits of every conversation's cheapest repair, one row per edit, in order by `step`.

    `edit` is K, R, D or I; `role` and `text` are those of the repaired turn (null for D), `was_role`
    and `turn` those of the row, `fault` is the row's first of blank, duplicate and truncated.
    Rows stand by turn (null first), then role, then text; a null role or text is one
    blank. Rows with a null conversation are one conversation. Repeated rows are
    duplicates. Rows where `marker` holds only name their conversation; one without other
    rows has a single row of nulls. An empty table has no edits. Other columns are not read.
    """
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(conv_column).alias("conv_id"),
        (F.lit(False) if marker is None else marker).alias("marker"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), blank).alias("text"),
    ).repartition("conv_id")
    same_text = Window.partitionBy("conv_id", "marker", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    ordered = (
        rows.withColumn("nth", F.row_number().over(same_text))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
        .select("conv_id", "marker", "turn", "role", "text", (F.col("nth") > 1).alias("repeated"))
    )
    kinds = {n: ordered.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        text = pa.string()
        schema = pa.schema(
            [
                ("conv_id", first.column("conv_id").type), ("step", pa.int64()), ("edit", text), ("cost", pa.int32()),
                ("turn", first.column("turn").type), ("role", text), ("text", text), ("fault", text), ("was_role", text),
            ]
        )

        def all_batches():
            yield first
            yield from batches

        yield from _batched(_edited(_tuples(all_batches())), schema)

    return ordered.mapInArrow(edit, _EDITS.format(id=kinds["conv_id"], turn=kinds["turn"]))


_REPORT = (
    "conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


class _Report:
    """Counts and checksum of one conversation's edits, read one by one."""

    def __init__(self, conv):
        self.conv = conv
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.initial = None
        self.audit: list[str] = []
        self.sum = hashlib.sha256()
        self.turned = False

    def add(self, edit, cost, turn, role, text, fault, was_role) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "D":
            self.sum.update(("\n" * self.turned + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.turned = True
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + was_role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = was_role[:1]
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last = turn
            self.turns += 1

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return (
            self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sum.hexdigest()
        )


def _reported(edits: Iterable[tuple]) -> Iterator[tuple]:
    report = None
    for conv, _, edit, *rest in edits:
        if report is None or conv != report.conv:
            if report is not None:
                yield report.row()
            report = _Report(conv)
        if edit is not None:
            report.add(edit, *rest)
    if report is not None:
        yield report.row()


def reports(conversations: DataFrame, **columns) -> DataFrame:
    """One row per conversation: its faults, the repair's cost, audit (the edits' initials) and checksum.

    `gaps` are the turn numbers missing between the first and the last (null turns ignored), `illegal` the
    neighbours whose role initials are not su, ua or au. `repaired_sha256` is over the
    repaired `role:text` lines. Parameters and special cases are those of `repaired`; a
    conversation without rows has zeros, an empty audit and the empty string's checksum.
    """
    edits = repaired(conversations, **columns)

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        whole = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        schema = pa.schema(
            [("conv_id", first.column("conv_id").type), *whole, ("audit", pa.string()), ("repaired_sha256", pa.string())]
        )

        def all_batches():
            yield first
            yield from batches

        yield from _batched(_reported(_tuples(all_batches())), schema)

    return edits.mapInArrow(report, _REPORT.format(id=edits.schema["conv_id"].dataType.simpleString()))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after planted damage, and `gone` rows that only name their conversation.

    By crc32(`conv_id:turn`) % 20 (a null is one blank there, as in role and text): 0 drops a row, 1
    empties its text, 2 takes its stops `.!?` away, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    filled = {n: F.coalesce(F.col(n).cast("string"), blank) for n in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.encode(F.concat(filled["conv_id"], F.lit(":"), filled["turn"]), "UTF-8")) % 20
    rows = conversations.select(
        "conv_id", "turn", filled["role"].alias("role"), filled["text"].alias("text"), kind.alias("kind")
    )
    text = (
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.translate("text", _STOPS, ""))
        .otherwise(F.col("text"))
    )
    gone = F.col("kind") == 0
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.when(~gone, F.col("role"))).alias("role"),
        F.when(~gone, text).alias("text"),
        gone.alias("gone"),
        F.explode(copies).alias("copy"),
    ).drop("copy")
