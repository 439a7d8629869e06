"""Best-fit packing of documents by length patterns.

Only the histogram of piece lengths leaves the tasks, and it has at most one row
per length up to the sequence's. Over it, patterns of two to four lengths that
fill a sequence exactly are enumerated, their repeat counts fitted to the
histogram by non-negative least squares and rounded down, and what is left over
is packed best-fit decreasing. The result is a plan of segments: for a length
and a range of ranks, the first sequence and the place in it. Pieces get ranks
per length, counted by input partition first, and meet the plan by length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storewake.llm.common import land, work_folder

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
END_ID = 2

#: How the vocabulary's words are cut, as its description says; without a look-ahead
#: where no two white space characters meet, which is the same and faster.
_CUT_SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_BLANKS = re.compile(r"\s\s")
#: Code points whose classes all libraries agree on; other texts take the tokenizer itself.
_UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\xa0-ɏ‐-‧€]|<\|")


def _byte_table() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids:
    """Token ids of a byte-level vocabulary file."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        letters = _byte_table()
        special = {t["content"] for t in made.get("added_tokens", [])}
        ranks = {
            bytes(letters[c] for c in word): i
            for word, i in made["model"]["vocab"].items()
            if word not in special
        }
        self.full = tiktoken.Encoding(
            "full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.single = tiktoken.Encoding(
            "single", pat_str=_CUT_SINGLE, mergeable_ranks=ranks, special_tokens={}
        )

    def of(self, text: str) -> list[int]:
        if _UNUSUAL.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return (self.full if _BLANKS.search(text) else self.single).encode_ordinary(text)


def pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = TOKENIZER,
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """`id`, `piece`, `start`, `length`, `ids_crc32` (and `ids`) of each document's pieces.

    A document is its ids and the end id, so a null or empty text has one. Longer
    ones than a sequence are cut into whole sequences, a shorter piece first.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(public_tokenizers.path(tokenizer)).of
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*(ids_of(text) if text else ()), end_id], "<u4")
                first = len(ids) % sequence or sequence
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, sequence)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    part = ids[a:b]
                    out.append((n, a, b - a, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            columns = [
                batch.column("id").take(pa.array(rows, pa.int64())),
                pa.array([x[0] for x in out], pa.int32()),
                *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3)),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x[4] for x in out], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, schema + (", ids array<bigint>" if with_ids else ""))


def _exact_patterns(histogram: np.ndarray, sequence: int) -> list[tuple[int, ...]]:
    """Pairs of all lengths, and triples and quadruples of a spread of lengths, that fill a sequence."""
    have = np.flatnonzero(histogram)
    present = set(have.tolist())
    found = {(sequence - a, a) for a in present if 2 * a <= sequence and sequence - a in present}
    few = have[np.linspace(0, len(have) - 1, min(len(have), 64)).astype(int)].tolist() if len(have) else []
    for a in few:
        for b in few:
            c = sequence - a - b
            if c >= b >= a and c in present:
                found.add((c, b, a))
    for a in few[::4]:
        for b in few[::4]:
            for c in few[::4]:
                d = sequence - a - b - c
                if a <= b <= c <= d and d in present:
                    found.add((d, c, b, a))
    return sorted(found, reverse=True)


def fit_counts(histogram: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared difference of the patterns' lengths from the
    histogram, by accelerated projected gradients."""
    row = np.array([length for p in patterns for length in p])
    col = np.array([i for i, p in enumerate(patterns) for _ in p])
    target = histogram.astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[col], len(target))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, r[row], len(patterns))

    # The largest eigenvalue of A'A is at most its largest row sum.
    step = 1.0 / max(1.0, back(forward(np.ones(len(patterns)))).max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _repeat(left: np.ndarray, counts: np.ndarray, patterns: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of the patterns that the histogram holds, the largest counts first."""
    plan = []
    for i in np.argsort(-counts, kind="stable").tolist():
        need = {length: patterns[i].count(length) for length in patterns[i]}
        n = min(int(counts[i] + 1e-6), *(int(left[length]) // k for length, k in need.items()))
        if n > 0:
            for length, k in need.items():
                left[length] -= n * k
            plan.append((patterns[i], n))
    return plan


def _best_fit(left: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: open sequences of one kind are filled together."""
    rooms: list[int] = []  # open room, ascending
    kinds: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in kinds:
            kinds[room] = []
            bisect.insort(rooms, room)
        kinds[room].append((pattern, n))

    for length in range(len(left) - 1, 0, -1):
        count = int(left[length])
        while count:
            place = bisect.bisect_left(rooms, length)
            if place == len(rooms):
                fresh = min(count, max(1, count // max(1, sequence // length)))
                put(sequence - length, (length,), fresh)
                count -= fresh
                continue
            room = rooms[place]
            pattern, n = kinds[room].pop()
            used = min(n, count)
            if n > used:
                kinds[room].append((pattern, n - used))
            if not kinds[room]:
                del kinds[room]
                rooms.pop(place)
            count -= used
            put(room - length, (*pattern, length), used)
    return [x for found in kinds.values() for x in found]


def plan(histogram: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their numbers of sequences; holds every piece of the histogram.

    Exact patterns are fitted again to what rounding leaves until it yields no more.
    """
    left = histogram.astype(np.int64).copy()
    out = [((sequence,), int(left[sequence]))] if left[sequence] else []
    left[sequence] = 0
    for _ in range(6):
        patterns = _exact_patterns(left, sequence)
        made = _repeat(left, fit_counts(left, patterns), patterns) if patterns else []
        out += made
        if not made:
            break
    return out + _best_fit(left, sequence)


def packed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = TOKENIZER,
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset` (and `ids`).

    Every row is a document of its own, repeated rows too; null ids are ids; an
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    rows = land(
        pieces(docs, id_column, text_column, tokenizer, sequence, end_id, with_ids).withColumns(
            {"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}
        ),
        f"{folder}/pieces",
    )
    histogram = np.zeros(sequence + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # a row per length
        histogram[length] = n
    segments, first, ranks = [], 0, np.zeros(sequence + 1, np.int64)
    for pattern, n in plan(histogram, sequence):
        offset = 0
        for length in pattern:
            rank = int(ranks[length])
            segments.append((length, rank, rank + n, first - rank, offset))
            ranks[length] += n
            offset += length
        first += n
    table = spark.createDataFrame(
        segments, "s_length bigint, from_rank bigint, to_rank bigint, shift bigint, offset bigint"
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("length", "part")
        .count()
        .select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = (
        rows.withColumn("place", place)
        .join(starts, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("place"))
    )
    # The plan has a bounded number of segments: it follows the lengths, not the documents.
    return ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("s_length"))
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank")),
    ).select(
        F.col("id").alias(id_column),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("rank") + F.col("shift")).alias("sequence_id"),
        "offset",
        *(["ids"] if with_ids else []),
    )
