"""Benchmark items found in training texts by rare n-gram seeds and Smith-Waterman alignment.

Seeds are the word n-grams of the items that chance would hardly make: the
product of their words' shares among all words of the corpus is small. Where
neighbouring n-grams are all made of common words, or of words that leaks made
common, the rarest of every few is a seed too, so seeds lie all over an item
and some run of its words that an edited copy kept has one. Where a text shares
a seed with an item, the words around it are aligned with the item; the score is
the share of the best possible one, so edits and insertions lower it a little each.

Items go to the tasks in blocks of bounded size, each block against all texts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewake.llm.common import fresh, land, same, sized, words, work_folder

SEED_WORDS = 3
#: Expected number of a seed at one place of a text.
MAX_CHANCE = 1e-8
#: Of so many neighbouring n-grams one is a seed at least (the rarest, of equal ones the first). With
#: n words in a seed, every 2 * COVER + n - 2 words of an item in a row hold one.
COVER = 2
THRESHOLD = 0.5
BLOCK_ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and its first and last (exclusive) word in the window."""
    n = len(window)
    ramp = -GAP * np.arange(n + 1)
    score = np.zeros(n + 1, np.int64)
    first = np.arange(n + 1)  # where the alignment that ends here began
    best, begin, end = 0, 0, 0
    for word in item:
        diagonal = np.zeros(n + 1, np.int64)
        diagonal[1:] = score[:-1] + np.where(window == word, MATCH, MISMATCH)
        came = np.empty(n + 1, np.int64)
        came[0], came[1:] = 0, first[:-1]
        up = score + GAP
        came = np.where(up > diagonal, first, came)
        base = np.maximum(np.maximum(diagonal, up), 0)
        came = np.where(base > 0, came, np.arange(n + 1))
        lifted = base + ramp
        top = np.maximum.accumulate(lifted)
        from_place = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - ramp
        first = came[from_place]
        place = int(score.argmax())
        if score[place] > best:
            best, begin, end = int(score[place]), int(first[place]), place
    return best, begin, end


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, items: list[tuple], chance: dict[bytes, float], n: int, max_chance: float, cover: int):
        self.items: list[tuple[object, list[bytes]]] = []
        self.seeds: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
        self.sizes: set[int] = set()
        for item_id, text in items:
            tokens = words(text)
            if not tokens:
                continue
            size = min(n, len(tokens))
            grams = [
                (sum(chance[w] for w in tokens[i : i + size]), i) for i in range(len(tokens) - size + 1)
            ]
            rare = {i for c, i in grams if c <= math.log(max_chance)}
            rare |= {min(grams[i : i + cover])[1] for i in range(0, len(grams), cover)}
            number = len(self.items)
            self.items.append((item_id, tokens))
            self.sizes.add(size)
            for i in sorted(rare):
                self.seeds[tuple(tokens[i : i + size])].append((number, i))
        self.seeds = dict(self.seeds)


def _clusters(places: list[int], reach: int) -> Iterator[tuple[int, int]]:
    begin = end = places[0]
    for place in places[1:]:
        if place - end > reach:
            yield begin, end
            begin = place
        end = place
    yield begin, end


def found_in(tokens: list[bytes], block: Items, threshold: float) -> list[tuple]:
    """(item, score, first word, last word exclusive) of the items that a text holds."""
    hits: dict[int, list[int]] = defaultdict(list)
    seeds = block.seeds
    for size in block.sizes:
        for place, gram in enumerate(zip(*(tokens[k:] for k in range(size)), strict=False)):
            if gram in seeds:
                for number, _ in seeds[gram]:
                    hits[number].append(place)
    out = []
    for number, places in hits.items():
        item_id, wanted = block.items[number]
        have, best = set(wanted), None
        codes = {w: i for i, w in enumerate(have)}
        item = np.array([codes[w] for w in wanted])
        for begin, end in _clusters(sorted(places), 2 * len(wanted)):
            first = max(0, begin - 2 * len(wanted))
            window = tokens[first : end + 2 * len(wanted)]
            # No alignment scores more than the item's words that the window has at all.
            common = Counter(wanted) & Counter(w for w in window if w in have)
            if common.total() < threshold * len(wanted):
                continue
            score, a, b = align(item, np.array([codes.get(w, -1) for w in window]))
            share = score / (MATCH * len(wanted))
            if best is None or share > best[1]:
                best = (item_id, share, first + a, first + b)
        if best and best[1] >= threshold:
            out.append(best)
    return out


def _word_counts(texts: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """How often the vocabulary's words occur in all texts, and the number of all words."""
    spread = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                total += len(tokens)
                counts.update(filter(spread.value.__contains__, tokens))
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([*counts, None], pa.binary()),
                "n": pa.array([*counts.values(), total], pa.int64()),
            }
        )

    rows = texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {None if r.word is None else bytes(r.word): r.n for r in rows.collect()}  # a row per word of the block
    return counts, counts.pop(None, 0) or 0


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    seed_words: int = SEED_WORDS,
    max_chance: float = MAX_CHANCE,
    cover: int = COVER,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Id, `item_id`, `score`, `first_word`, `last_word` (exclusive): one row per text and item found.

    Null and empty texts and items hold nothing; an item shorter than a seed is its
    own seed. Of several places in a text the best counts, of equal ones the first.
    Repeated rows of `docs` give repeated results, repeated items (equal id and
    text) count once. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"id {id_type}, item_id {item_type}, score double, first_word int, last_word int"
    items = land(
        benchmark.select("item_id", "text").where(F.length("text") > 0).distinct().orderBy("item_id", "text"),
        f"{work_folder(spark)}/items",
    )
    out = None
    for chunk in _blocks(items, block_items):
        vocabulary = frozenset(w for _, text in chunk for w in words(text))
        counts, total = _word_counts(source, vocabulary)
        chance = {w: math.log((counts.get(w, 0) + 1) / (total + len(vocabulary) + 1)) for w in vocabulary}
        block = spark.sparkContext.broadcast(Items(chunk, chance, seed_words, max_chance, cover))

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for leak in found_in(words(text), block.value, threshold):
                        rows.append(row)
                        found.append(leak)
                made = [pa.array([f[k] for f in found]) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(rows, pa.int64())),
                        made[0].cast(pa.int64()) if item_type == "bigint" else made[0].cast(pa.string()),
                        made[1].cast(pa.float64()),
                        made[2].cast(pa.int32()),
                        made[3].cast(pa.int32()),
                    ],
                    names=["id", "item_id", "score", "first_word", "last_word"],
                )

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_column)


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most `size`, one block on the driver at a time."""
    block: list[tuple] = []
    for row in items.toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns.

    A row goes if a row with its id and text holds an item; null ids are ids.
    """
    mark = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    (key,) = fresh(docs, "_mark")
    marked = docs.select(mark.alias("mark"), "text")
    bad = land(
        leaks(marked, benchmark, id_column="mark", **options).select(F.col("mark").alias(key)).distinct(),
        f"{work_folder(docs.sparkSession)}/leaks",
    )
    return docs.join(sized(bad), same(mark, F.col(key)), "left_anti")
