"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training texts are counted once. A count is quantised to a level, the number of
steps of a geometric ladder (1, 2, 3, ... then times `LADDER`) that it reaches, and
the filter holds one membership for every (n-gram, step) up to that level. A
reader probes the steps of an n-gram in turn until one is absent; the last one
present stands for the count. Counts are never too low; each step too high needs
a false positive of its own.

The model interpolates from single words up: p(w|h) = a c(hw) / c(h) + (1 - a) p(w|shorter h), where
a word on its own has (c + 0.5) / (N + 0.5 (V + 1)). The weight a belongs to the level of
c(h); it is the one under which the training texts are likeliest when each token is left out
of the counts that judge it, found from a histogram over all training tokens. A
history that was never seen leaves the shorter one's value.

The filter lies in buckets of n-grams, whose number grows with the bytes of the training texts;
every bucket has as many bits as its own n-grams need. One exchange brings the counts that
tasks have packed to their buckets. A filter of at most `broadcast_bytes` goes to the
workers; a larger one stays a table, and the distinct probes of all texts travel to the
buckets instead. Both ways read the same bits.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and one end after each
text (null is the empty text). They are compared by 64 bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.llm.common import land, work_folder

FOLDS = 5
HELD_OUT_FOLD = 1
ORDER = 2
LADDER = 1.35
BITS_PER_STEP = 12
PROBES = 4
#: Bytes of training text per bucket of the filter.
BUCKET_BYTES = 8 << 20
BROADCAST_BYTES = 128 << 20
#: Distinct n-grams that a task holds before it hands its counts on.
HELD_GRAMS = 1 << 20
#: The most frequent words, whose exact counts go to every task: at most so many.
HEAD_WORDS = 1 << 18
#: Bytes of text that a task looks at in one go; longer texts are cut between words.
SLICE = (1 << 21) - (1 << 16)

_U = np.uint64
_MASK = (1 << 64) - 1
#: Bins of the histogram that weights are fitted to: eighths of powers of two.
_BINS = 512
_NONE = np.zeros(0, np.int64)
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_STEP = 0x9E3779B97F4A7C15
_POWER = 0xD6E8FEB86659FD93
END = _U(0x2545F4914F6CDD1D)
START = _U(0x632BE59BD9B4E019)


def is_held_out(doc_id: Column) -> Column:
    """Rows that teach nothing; a null id counts as the empty string."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % FOLDS == HELD_OUT_FOLD


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _joined(left: np.ndarray, right: np.ndarray | np.uint64) -> np.ndarray:
    return _mixed(left * _U(_POWER) + right)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _U(_POWER))
    down = np.full(size, _U(pow(_POWER, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts that lie behind one another, and each word's text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACES[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = word[begins]
    stops = offsets[1:][offsets[1:] > 0] - 1
    last[stops] = word[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(1 << max(21, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(_LETTERS[data], up[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return _mixed(hashes), np.searchsorted(offsets, starts, "right") - 1


def _cut(data: np.ndarray, offsets: np.ndarray, low: int) -> int:
    """Where the slice that begins at `low` ends: between texts or before white space."""
    high = low + SLICE
    if high >= len(data):
        return len(data)
    border = int(offsets[np.searchsorted(offsets, high)])
    while high < border:
        space = np.flatnonzero(_SPACES[data[high : min(high + 4096, border)]])
        if len(space):
            return high + int(space[0])
        high += 4096
    return border


@dataclass
class Tokens:
    """Tokens of one slice: their hashes, texts, and the tokens one, two, ... places before."""

    words: np.ndarray
    texts: np.ndarray
    before: list[np.ndarray]


def token_slices(column: pa.Array, order: int) -> Iterator[Tokens]:
    """All tokens of a column of texts, slice by slice, with the end of every text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, places, buffer = column.buffers()
    whole = np.frombuffer(places, np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = whole[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    carry = [START] * (order - 1)
    low = done = 0
    while done < len(column):
        high = _cut(data, offsets, low)
        hashes, texts = _word_hashes(data[low:high], np.clip(offsets, low, high) - low)
        ended = int(np.searchsorted(offsets[1:], high, "right"))
        over = np.arange(done, ended)
        at = np.searchsorted(texts, over, "right") + np.arange(len(over))
        words = np.full(len(hashes) + len(over), END)
        owner = np.empty(len(words), np.int64)
        places_of = np.arange(len(hashes)) + (texts - done)
        words[places_of], owner[places_of], owner[at] = hashes, texts, over
        after = at[at + 1 < len(words)] + 1
        before, current, fresh = [], words, len(at) > 0 and at[-1] == len(words) - 1
        for n in range(order - 1):
            shifted = np.concatenate([[carry[n]], current[:-1]]).astype(np.uint64)[: len(words)]
            shifted[after] = START
            if len(words):
                carry[n] = START if fresh else current[-1]
            before.append(shifted)
            current = shifted
        yield Tokens(words, owner, before)
        low, done = high, ended


def _gram(tokens: list[np.ndarray]) -> np.ndarray:
    key = _mixed(tokens[0] + _U(1))
    for token in tokens[1:]:
        key = _joined(key, token)
    return key


def _keys(tokens: Tokens) -> Iterator[tuple[np.ndarray | None, np.ndarray | None, np.ndarray]]:
    """For every order the keys of the histories (none for single words), which tokens have such a
    history (all if none is given), and the n-grams' keys."""
    words, before = tokens.words, tokens.before
    yield None, None, words
    if before:
        yield np.where(before[0] == START, END, before[0]), None, _gram([before[0], words])
    for k in range(1, len(before)):
        far = before[k::-1]
        yield _gram(far), before[k - 1] != START, _gram([*far, words])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    all_keys = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(all_keys, kind="stable")
    all_keys, n = all_keys[order], np.concatenate([_NONE, *counts])[order]
    starts = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else _NONE
    return all_keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((_mixed(keys + _U(_STEP)) >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


_PACKED = "bucket int, words binary, word_counts binary, grams binary, gram_counts binary"


def packed_counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """Counts of single words and of longer n-grams, per task and bucket that it meets one row of packed arrays."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            parts, present = [], set()
            for keys, counts in (held[:2], held[2:]):
                keys, counts = _summed(keys, counts)
                at = _bucket_of(keys, buckets)
                by_bucket = np.argsort(at, kind="stable")
                parts.append((keys[by_bucket], counts[by_bucket], at[by_bucket]))
                present.update(np.unique(at).tolist())
            filled = np.array(sorted(present), np.int64)
            columns: list[list] = []
            for keys, counts, at in parts:
                edges = np.stack([np.searchsorted(at, filled), np.searchsorted(at, filled, "right")], axis=1).tolist()
                columns += [[x[a:b].tobytes() for a, b in edges] for x in (keys, counts)]
            for some in held:
                some.clear()
            names = ["bucket", "words", "word_counts", "grams", "gram_counts"]
            return pa.RecordBatch.from_arrays(
                [pa.array(filled.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=names
            )

        for batch in batches:
            for tokens in token_slices(batch.column("text"), order):
                for history, some, keys in _keys(tokens):
                    found, n = np.unique(keys if some is None else keys[some], return_counts=True)
                    at = 0 if history is None else 2
                    held[at].append(found)
                    held[at + 1].append(n.astype(np.int64))
                    size += len(found)
                if size > HELD_GRAMS:
                    for at in (0, 2):
                        keys, n = _summed(held[at], held[at + 1])
                        held[at], held[at + 1] = [keys], [n]
                    size = len(held[0][0]) + len(held[2][0])
                    if size > HELD_GRAMS:
                        yield out()
                        size = 0
        if size:
            yield out()

    return texts.mapInArrow(count, _PACKED)


@lru_cache(maxsize=4)
def ladder(factor: float) -> np.ndarray:
    """The counts at which a new step begins."""
    steps = [1]
    while steps[-1] < 1 << 61:
        steps.append(max(steps[-1] + 1, math.ceil(steps[-1] * factor)))
    return np.array(steps, np.int64)


def _levels(counts: np.ndarray, factor: float) -> np.ndarray:
    return np.searchsorted(ladder(factor), counts, "right")


@lru_cache(maxsize=4)
def middles(factor: float) -> np.ndarray:
    """The count that stands for each level: the middle of those that share it; 0 at level 0."""
    steps = ladder(factor).astype(float)
    return np.concatenate([[0.0], (steps[:-1] + steps[1:] - 1) / 2, steps[-1:]])


def _first_places(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes for one step of the keys begin, and how far apart they are."""
    mixed = _mixed(keys + _U(step * _STEP & _MASK))
    return mixed, _mixed(mixed) | _U(1)


def _place(mixed: np.ndarray, bits: np.ndarray | np.uint64) -> np.ndarray:
    return ((mixed >> _U(32)) * bits) >> _U(32)


def _bucket_bits(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """A Bloom filter with room for all steps of all keys."""
    size = max(64, -(-int(levels.sum()) * BITS_PER_STEP // 64) * 64)
    bits = np.zeros(size, bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        stay = levels >= step
        keys, levels = keys[stay], levels[stay]
        mixed, stride = _first_places(keys, step)
        for _ in range(PROBES):
            bits[_place(mixed, _U(size))] = True
            mixed = mixed + stride
    return np.packbits(bits, bitorder="little").tobytes()


class Probe:
    """Levels of keys by repeated membership probes, step by step until one is absent.

    `bits` holds the buckets one after another; `edges` are their first bytes, and the end.
    """

    def __init__(self, bits: bytes, edges: np.ndarray):
        self.bits = np.frombuffer(bits, np.uint8)
        self.starts = edges[:-1].astype(np.uint64) * _U(8)
        self.sizes = np.diff(edges).astype(np.uint64) * _U(8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        at_bucket = _bucket_of(keys, len(self.sizes))
        start, size = self.starts[at_bucket], self.sizes[at_bucket]
        levels = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        step = 0
        while len(alive):
            step += 1
            mixed, stride = _first_places(keys, step)
            for _ in range(PROBES):
                places = _place(mixed, size) + start
                there = (self.bits[places >> _U(3)] >> (places & _U(7)).astype(np.uint8)) & 1 == 1
                left = np.flatnonzero(there)
                if len(left) < len(there):
                    alive, keys, mixed, stride, start, size = (
                        x.take(left) for x in (alive, keys, mixed, stride, start, size)
                    )
                mixed = mixed + stride
            levels[alive] = step
        return levels


@dataclass
class Filter:
    """The buckets as a table (`bucket`, `bits`), exact counts of single words, and their sums."""

    table: DataFrame
    words: DataFrame
    buckets: int
    bytes: int
    order: int
    factor: float
    tokens: int
    vocabulary: int
    folder: str

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.vocabulary + 1)


def count_filter(texts: DataFrame, order: int = ORDER, factor: float = LADDER) -> Filter:
    """Count the n-grams of all `text` rows and write them into a filter."""
    folder = work_folder(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size * (order - 1) // BUCKET_BYTES

    def build(group: pa.Table) -> pa.Table:
        made = []
        for name, n in (("words", "word_counts"), ("grams", "gram_counts")):
            keys = [np.frombuffer(x, np.uint64) for x in group.column(name).to_pylist()]
            made.append(_summed(keys, [np.frombuffer(x, np.int64) for x in group.column(n).to_pylist()]))
        (words, word_counts), (grams, gram_counts) = made
        levels = np.concatenate([_levels(word_counts, factor), _levels(gram_counts, factor)])
        bits = _bucket_bits(np.concatenate([words, grams]), levels)
        return pa.table(
            {
                "bucket": group.column("bucket").slice(0, 1),
                "bits": pa.array([bits], pa.binary()),
                "words": pa.array([words.tobytes()], pa.binary()),
                "word_counts": pa.array([word_counts.tobytes()], pa.binary()),
            }
        )

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("word_counts").to_pylist(), strict=True):
                keys, counts = np.frombuffer(words, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    table = land(
        packed_counts(texts, order, buckets)
        .groupBy("bucket")
        .applyInArrow(build, "bucket int, bits binary, words binary, word_counts binary"),
        f"{folder}/filter",
    )
    words = land(
        table.select("words", "word_counts").mapInArrow(unpack, "key bigint, n bigint"), f"{folder}/words"
    )
    sums = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).first()
    bytes_ = table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    return Filter(
        table.select("bucket", "bits"), words, buckets, bytes_, order, factor, sums.tokens or 0, sums.words, folder
    )


def collected(made: Filter) -> tuple[bytes, np.ndarray]:
    """All bits, and where the buckets begin: what `Probe` takes. Of checked size."""
    found: dict[int, bytes] = {r.bucket: r.bits for r in made.table.toLocalIterator()}
    empty = bytes(8)
    parts = [found.get(b, empty) for b in range(made.buckets)]
    return b"".join(parts), np.cumsum([0, *map(len, parts)])


def _ratios(seen: np.ndarray, total: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bins of how much likelier the history makes a token than the shorter one does, the token itself left out."""
    share = np.maximum(np.minimum(seen, total) - 1, 0) / np.maximum(total - 1, 1)
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log2(share / shorter) * 8) + _BINS // 2, 0, _BINS - 1).astype(np.int64)


def fitted_weights(histogram: np.ndarray) -> np.ndarray:
    """Per level the weight a that makes sum(n log(1 - a + a r)) largest; bin 0 has r = 0."""
    r = 2.0 ** ((np.arange(_BINS) - _BINS // 2 + 0.5) / 8)
    r[0] = 0.0
    low, high = np.zeros(len(histogram)), np.full(len(histogram), 0.999)
    for _ in range(40):
        a = (low + high) / 2
        slope = (histogram * (r - 1) / (1 - a[:, None] + a[:, None] * r)).sum(1)
        low, high = np.where(slope > 0, a, low), np.where(slope > 0, high, a)
    return low


class _Scorer:
    """Probabilities of the tokens of slices, by probes."""

    def __init__(self, probe: Probe, factor: float, denominator: float, weights: list[np.ndarray]):
        self.probe, self.denominator, self.weights = probe, denominator, weights
        self.middle = middles(factor)

    def probabilities(self, tokens: Tokens, meet=None) -> np.ndarray:
        """`meet` is called with order, levels of the histories, and bins of `_ratios`.

        A token's history is the n-gram, one order down, that ends just before it: its level is known already.
        A text's first token has the end before it, which is as frequent as a start.
        """
        p = np.zeros(0)
        earlier = None
        if not len(tokens.words):
            return p
        for k, (history, some, keys) in enumerate(_keys(tokens)):
            if history is None:
                distinct, back = np.unique(keys, return_inverse=True)
                levels = self.probe.levels(distinct)[back]
                p = (self.middle[levels] + 0.5) / self.denominator
            else:
                chosen = slice(None) if some is None else some
                before = np.concatenate([self.probe.levels(history[:1]), earlier[:-1]])[chosen]
                levels = np.zeros(len(keys), np.int64)
                distinct, back = np.unique(keys[chosen], return_inverse=True)
                levels[chosen] = self.probe.levels(distinct)[back]
                seen, total, shorter = self.middle[levels[chosen]], self.middle[before], p[chosen]
                if meet is not None:
                    meet(k - 1, before, _ratios(seen, total, shorter))
                if k - 1 < len(self.weights):
                    a = np.where(total > 0, self.weights[k - 1][before], 0.0)
                    p[chosen] = a * np.minimum(seen, total) / np.maximum(total, 1) + (1 - a) * shorter
            earlier = levels
        return p


def _histogram(texts: DataFrame, made: Filter, shipped, weights: list[np.ndarray]) -> np.ndarray:
    """For the next order, levels by bins: numbers of training tokens."""
    order, factor, denominator, at = len(weights) + 2, made.factor, made.denominator, len(weights)
    levels = len(middles(factor))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(Probe(*shipped.value), factor, denominator, weights)
        sums = np.zeros(levels * _BINS, np.int64)

        def meet(k: int, level: np.ndarray, bins: np.ndarray) -> None:
            if k == at:
                sums[:] += np.bincount(level * _BINS + bins, minlength=len(sums))

        for batch in batches:
            for tokens in token_slices(batch.column("text"), order):
                scorer.probabilities(tokens, meet)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], names=["cell", "n"])

    cells = texts.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    return _as_histogram(cells, levels)


def _as_histogram(cells: DataFrame, levels: int) -> np.ndarray:
    """`cell` and `n` as an array; there are at most levels times bins of them."""
    out = np.zeros(levels * _BINS)
    for r in cells.collect():
        out[r.cell] = r.n
    return out.reshape(levels, _BINS)


def _head(counts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent words, at most `words`: all above one count."""
    size = F.floor(F.log2("n") * 8)
    left, least = words, None
    by_size = {r.size: r.words for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()}
    for at in sorted(by_size, reverse=True):
        if by_size[at] > left:
            break
        left, least = left - by_size[at], at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(size >= least).toArrow()
    keys, n = _unsigned(table.column("key")), table.column("n").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(keys)
    return keys[order], np.ascontiguousarray(n[order])


def _pairs(texts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by text, and how often each occurs."""
    order = np.lexsort((words, texts))
    texts, words = texts[order], words[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (words[1:] != words[:-1])
    at = np.flatnonzero(new)
    return texts[at], words[at].view(np.int64), np.diff(np.append(at, len(texts)))


_SUMS = (
    "row bigint, id {id}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "rare array<bigint>, times array<bigint>"
)


def _first_pass(docs: DataFrame, made: Filter, shipped, weights: list[np.ndarray], head_words: int) -> DataFrame:
    """Per row the sums over frequent words, the rare words with their numbers, and, where
    the filter is at hand, the model's score."""
    schema = _SUMS.format(id=docs.schema["id"].dataType.simpleString())
    head = docs.sparkSession.sparkContext.broadcast(_head(made.words, head_words))
    order, factor, denominator = made.order, made.factor, made.denominator

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = head.value
        scorer = None if shipped is None else _Scorer(Probe(*shipped.value), factor, denominator, weights)
        for batch in batches:
            size = batch.num_rows
            total, known = np.zeros(size), np.zeros(size)
            base_sum, model_sum = np.zeros(size), np.zeros(size)
            owners, rare, times = [], [], []
            for tokens in token_slices(batch.column("text"), order):
                words, texts = tokens.words, tokens.texts
                total += np.bincount(texts, minlength=size)
                at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
                hit = keys[at] == words if len(keys) else np.zeros(len(words), bool)
                known += np.bincount(texts[hit], minlength=size)
                logs = np.log10((n[at[hit]] + 0.5) / denominator)
                base_sum += np.bincount(texts[hit], weights=logs, minlength=size)
                for found, made_of in zip((owners, rare, times), _pairs(texts[~hit], words[~hit]), strict=True):
                    found.append(made_of)
                if scorer is not None:
                    found = np.log10(scorer.probabilities(tokens))
                    model_sum += np.bincount(texts, weights=found, minlength=size)
            starts = np.searchsorted(np.concatenate([_NONE, *owners]), np.arange(size + 1))
            offsets = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array(total.astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(base_sum),
                    pa.array(model_sum),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([_NONE, *rare]))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([_NONE, *times]))),
                ],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )

    return docs.mapInArrow(score, schema)


def _levels_by_bucket(keys: DataFrame, made: Filter) -> DataFrame:
    """`key` and `level` of distinct keys, which meet their buckets by an exchange."""
    buckets = made.buckets

    def with_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bucket_of(_unsigned(batch.column("key")), buckets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(at.astype(np.int32))], names=["key", "bucket"]
            )

    def answer(wanted: pa.Table, bucket: pa.Table) -> pa.Table:
        keys = _unsigned(wanted.column("key")) if wanted.num_rows else np.zeros(0, np.uint64)
        found = np.zeros(len(keys), np.int64)
        if bucket.num_rows and len(keys):
            bits, at = bucket.column("bits")[0].as_py(), int(wanted.column("bucket")[0].as_py())
            edges = np.zeros(buckets + 1, np.int64)
            edges[at + 1 :] = len(bits)
            found = Probe(bits, edges).levels(keys)
        return pa.table({"key": _signed(keys), "level": pa.array(found)})

    placed = keys.mapInArrow(with_bucket, "key bigint, bucket int")
    return placed.groupBy("bucket").cogroup(made.table.groupBy("bucket")).applyInArrow(answer, "key bigint, level bigint")


def _scores_by_bucket(docs: DataFrame, made: Filter) -> DataFrame:
    """`row` and `score` without sending the filter round.

    The longest n-gram at a token determines the shorter ones, so probabilities are made once
    per distinct longest n-gram and joined to the rows.
    """
    order, middle = made.order, middles(made.factor)
    names = ["word", *[f"{name}{k}" for k in range(2, order + 1) for name in ("history", "gram")]]

    def columns_of(tokens: Tokens) -> list[np.ndarray]:
        out = []
        for history, some, keys in _keys(tokens):
            if history is None:
                out.append(keys)
            else:
                # A token without such a history asks for one that no text has.
                out += [history if some is None else np.where(some, history, START), keys]
        return out

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taught = ~np.array(batch.column("held_out").to_pylist(), bool)
            for tokens in token_slices(batch.column("text"), order):
                columns = columns_of(tokens)
                top, at, back = np.unique(columns[-1], return_index=True, return_inverse=True)
                n = np.bincount(back, weights=taught[tokens.texts], minlength=len(top)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(_signed(c[at]) for c in columns), pa.array(n)], names=[*names, "n"])

    def emit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for tokens in token_slices(batch.column("text"), order):
                texts, top, times = _pairs(tokens.texts, columns_of(tokens)[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[texts]), pa.array(top), pa.array(times)], names=["row", "top", "times"]
                )

    grams = docs.mapInArrow(emit, ", ".join(f"{c} bigint" for c in [*names, "n"]))
    grams = land(grams.groupBy(*names).agg(F.sum("n").alias("n")), f"{made.folder}/grams")
    probes = grams.select(F.explode(F.array(*names)).alias("key")).distinct()
    answers = land(_levels_by_bucket(probes, made), f"{made.folder}/answers")
    for name in names:
        grams = grams.join(answers.select(F.col("key").alias(name), F.col("level").alias(f"l_{name}")), name)
    grams = land(grams.select(F.col(names[-1]).alias("top"), "n", *[f"l_{n}" for n in names]), f"{made.folder}/levels")
    count = F.array(*[F.lit(float(m)) for m in middle])
    by_level = lambda values, name: F.element_at(values, F.col(f"l_{name}").cast("int") + 1)
    p = (by_level(count, "word") + 0.5) / F.lit(made.denominator)
    for k in range(2, order + 1):
        total = by_level(count, f"history{k}")
        seen = F.least(by_level(count, f"gram{k}"), total)
        share = F.greatest(seen - 1, F.lit(0.0)) / F.greatest(total - 1, F.lit(1.0))
        bin_ = F.floor(F.log2(share / p) * 8) + _BINS // 2
        bin_ = F.when(share > 0, F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), bin_))).otherwise(F.lit(0))
        known = F.lit(True) if k == 2 else F.col(f"l_history{k}") > 0
        cells = grams.where((F.col("n") > 0) & known).groupBy(
            (F.col(f"l_history{k}") * _BINS + bin_).alias("cell")
        )
        histogram = _as_histogram(cells.agg(F.sum("n").alias("n")), len(middle))
        weights = fitted_weights(histogram)
        a = F.when(total > 0, by_level(F.array(*[F.lit(float(w)) for w in weights]), f"history{k}")).otherwise(F.lit(0.0))
        p = a * seen / F.greatest(total, F.lit(1.0)) + (1 - a) * p
    logs = land(grams.select("top", F.log10(p).alias("log")), f"{made.folder}/logs")
    rows = docs.mapInArrow(emit_rows, "row bigint, top bigint, times bigint").join(logs, "top")
    return rows.groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("score"))


def scored(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: int = ORDER,
    factor: float = LADDER,
    broadcast_bytes: int = BROADCAST_BYTES,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`, one row per input row.

    `base_score` is the exact add-half unigram score, `score` the filter's model, both
    log10 over all tokens of the text and its end. Null texts are empty texts: one end.
    A null id belongs to the training rows. Equal rows get equal results. Without
    training rows every probability is 1 and both scores are 0. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    taught = source.where(~is_held_out(F.col("id"))).select("text")
    made = count_filter(taught, order, factor)
    rows = source.select(
        F.monotonically_increasing_id().alias("row"), "id", is_held_out(F.col("id")).alias("held_out"), "text"
    )
    shipped, weights = None, []
    if made.bytes > broadcast_bytes:
        rows = land(rows, f"{made.folder}/rows")
    else:
        shipped = context.broadcast(collected(made))
        for _ in range(2, order + 1):
            weights.append(fitted_weights(_histogram(taught, made, shipped, weights)))
    first = land(_first_pass(rows, made, shipped, weights, head_words), f"{made.folder}/sums")
    if shipped is not None:
        shipped.unpersist()
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    counted = rare.select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times")).join(
        made.words, "key", "left"
    )
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(made.denominator))).alias("tail"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"),
    )
    out = first.drop("rare", "times").join(tail, "row", "left")
    if shipped is None:
        out = out.drop("score").join(_scores_by_bucket(rows, made), "row", "left")
    return out.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(made.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail", F.lit(0.0))).alias("base_score"),
        "score",
    )
