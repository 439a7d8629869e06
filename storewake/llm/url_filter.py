"""URL rules and host lists by Bloom filter cascades, exact without joins.

The keys that a url could match are its host's suffixes with the beginnings of
its path. The first level of a cascade is a Bloom filter of the listed keys; the
next holds the first one's false positives among all keys that the corpus has,
the next the listed keys that pass that one, and so on until no false positive
is left. A key of the corpus is listed exactly if the first level that rejects
it is an even one (or it passes all of an odd number). Every level is bounded by
the list, not by the corpus, as the first one's rate of false positives follows
the ratio of the two.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storewake.llm.common import land, work_folder

#: Bits of one level; a longer list must be split. 2^28 bits are 32 MB.
MAX_BITS = 1 << 28
_MASK = (1 << 64) - 1
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bit numbers of each key, one row per hash function."""
    step = h2.astype(np.uint64) | np.uint64(1)
    start = h1.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & _MASK)
    turns = np.arange(1, hashes + 1, dtype=np.uint64)[:, None]
    mixed = start[None, :] + turns * (step ^ np.uint64(level))[None, :]
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)) % np.uint64(bits)


class Level(NamedTuple):
    number: int
    hashes: int
    bits: int
    words: np.ndarray

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        places = _positions(h1, h2, self.number, self.hashes, self.bits)
        found = self.words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))
        return (found & np.uint64(1)).all(axis=0)


class Cascade:
    """Membership in a list, exact for all keys of the universe that it was built over."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for level in self.levels:
            if not len(open_):
                break
            open_ = open_[level.passes(h1[open_], h2[open_])]
            out[open_] = level.number % 2 == 1
            # A key rejected here keeps the answer of the level before.
        return out


def _filtered(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            h2 = batch.column("h2").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(level.passes(h1, h2))) if len(h1) else batch

    return keys.mapInArrow(run, "h1 bigint, h2 bigint")


def _level(keys: DataFrame, number: int, size: int, rate: float, max_bits: int) -> Level:
    """A Bloom filter of the keys, gathered as 64 bit words."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(size * hashes / math.log(2)))
    if bits > max_bits:
        raise ValueError(f"a level of {bits} bits is over the bound of {max_bits}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            h2 = batch.column("h2").to_numpy(zero_copy_only=False)
            places = np.unique(_positions(h1, h2, number, hashes, bits))
            word = (places >> np.uint64(6)).astype(np.int64)
            bit = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_pydict({"word": word, "bit": bit})

    rows = keys.mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("w"))
    words = np.zeros((bits + 63) // 64, np.int64)
    for row in rows.collect():  # at most bits / 64 rows
        words[row.word] = row.w
    return Level(number, hashes, bits, words.view(np.uint64))


def build_cascade(
    listed: DataFrame, universe: DataFrame, folder: str, max_bits: int = MAX_BITS
) -> Cascade:
    """A cascade of the `listed` keys (`h1`, `h2`) over all keys of the `universe`."""
    include = land(listed.select("h1", "h2").distinct(), f"{folder}/listed")
    exclude = land(
        universe.select("h1", "h2").distinct().join(include, ["h1", "h2"], "left_anti"),
        f"{folder}/others",
    )
    n_in, n_out = include.count(), exclude.count()
    levels: list[Level] = []
    while n_in:
        number = len(levels) + 1
        rate = min(0.5, n_in / (math.sqrt(2) * max(n_out, 1))) if number == 1 else 0.5
        level = _level(include, number, n_in, rate, max_bits)
        levels.append(level)
        wrong = land(_filtered(exclude, level), f"{folder}/wrong{number}")
        include, exclude = wrong, include
        n_in, n_out = include.count(), n_in
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _LETTERS.upper(), _LETTERS)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, depth: int, beginnings: Sequence[int]) -> Column:
    """All keys of at most `depth` host labels with path beginnings of the given lengths,
    the longest first; of equal lengths the one with the longer host."""
    labels = F.split(host, r"\.", -1)
    size = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(size, F.lit(depth))),
        lambda n: F.array_join(F.slice(labels, size - n + 1, n), "."),
    )
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.filter(
                F.array(
                    *[
                        F.when(
                            F.length(path) >= n,
                            F.struct(
                                (-F.length(s) - n).alias("a"),
                                (-F.length(s)).alias("b"),
                                F.concat(s, F.substring(path, 1, n)).alias("key"),
                            ),
                        )
                        for n in beginnings
                    ]
                ),
                lambda k: k.isNotNull(),
            ),
        )
    )
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def _hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    blocked_hosts: Sequence[str],
    id_column: str = "page_id",
    url_column: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Id, `host`, `path`, `rule` and `verdict`, one row per input row.

    The longest rule that fits decides; without one a url is blocked if its host or
    a domain above it is in `blocked_hosts`. A null url, and one without `://`, has
    an empty host, fits no rule and is allowed. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = work_folder(spark)
    host, path = url_parts(F.col(url_column))
    names = [r.host for r in rules] + list(blocked_hosts)
    depth = max([1, *(n.count(".") + 1 for n in names)])
    beginnings = sorted({0, *(len(r.path) for r in rules)})
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), depth, beginnings))
    one, two = _hashed(F.col("key"))
    universe = rows.select(F.explode("keys").alias("key")).select(one.alias("h1"), two.alias("h2"))
    universe = land(universe.distinct(), f"{folder}/universe")

    def cascade(name: str, keys: Iterable[str]) -> Cascade:
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        return build_cascade(
            listed.select(one.alias("h1"), two.alias("h2")), universe, f"{folder}/{name}", max_bits
        )

    built = spark.sparkContext.broadcast(
        [
            cascade("allow", [r.key for r in rules if r.verdict == "allow"]),
            cascade("block", [r.key for r in rules if r.verdict == "block"]),
            cascade("hosts", blocked_hosts),
        ]
    )

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h1")
            h1 = lists.flatten().to_numpy(zero_copy_only=False)
            h2 = batch.column("h2").flatten().to_numpy(zero_copy_only=False)
            allow, block, hosts = (c.has(h1, h2) for c in built.value)
            ruled = (allow | block).tolist()
            blocked, listed = block.tolist(), hosts.tolist()
            at, verdict, end = [], [], 0
            for n in [len(x) for x in lists.to_pylist()]:
                begin, end = end, end + n
                first = next((i for i in range(begin, end) if ruled[i]), None)
                at.append(None if first is None else first - begin)
                no = blocked[first] if first is not None else any(listed[begin:end])
                verdict.append("block" if no else "allow")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "host", "path", "keys")), pa.array(at, pa.int32()), pa.array(verdict)],
                names=["id", "host", "path", "keys", "at", "verdict"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    probed = rows.withColumns(
        {
            "h1": F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))),
            "h2": F.transform("keys", lambda k: F.xxhash64(k, F.lit(2))),
        }
    ).mapInArrow(
        judge, f"id {kind}, host string, path string, keys array<string>, at int, verdict string"
    )
    return probed.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.get("keys", F.col("at")).alias("rule"),
        "verdict",
    )
