"""Lines that many documents share, counted in levelled sorted runs of line hashes.

Documents come in batches. A batch becomes one run: line hash and number of the
batch's documents with that line, sorted by hash. Before a batch adds its run it
anti-joins the runs: hashes that a run already holds as frequent need no more
counting. A level that is full is compacted into one run of the next level, so
the number of runs grows with the logarithm of the batches.

A line's key is the line without white space (U+0009 to U+000D and blank) at
both ends and with A-Z in lower case; keys are compared by 128 bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storewake.llm.common import BROADCAST_ROWS, land, same, work_folder

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 4
#: Distinct hashes that a task counts before it hands its counts on.
FLUSH = 200_000

_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Stripped, A-Z in lower case (other letters are left alone)."""
    return line.strip(_BLANK).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _line_counts(texts: DataFrame, min_chars: int) -> DataFrame:
    """Line hash and number of documents, partial per task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(
                {"key": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())}
            )
            found.clear()
            return made

        for batch in batches:
            for data in _texts(batch, "text"):
                keys = {line_key(line) for line in (data or b"").split(b"\n")}
                found.update(_hash(k) for k in keys if _long_enough(k, min_chars))
                if len(found) >= FLUSH:
                    yield out()
        yield out()

    return texts.mapInArrow(count, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class LineRuns:
    """Runs by level, each a table of `key` and `n` sorted by key within its files."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark = spark
        self.min_docs = min_docs
        self.fanout = fanout
        self.folder = work_folder(spark)
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-run{self.made}"
        self.made += 1
        counts.sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)

    def _merged(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*paths).groupBy("key").agg(F.sum("n").alias("n"))

    @property
    def paths(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def add(self, counts: DataFrame) -> None:
        """One batch: what the runs do not yet know as frequent becomes a run of its own."""
        if self.paths:
            settled = self.spark.read.parquet(*self.paths).where(F.col("n") >= self.min_docs)
            counts = counts.join(settled.select("key"), "key", "left_anti")
        self._write(counts, 0)

    def frequent(self) -> DataFrame:
        """Hashes of the lines found in at least `min_docs` documents."""
        if not self.paths:
            return self.spark.createDataFrame([], "key binary")
        return self._merged(self.paths).where(F.col("n") >= self.min_docs).select("key")


def _without(data: bytes | None, drop, min_chars: int) -> tuple[bytes, int, int]:
    lines = (data or b"").split(b"\n")
    kept = []
    for line in lines:
        key = line_key(line)
        if not (_long_enough(key, min_chars) and _hash(key) in drop):
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


_RESULT = "id {id}, text string, n_lines bigint, n_dropped bigint, kept_sha256 string"


def _rows(ids: pa.Array, kept: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([k[0] for k in kept], pa.binary()).cast(pa.string()),
            pa.array([k[1] for k in kept], pa.int64()),
            pa.array([k[2] for k in kept], pa.int64()),
            pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string()),
        ],
        names=["id", "text", "n_lines", "n_dropped", "kept_sha256"],
    )


def without_shared_lines(
    batches: Sequence[DataFrame],
    id_column: str = "doc_id",
    text_column: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    fanout: int = FANOUT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Id, kept `text`, `n_lines`, `n_dropped` and `kept_sha256`, one row per input row.

    A line whose key is found in at least `min_docs` rows of all batches goes from
    every row; a line counts once per row, repeated rows count each. Null and
    empty texts are one empty line; keys under `min_chars` code points stay. Null
    ids are ids, other columns are not read. Up to `broadcast_rows` frequent
    hashes go to the tasks as a set; more are joined to the documents' lines.
    """
    spark = batches[0].sparkSession
    rows = [b.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")) for b in batches]
    runs = LineRuns(spark, min_docs, fanout)
    for batch in rows:
        runs.add(_line_counts(batch.select("text"), min_chars))
    frequent = land(runs.frequent(), f"{runs.folder}/frequent")
    docs = rows[0]
    for batch in rows[1:]:
        docs = docs.unionByName(batch)
    schema = _RESULT.format(id=docs.schema["id"].dataType.simpleString())
    if frequent.count() <= broadcast_rows:
        known = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in frequent.collect()))

        def drop(items: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in items:
                kept = [_without(data, known.value, min_chars) for data in _texts(batch, "text")]
                yield _rows(batch.column("id"), kept)

        out = docs.mapInArrow(drop, schema)
    else:
        out = _dropped_by_join(docs, frequent, min_chars, schema)
    return out.withColumnRenamed("id", id_column)


def _dropped_by_join(docs: DataFrame, frequent: DataFrame, min_chars: int, schema: str) -> DataFrame:
    """The same for frequent sets of any size: each row's line hashes meet them in a join."""
    id_type = docs.schema["id"].dataType.simpleString()

    def keys(items: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            ids, hashes, found = batch.column("id").to_pylist(), batch.column("h").to_pylist(), []
            for i, h, data in zip(ids, hashes, _texts(batch, "text"), strict=True):
                lines = {line_key(line) for line in (data or b"").split(b"\n")}
                found += [(i, h, _hash(k)) for k in lines if _long_enough(k, min_chars)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], batch.column("id").type),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.binary()),
                ],
                names=["id", "h", "key"],
            )

    def drop(items: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            gone = batch.column("gone").to_pylist()
            kept = [
                _without(data, frozenset(g or ()), min_chars)
                for data, g in zip(_texts(batch, "text"), gone, strict=True)
            ]
            yield _rows(batch.column("id"), kept)

    hashed = docs.withColumn("h", F.xxhash64("text"))
    gone = (
        hashed.mapInArrow(keys, f"id {id_type}, h bigint, key binary")
        .distinct()
        .join(frequent, "key", "left_semi")
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))
        .agg(F.collect_list("key").alias("gone"))
    )
    return (
        hashed.join(gone, same(F.col("id"), F.col("_id")) & (F.col("h") == F.col("_h")), "left")
        .select("id", "text", "gone")
        .mapInArrow(drop, schema)
    )


def file_batches(spark: SparkSession, docs: DataFrame, batches: int) -> list[DataFrame]:
    """The files of a table in batches, in the order of their names."""
    files = sorted(docs.inputFiles())
    if len(files) < 2:
        return [docs]
    size = -(-len(files) // batches)
    return [spark.read.parquet(*files[i : i + size]) for i in range(0, len(files), size)]
