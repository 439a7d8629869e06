"""Near-duplicates by word n-gram Jaccard: a MinHash LSH forest with exact verification.

Texts with equal shingle sets are one class, so copies cost one row. Each class
has a signature per tree of the forest; classes that share a prefix of a tree's
signature are candidates. Prefixes start long and are shortened by one until the
links that were found say that hardly any is missing: a link of similarity s is
seen with probability `1 - (1 - s^depth)^trees`, so the found ones estimate how
many are not. The threshold itself must be met with `FLOOR` at least.

Candidate classes of one connected group are compared in blocks: a task holds two
blocks of at most `BLOCK` classes, verifies the pairs that share a prefix on
their exact shingle sets and returns a number of links per class and a spanning
forest of them, never the pairs. So a group of any size is spread over tasks and
makes rows in proportion to its classes times its blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewake.llm.common import fresh, land, same, sized, words, work_folder
from storewake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
TREES = 20
DEPTHS = (6, 5, 4)
FLOOR = 0.99
MISSING = 1e-4
BLOCK = 256
#: Similarities of found links are counted in bins of this width.
_BINS = 20
_SEED = 20240229
#: Keys that a task remembers, so that copies in its rows make one set of nodes.
REMEMBERED = 300_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64 bit hashes of the runs of `size` words; fewer words are one shingle."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops, strict=True)], np.uint64))


def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 1 << 63, (2, count), np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), made[1]


def signature(found: np.ndarray, count: int) -> np.ndarray:
    """`count` 32 bit minima of a shingle set under as many hash functions."""
    odd, add = _parameters(count)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    mixed = found ^ (found >> np.uint64(31))
    for at in range(0, len(mixed), 512):
        part = mixed[at : at + 512, None] * odd[None, :] + add[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def prefixes(sig: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Hash of each tree's first `depth` minima, for rows of signatures."""
    parts = sig.reshape(len(sig), trees, -1)[:, :, :depth].astype(np.uint64)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(depth):
        out = (out ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def seen(similarity: np.ndarray | float, depth: int, trees: int = TREES):
    """Probability that two sets of a similarity share a prefix."""
    return 1 - (1 - similarity**depth) ** trees


def _set_key(found: np.ndarray) -> int:
    """A 64 bit key of a shingle set, as a signed number. Empty sets have key 0."""
    value = xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0
    return value - (1 << 64) if value >= 1 << 63 else value


def signed_texts(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """`id`, `text_hash`, `key` of the shingle set, `n` shingles and the signature `sig`."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, size) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_hash"),
                    pa.array([_set_key(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s, trees * depth).tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "text_hash", "key", "n", "sig"],
            )

    return docs.mapInArrow(run, f"id {kind}, text_hash bigint, key bigint, n bigint, sig binary")


def _node_hashes(sig: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The trie nodes of rows of signatures: a hash of the tree and the prefix of its minima."""
    return prefixes(sig, trees, depth) ^ (np.arange(trees, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _nodes(rows: DataFrame, trees: int, deepest: int, depth: int) -> DataFrame:
    """`node` and `key` of all rows; a task leaves out the copies that it remembers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_keys: set[int] = set()
        for batch in batches:
            keys, take = batch.column("key").to_pylist(), []
            for place, key in enumerate(keys):
                if key not in seen_keys:
                    seen_keys.add(key)
                    take.append(place)
            if len(seen_keys) > REMEMBERED:
                seen_keys.clear()
            if take:
                batch = batch.take(pa.array(take))
                raw = b"".join(batch.column("sig").to_pylist())
                sig = np.frombuffer(raw, np.uint32).reshape(len(take), trees * deepest)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": _node_hashes(sig, trees, depth).view(np.int64).ravel(),
                        "key": np.repeat(batch.column("key").to_numpy(), trees),
                    }
                )

    return rows.select("key", "sig").mapInArrow(run, "node bigint, key bigint")


def _trie_edges(rows: DataFrame, trees: int, deepest: int, depth: int, path: str) -> DataFrame:
    """Edges `u`, `v` that connect all classes of a trie node, from the sorted nodes.

    All nodes are sorted over the tasks once; a task links a node's classes to the
    node's first one in its part. A node of any size is spread over several parts,
    so each part also tells its first and last row, and neighbours that belong to
    one node are linked.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        node_now = head = None

        def out(u, v, end=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "u": pa.array(u, pa.int64()),
                    "v": pa.array(v, pa.int64()),
                    "part": pa.array([None if end is None else part] * len(u), pa.int32()),
                    "side": pa.array([end] * len(u), pa.int32()),
                }
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            node, key = batch.column("node").to_numpy(), batch.column("key").to_numpy()
            if first is None:
                first = (node[0], key[0])
            last = (node[-1], key[-1])
            starts = np.ones(len(node), bool)
            starts[1:] = node[1:] != node[:-1]
            heads = key[np.maximum.accumulate(np.where(starts, np.arange(len(node)), 0))]
            if node_now is not None and node[0] == node_now:
                run = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else len(node)
                heads[:run] = head
            node_now, head = node[-1], heads[-1]
            differ = key != heads
            yield out(key[differ], heads[differ])
        if first is not None:
            yield out([first[1]], [first[0]], 0)
            yield out([last[1]], [last[0]], 1)

    ordered = _nodes(rows, trees, deepest, depth).repartitionByRange(parts, "node", "key")
    made = land(
        ordered.sortWithinPartitions("node", "key").mapInArrow(link, "u bigint, v bigint, part int, side int"), path
    )
    # Two rows per part, whatever the number of documents.
    along = Window.orderBy("part", "side")
    ends = made.where("part is not null").select(
        "u", F.lag("u").over(along).alias("w"), "v", F.lag("v").over(along).alias("before")
    )
    bridges = ends.where((F.col("v") == F.col("before")) & (F.col("u") != F.col("w"))).select("u", F.col("w").alias("v"))
    return made.where("part is null").select("u", "v").unionByName(bridges)


def _exact_sets(docs: DataFrame, wanted: DataFrame, size: int, trees: int, deepest: int, depth: int) -> DataFrame:
    """The wanted classes with their shingle `set` and trie nodes (`marks`), from the text of each
    one's first document."""
    texts = docs.join(sized(wanted.select("first_id")), same(F.col("id"), F.col("first_id")), "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, size) for text in batch.column("text").to_pylist()]
            sigs = np.array([signature(s, trees * deepest) for s in sets], np.uint32)
            marks = _node_hashes(sigs.reshape(len(sets), trees * deepest), trees, depth)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([_set_key(s) for s in sets], pa.int64()),
                    "set": pa.array([s.tobytes() for s in sets], pa.binary()),
                    "marks": pa.array([m.tobytes() for m in marks], pa.binary()),
                }
            )

    return (
        texts.select("text")
        .mapInArrow(run, "key bigint, set binary, marks binary")
        .join(sized(wanted.drop("first_id")), "key")
    )


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, in slices of shared shingles."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    place = [np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0)) for v in (a, b)]
    if not len(shared):
        return out
    keep = [shared[p] == v for p, v in zip(place, (a, b), strict=True)]
    rows = [r[k] for r, k in zip(rows, keep, strict=True)]
    place = [p[k] for p, k in zip(place, keep, strict=True)]
    step = max(1024, 4_000_000 // max(len(left), len(right)))
    for at in range(0, len(shared), step):
        mats = []
        for side, length in enumerate((len(left), len(right))):
            inside = (place[side] >= at) & (place[side] < at + step)
            mat = np.zeros((length, min(step, len(shared) - at)), np.float32)
            mat[rows[side][inside], place[side][inside] - at] = 1
            mats.append(mat)
        out += (mats[0] @ mats[1].T).astype(np.int64)
    return out


def _verify(pdf: pd.DataFrame, similarity: float, group: tuple) -> pd.DataFrame:
    """Links between two blocks of a group (or within one), per class, and a spanning forest."""
    pdf = pdf.drop_duplicates(["key", "side"]).sort_values("key")
    _, one, two = group
    left = pdf[pdf["side"] == one]
    right = pdf[pdf["side"] == two]
    sets = [[np.frombuffer(s, np.uint64) for s in x["set"]] for x in (left, right)]
    keys = [x["key"].to_numpy() for x in (left, right)]
    out_keys, out_links, out_to, out_bins = [], [], [], []
    bins = np.zeros(_BINS, np.int64)
    if len(left) and len(right):
        marks = [np.frombuffer(b"".join(x["marks"]), np.uint64).reshape(len(x), -1) for x in (left, right)]
        candidate = np.zeros((len(left), len(right)), bool)
        for t in range(marks[0].shape[1]):
            candidate |= marks[0][:, t][:, None] == marks[1][:, t][None, :]
        if one == two:
            candidate &= np.triu(np.ones_like(candidate), 1)
        both = _overlaps(*sets)
        total = np.array([len(s) for s in sets[0]])[:, None] + np.array([len(s) for s in sets[1]])[None, :] - both
        # Shares are compared as whole numbers, so the threshold itself is met exactly.
        scale = 1_000_000
        linked = candidate & (both * scale >= round(similarity * scale) * total)
        i, j = np.nonzero(linked)
        if len(i):
            share = both[i, j] / total[i, j]
            place = np.clip(((share - similarity) / (1 - similarity) * _BINS).astype(int), 0, _BINS - 1)
            bins = np.bincount(place, minlength=_BINS)
            counts: dict[int, int] = {}
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for u, v in zip(keys[0][i].tolist(), keys[1][j].tolist(), strict=True):
                counts[u] = counts.get(u, 0) + 1
                counts[v] = counts.get(v, 0) + 1
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            for k, n in counts.items():
                out_keys.append(k)
                out_links.append(n)
                out_to.append(root(k))
                out_bins.append(None)
    out_keys.append(None)
    out_links.append(0)
    out_to.append(None)
    out_bins.append(bins.tolist())
    return pd.DataFrame(
        {
            "key": pd.array(out_keys, "Int64"),
            "links": out_links,
            "to": pd.array(out_to, "Int64"),
            "bins": out_bins,
        }
    )


def _links(
    rows: DataFrame, classes: DataFrame, docs: DataFrame, depth: int, deepest: int, trees: int, size: int,
    similarity: float, block: int, folder: str,
) -> DataFrame:
    """Per class and block pair: `links`, the class `to` that it is joined to, and `bins`."""
    star = _trie_edges(rows, trees, deepest, depth, f"{folder}/trie")
    groups = land(components(star, f"{folder}/groups"), f"{folder}/grouped")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    blocks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    # Blocks are even up to chance: a class's block is a hash of its key.
    wanted = land(
        groups.join(sizes, "root")
        .select(F.col("node").alias("key"), F.col("root").alias("grp"), blocks.alias("blocks"))
        .withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .join(classes.select("key", "first_id"), "key"),
        f"{folder}/wanted",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        _exact_sets(docs, wanted, size, trees, deepest, depth)
        .withColumn("other", other)
        .withColumn("one", F.least("side", "other"))
        .withColumn("two", F.greatest("side", "other"))
    )

    def verify(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _verify(pdf, similarity, group)

    verified = placed.groupBy("grp", "one", "two").applyInPandas(
        verify, "key bigint, links bigint, to bigint, bins array<bigint>"
    )
    return land(verified, f"{folder}/links")


def similar_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depths: tuple[int, ...] = DEPTHS,
    block: int = BLOCK,
) -> DataFrame:
    """Id, `class_id`, `copies`, `links`, `keep` and `text_hash`, one row per input row.

    Documents of one class are linked, directly or over others, by similarities of
    their shingle sets of at least `similarity`; `class_id` is the smallest id of
    the class, null only if all its ids are. `copies` is the number of documents
    with the same shingle set, `links` that of different sets linked to it. `keep`
    marks one document per class, one with the smallest id. Texts without a word
    (null, empty) have no shingle: each is its own class with no links. Null ids
    come after all others; other columns are not read.
    """
    folder = work_folder(docs.sparkSession)
    deepest = max(depths)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = land(
        signed_texts(source.withColumn("text_hash", F.xxhash64("text")), size, trees, deepest).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        f"{folder}/signed",
    )
    lowest = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    classes = land(
        rows.where("n > 0")
        .groupBy("key")
        .agg(F.min(lowest).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("key", "first", F.col("first.id").alias("first_id"), "copies"),
        f"{folder}/classes",
    )
    signed = rows.where("n > 0").select("key", "sig")
    for depth in depths:
        step = f"{folder}/depth{depth}"
        links = _links(signed, classes, source, depth, deepest, trees, size, similarity, block, step)
        if seen(similarity, depth, trees) >= FLOOR and _missing(links, depth, trees, similarity) <= MISSING:
            break
    joined = links.where("key <> to").select(F.col("key").alias("u"), F.col("to").alias("v"))
    roots = components(joined, f"{folder}/classes-joined")
    counts = links.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("links").alias("links"))
    grouped = land(
        classes.join(roots, F.col("key") == F.col("node"), "left")
        .join(counts, "key", "left")
        .select(
            "key",
            "copies",
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
            "first",
            F.coalesce("root", "key").alias("root"),
        ),
        f"{folder}/grouped",
    )
    tops = grouped.groupBy("root").agg(F.min("first").alias("top"))
    named = grouped.join(tops, "root").select("key", "copies", "links", "top")
    # A set with a third of all rows is spread over the parts of its rows.
    salt = F.pmod("row", F.lit(64)).cast("int")
    salted = named.withColumn(
        "salt", F.explode(F.when(F.col("copies") > 64, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(-1))))
    )
    hot = named.where("copies > 64").select(F.col("key").alias("hot"))
    keyed = rows.drop("sig").join(sized(hot), F.col("key") == F.col("hot"), "left").withColumn(
        "salt", F.when(F.col("hot").isNotNull(), salt).otherwise(F.lit(-1))
    )
    own = F.col("n") == 0
    return (
        keyed.join(salted, ["key", "salt"], "left")
        .select(
            F.col("id").alias(id_column),
            F.when(own, F.col("id")).otherwise(F.col("top.id")).alias("class_id"),
            F.when(own, F.lit(1)).otherwise(F.col("copies")).cast("bigint").alias("copies"),
            F.when(own, F.lit(0)).otherwise(F.col("links")).cast("bigint").alias("links"),
            (own | (F.col("row") == F.col("top.row"))).alias("keep"),
            "text_hash",
        )
    )


def _missing(links: DataFrame, depth: int, trees: int, similarity: float) -> float:
    """The estimated share of links that no tree has seen."""
    parts = links.where(F.col("bins").isNotNull()).agg(
        *[F.sum(F.col("bins")[i]).alias(f"b{i}") for i in range(_BINS)]
    ).first()
    found = np.array([x or 0 for x in parts], float)
    low = similarity + (1 - similarity) * np.arange(_BINS) / _BINS  # the least of each bin
    chance = seen(low, depth, trees)
    lost = (found * (1 - chance) / chance).sum()
    return lost / (lost + found.sum()) if found.sum() else 0.0


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` of which one per class stays, with all their columns."""
    key, other, mark, place = fresh(docs, "_id", "_other", "_h", "_place")
    kept = (
        similar_groups(docs, id_column, text_column)
        .where("keep")
        .select(F.col(id_column).alias(key), F.col("text_hash").alias(other))
        .distinct()
    )
    same_row = Window.partitionBy(id_column, mark).orderBy(F.lit(1))
    return (
        docs.withColumn(mark, F.xxhash64(text_column))
        .join(kept, same(F.col(id_column), F.col(key)) & (F.col(mark) == F.col(other)), "left_semi")
        .withColumn(place, F.row_number().over(same_row))
        .where(F.col(place) == 1)
        .select(*docs.columns)
    )
