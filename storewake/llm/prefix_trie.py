"""The trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns (role, text); it is named by a chained
128 bit digest. What a node counts by itself (members, children, ends) are plain
aggregates. What it sums over its subtree comes from a centroid decomposition of
the forest of parent edges:

* A component's weight is its number of (conversation, turn) rows, and the weight below
  a node needs no recursion: it is the sum over its members of the turns they have left.
* The centroid of a component is the deepest node with more than half of its weight below.
  Without it the component falls into the part above and one part per child, all
  of at most half the weight.
* The centroid's total is the sum over what stood below it in its component. It is added
  to every node on the path from the centroid to the component's top.
* A node's result is the sum of its own totals and of what it was added.

Components above `task_rows` are split by joins, all of them at once, in rounds that grow
with the logarithm of the largest one; the others are split the same way within tasks,
each as a small list. So neither a turn that a third of all conversations begins with nor a very
long conversation meets in one task. Only the chain of digests along one conversation
is read in order, as a stream of sorted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewake.llm.common import land, sized, work_folder

TASK_ROWS = 256
#: Children of one node above which its details go to them, and not they to it.
HOT_CHILDREN = 2000
#: An end list is put together from pieces of ids that differ in so many low bits only.
ID_BITS = 12
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
BATCH = 8192


def _chained(turns: DataFrame) -> DataFrame:
    """Nodes along every conversation, from rows of `conv_id`, `place` (0: no turn), `turn`
    and `n_chars`; `left` is the number of the conversation's rows from here on."""
    schema = "conv_id bigint, depth bigint, node binary, parent binary, n_chars bigint, below bigint"

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, node, depth = object(), ROOT, 0
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            digests = batch.column("turn").to_pylist()
            rows = batch.column("n_rows").to_pylist()
            nodes, parents, depths = [], [], []
            for conv, digest in zip(convs, digests, strict=True):
                if conv != current:
                    current, node, depth, parent = conv, ROOT, 0, None
                else:
                    parent, depth = node, depth + 1
                    node = hashlib.blake2b(parent + digest, digest_size=16).digest()
                nodes.append(node)
                parents.append(parent)
                depths.append(depth)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()),
                    pa.array(parents, pa.binary()), batch.column("n_chars"),
                    pa.array([n - d for n, d in zip(rows, depths, strict=True)], pa.int64()),
                ],
                names=["conv_id", "depth", "node", "parent", "n_chars", "below"],
            )

    conv = Window.partitionBy("conv_id")
    return (
        turns.repartition("conv_id")
        .withColumn("n_rows", F.count("*").over(conv))
        .sortWithinPartitions("conv_id", "part", "place")
        .select("conv_id", "turn", "n_chars", "n_rows")
        .mapInArrow(chain, schema)
    )


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(F.encode(both, "UTF-8"), 256)), 1, 16)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `place` (from 1, by turn with null first, then role and digest), `turn` and `n_chars`.

    A null role or text is empty; rows with a null conversation belong to none.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("number"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    ).where(F.col("conv_id").isNotNull())
    rows = rows.select(
        "conv_id", "number", "role", turn_digest(F.col("role"), F.col("text")).alias("turn"),
        F.char_length("text").cast("bigint").alias("n_chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("number").asc_nulls_first(), "role", "turn")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "turn", "n_chars")


def rebuilt_turns(numbered: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in place of its own;
    h is crc32(c) % 6. One row without a turn heads each conversation."""
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 6).alias("h")
    convs = numbered.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h)
    lead = numbered.where("place <= 5").select(F.col("conv_id").alias("base"), "place", "turn", "n_chars")
    own = numbered.select("conv_id", h, "place", "turn", "n_chars").where("place > h")
    heads = convs.select(
        "conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn"),
        F.lit(0).cast("bigint").alias("n_chars"),
    )
    borrowed = convs.join(lead.where("base % 100 = 0"), "base").where("place <= h")
    columns = ("place", "turn", "n_chars")
    return heads.unionByName(borrowed.select("conv_id", F.lit(1).alias("part"), *columns)).unionByName(
        own.select("conv_id", F.lit(2).alias("part"), *columns)
    )


def own_turns(numbered: DataFrame) -> DataFrame:
    """Every conversation as it is, headed by a row without a turn."""
    head = numbered.where("place = 1").select(
        "conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn"),
        F.lit(0).cast("bigint").alias("n_chars"),
    )
    return head.unionByName(numbered.select("conv_id", F.lit(1).alias("part"), "place", "turn", "n_chars"))


def _split_locally(size: Sequence[int], parent: Sequence[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums of one component: `size` are weights of single nodes, parents stand before children."""
    n = len(parent)
    below = list(size)
    for at in range(n - 1, 0, -1):
        below[parent[at]] += below[at]
    children: list[list[int]] = [[] for _ in range(n)]
    for at in range(1, n):
        children[parent[at]].append(at)
    sums = [[0] * n for _ in values]
    cut = [False] * n
    tops = [0]
    while tops:
        top = tops.pop()
        half = below[top]
        centroid, onward = top, top
        while onward is not None:
            centroid = onward
            onward = next((c for c in children[centroid] if not cut[c] and 2 * below[c] > half), None)
        cut[centroid] = True
        under = [centroid]
        for at in under:
            under += [c for c in children[at] if not cut[c]]
        path = [centroid]
        while path[-1] != top:
            path.append(parent[path[-1]])
        for own, total in zip(values, sums, strict=True):
            whole = sum(own[at] for at in under)
            for at in path:
                total[at] += whole
        weight = below[centroid]
        for at in path[1:]:
            below[at] -= weight
        tops += [c for c in children[centroid] if not cut[c]]
        if centroid != top:
            tops.append(top)
    return sums


def _locally(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Subtree sums within components, each of a bounded number of nodes."""
    schema = "node binary, " + ", ".join(f"{n} bigint" for n in names)

    def roll(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        current = None

        def finish() -> None:
            place = {row[1]: at for at, row in enumerate(held)}
            parents = [place.get(row[2], 0) for row in held]
            sums = _split_locally([row[3] for row in held], parents, [[row[4 + k] for row in held] for k in range(len(names))])
            done.extend((row[1], *(s[at] for s in sums)) for at, row in enumerate(held))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            made = [pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            done.clear()
            return pa.RecordBatch.from_arrays(made, names=["node", *names])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != current:
                    finish()
                    held.clear()
                    if len(done) >= BATCH:
                        yield out()
                current = row[0]
                held.append(row)
        if held:
            finish()
        if done:
            yield out()

    return (
        nodes.repartition("component")
        .sortWithinPartitions("component", "depth")
        .select("component", "node", "parent", "n_rows", *names)
        .mapInArrow(roll, schema)
    )


def subtree_sums(
    nodes: DataFrame, rows: DataFrame, values: dict[str, Column], folder: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """`node` and the sums of `values` over its subtree.

    `nodes` has one row per node: `node`, `parent`, `depth`, `conv_id` (a member), `n_rows` (its weight) and
    `below` (the weight of its subtree); `rows` has the node of every (`conv_id`, `depth`) and its `parent`.
    """
    names = list(values)
    columns = ["component", "node", "parent", "depth", "conv_id", "n_rows", "below", *names]
    root = nodes.where("depth = 0").select("node", "below").first()
    component, whole = (bytes(root.node), root.below) if root else (ROOT, 0)
    state = nodes.withColumns(values).withColumns(
        {"component": F.lit(component), "whole": F.lit(whole).cast("bigint")}
    )
    state = state.select(*columns, "whole")
    done, spread, turn = [], [], 0
    while True:
        small = state.where(F.col("whole") <= task_rows)
        large = land(state.where(F.col("whole") > task_rows), f"{folder}/large{turn}")
        done.append(_locally(land(small.select(*columns), f"{folder}/small{turn}"), names))
        if large.isEmpty():
            break
        deepest = F.max_by(F.struct("node", "depth", "conv_id", "below"), F.col("depth")).alias("c")
        centroids = large.where(2 * F.col("below") > F.col("whole")).groupBy("component").agg(deepest)
        top_depth = large.groupBy("component").agg(F.min("depth").alias("top"))
        centroids = land(
            centroids.join(top_depth, "component").select(
                "component", "top", F.col("c.node").alias("centroid"), F.col("c.depth").alias("c_depth"),
                F.col("c.conv_id").alias("c_conv"), F.col("c.below").alias("c_below"),
            ),
            f"{folder}/centroids{turn}",
        )
        marked = large.join(sized(centroids), "component")
        ancestors = rows.select(
            F.col("conv_id").alias("a_conv"), F.col("depth").alias("a_depth"), F.col("node").alias("branch"),
            F.col("parent").alias("branch_parent"),
        )
        deep = F.col("depth") > F.col("c_depth")
        deeper = marked.where(deep).join(
            ancestors, (F.col("conv_id") == F.col("a_conv")) & (F.col("a_depth") == F.col("c_depth") + 1)
        )
        under = F.col("branch_parent") == F.col("centroid")
        kind = F.when(under, 1).otherwise(0)
        flat = marked.where(~deep).select(
            *columns, "centroid", "c_depth", "whole", "c_below", "top",
            F.when(F.col("node") == F.col("centroid"), 2).otherwise(0).alias("kind"), F.lit(None).cast("binary").alias("branch"),
        )
        split = land(
            flat.unionByName(
                deeper.select(*columns, "centroid", "c_depth", "whole", "c_below", "top", kind.alias("kind"), "branch")
            ),
            f"{folder}/split{turn}",
        )
        totals = land(
            split.where("kind > 0").groupBy("component").agg(*[F.sum(n).alias(n) for n in names]),
            f"{folder}/totals{turn}",
        )
        path = land(
            rows.join(
                sized(centroids.select("component", "top", "centroid", "c_depth", F.col("c_conv").alias("conv_id"), "c_below")),
                "conv_id",
            )
            .where((F.col("depth") >= F.col("top")) & (F.col("depth") <= F.col("c_depth")))
            .select("component", "node", "c_below"),
            f"{folder}/path{turn}",
        )
        spread.append(path.join(sized(totals), "component").select("node", *names))
        on_path = path.select(F.col("component").alias("p_component"), F.col("node").alias("p_node"), F.col("c_below").alias("minus"))
        above = (
            split.where("kind = 0")
            .join(on_path, (F.col("node") == F.col("p_node")) & (F.col("component") == F.col("p_component")), "left")
            .withColumn("below", F.col("below") - F.coalesce("minus", F.lit(0)))
            .withColumn("whole", F.col("whole") - F.col("c_below"))
            .select(*columns, "whole")
        )
        children = split.where("kind = 1")
        weights = children.where(F.col("node") == F.col("branch")).select(
            F.col("branch").alias("w_branch"), F.col("below").alias("branch_below")
        )
        beneath = children.join(weights, F.col("branch") == F.col("w_branch")).select(
            F.col("branch").alias("component"), *columns[1:], F.col("branch_below").alias("whole")
        )
        state = land(above.unionByName(beneath), f"{folder}/state{turn}")
        turn += 1
    parts = done + spread
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("node").agg(*[F.sum(n).alias(n) for n in names])


def _end_sums(rows: DataFrame) -> DataFrame:
    """`node` and the checksum of the conversations that end there, their ids in order."""
    ends = rows.where("below = 1").select("node", "conv_id")
    pieces = (
        ends.groupBy("node", F.shiftright("conv_id", ID_BITS).alias("range"))
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select("node", "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    )

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sum_, done = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != current:
                    if sum_ is not None:
                        done.append((current, sum_.hexdigest()))
                    current, sum_ = node, hashlib.sha256(ids.encode())
                else:
                    sum_.update(f",{ids}".encode())
            if len(done) >= BATCH:
                yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
                done = []
        if sum_ is not None:
            done.append((current, sum_.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})

    return (
        pieces.repartition("node")
        .sortWithinPartitions("node", "range")
        .select("node", "ids")
        .mapInArrow(chain, "node binary, ends_sha256 string")
    )


def _with_parents(nodes: DataFrame, hot_children: int) -> DataFrame:
    """Each node with its parent's `conv_id`; parents of very many children go to those, if they are few."""
    details = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = details.where(F.col("n_children") >= hot_children).drop("n_children")
    near = nodes.join(sized(hot), "parent", "left")
    cold = details.where(F.col("n_children") < hot_children).select("parent", F.col("parent_conv_id").alias("other"))
    # Rows that have theirs keep a key of their own, so that they do not meet in one task.
    known = F.col("parent_conv_id").isNotNull()
    return (
        near.withColumn("cold_parent", F.when(known, F.col("node")).otherwise(F.col("parent")))
        .join(cold.withColumnRenamed("parent", "cold_parent"), "cold_parent", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "other"))
        .drop("other", "cold_parent")
    )


def prefix_trie(
    turns: DataFrame, task_rows: int = TASK_ROWS, hot_children: int = HOT_CHILDREN
) -> DataFrame:
    """One row per node of the trie of conversations, given as `own_turns` or `rebuilt_turns`.

    `node` (digest of the prefix), `conv_id` (smallest member), `depth`, `parent_conv_id` (null for the root),
    `n_convs`, `n_children`, `n_leaves` and `saved_tokens` over the subtree, `ends_sha256`. Equal turns of
    a conversation follow one another like others. An empty table has no nodes.
    """
    folder = work_folder(turns.sparkSession)
    rows = land(_chained(turns), f"{folder}/rows")
    own = rows.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("n_chars").alias("n_chars"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("below").alias("below"),
    )
    own = land(own, f"{folder}/own")
    children = own.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = own.join(children.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children"])
    nodes = land(nodes, f"{folder}/nodes")
    sums = subtree_sums(
        nodes.withColumn("n_rows", F.col("n_convs")),
        rows.select("conv_id", "depth", "node", "parent"),
        {
            "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars"),
        },
        folder,
        task_rows,
    )
    out = _with_parents(nodes, hot_children).join(sums, "node").join(_end_sums(rows), "node", "left")
    return out.select(
        "node",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
