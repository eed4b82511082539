"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scourframe.llm import common, vectors

#: Trees, rows that a leaf should hold, and levels that are cut from the sample, so that each leaf has rows of it.
TREES, LEAF, DEEPEST = 4, 128, 10
#: A leaf of more rows is cut again, by up to STEP levels at a time, from about OWN of its rows.
CROWDED, STEP, OWN = 8 * LEAF, 5, 4096
#: Rows that the cuts are learned from, queries that the number of leaves is tuned by, recall that these must reach.
SAMPLE, AUDIT, TARGET = 20_000, 128, 0.96
#: Leaves that a query may visit; where the recall needs more of them, it visits the fewer and larger nodes above them.
VISITS = 128
#: Rows of the index, and visits by queries, that one task compares at once.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096


@dataclass
class Forest:
    """Directions of each tree and level, cuts of each tree and node, and the square of the largest norm."""

    directions: np.ndarray
    cuts: np.ndarray
    square: float

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def upper(self, depth: int) -> Forest:
        return Forest(self.directions[:, :depth], self.cuts[:, :1 << depth], self.square)

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Inner products become angles by one more component, which fills rows up to the largest norm and is 0 in queries."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        return np.einsum("nd,tld->tnl", np.column_stack([x, rest]), self.directions, optimize=True)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        values = self.projected(x, query=False)
        node = np.ones(values.shape[:2], np.int64)
        for level in range(self.depth):
            for t in range(len(node)):
                node[t] = 2 * node[t] + (values[t, :, level] > self.cuts[t][node[t]])
        return node - (1 << self.depth)

    def nearest_leaves(self, values: np.ndarray, most: int, held: np.ndarray, rows: int = 0) -> list[int]:
        """Leaves (tree * leaves + leaf) for one query, by the squared distances to the cuts crossed, one queue for all trees: `most`
        of those that hold rows, and more until those of one tree hold `rows` rows. held: rows of each leaf."""
        queue, found, size = [(0.0, t, 1, 0) for t in range(len(values))], [], 1 << self.depth
        seen = [0] * len(values)
        while queue and (len(found) < most or max(seen) < rows):
            far, t, node, level = heapq.heappop(queue)
            while level < self.depth:
                beyond = values[t, level] - self.cuts[t][node]
                side = int(beyond > 0)
                heapq.heappush(queue, (far + beyond * beyond, t, 2 * node + 1 - side, level + 1))
                node, level = 2 * node + side, level + 1
            leaf = t * size + node - size
            if held[leaf]:
                found.append(leaf)
                seen[t] += held[leaf]
        return found


def drawn_directions(trees: int, levels: int, width: int, seed) -> np.ndarray:
    """Random directions for each tree and level; those of up to `width` levels are at right angles."""
    draw = np.random.default_rng(seed)
    return np.stack([np.concatenate([np.linalg.qr(draw.normal(size=(width, width)))[0] for _ in range(-(-levels // width))])[:levels] for _ in range(trees)])


def plant(sample: np.ndarray, rows: int, square: float, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    """Trees that cut a sample in halves along random directions, one direction a level; deep enough for `rows` rows, at most DEEPEST levels."""
    depth = int(np.clip(np.ceil(np.log2(max(rows, 1) / leaf)), 1, DEEPEST))
    forest = Forest(drawn_directions(trees, depth, sample.shape[1] + 1, seed), np.zeros((trees, 1 << depth)), square)
    values = forest.projected(sample, query=False)
    for t in range(trees):
        forest.cuts[t] = halves(values[t], depth)
    return forest


def halves(values: np.ndarray, depth: int) -> np.ndarray:
    """Cuts at the medians of each node, of values (rows, levels); node 1 is the root, 2i and 2i + 1 are below i. A node without rows is not cut:
    all goes left."""
    cuts, node = np.full(1 << depth, np.inf), np.ones(len(values), np.int64)
    for level in range(depth):
        for own in np.unique(node):
            cuts[own] = np.median(values[node == own, level])
        node = 2 * node + (values[:, level] > cuts[node])
    return cuts


def crossed(values: np.ndarray, node: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Squared distances of queries to the cuts they cross on the way to leaves. values: (queries, leaves, levels), path: cuts (leaves, levels)."""
    levels = path.shape[1]
    right = (node[:, None] >> np.arange(levels - 1, -1, -1)) & 1 == 1
    finite = np.where(np.isinf(path), 0.0, path)
    beyond = np.where((values > path) != right, values - finite, 0.0)
    far = np.zeros(beyond.shape[:2])
    for level in range(levels):
        far += beyond[:, :, level] ** 2
    return far


def best(scores: np.ndarray, exact, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the k best, ties to smaller names; whatever rounding could put among them is scored again."""
    allowed = np.flatnonzero(scores > -np.inf)
    if len(allowed) > k:
        least = np.partition(scores[allowed], len(allowed) - k)[len(allowed) - k]
        allowed = allowed[scores[allowed] >= least - 1e-9 * max(1.0, abs(least))]
    values = exact(allowed)
    order = np.lexsort((names[allowed], -values))[:k]
    return allowed[order], values[order]


def brute_force(rows: DataFrame, names: list[int], queries: np.ndarray, id_col: str, vector_col: str, k: int) -> dict[int, list[tuple[float, int]]]:
    """The k nearest rows of a few queries, compared with all rows: every task sends its k best of each query."""
    width = queries.shape[1]

    def compare(batches):
        for batch in batches:
            own, x = batch.column(0).to_numpy(), vectors.matrix(batch.column(1), width)
            scores = queries @ x.T
            scores[np.array(names)[:, None] == own[None, :]] = -np.inf
            found = [(q, own[i], v) for j, q in enumerate(names) for i, v in zip(*best(scores[j], lambda at: (x[at] * queries[j]).sum(axis=1), own, k))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([f[0] for f in found], [f[1] for f in found], [f[2] for f in found])] if found else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["q", "v", "s"])

    near = rows.select(id_col, vector_col).mapInArrow(compare, "q long, v long, s double")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    top = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).orderBy("q", "r").collect()
    result: dict[int, list[tuple[float, int]]] = {name: [] for name in names}
    for row in top:
        result[row["q"]].append((row["s"], row["v"]))
    return result


def dealt(sizes: list[int]) -> tuple[list[int], list[int]]:
    """Leaves, in their order, put into blocks of about BLOCK_ROWS rows, one that holds more into several: first block and number of blocks of each."""
    first, many, block, filled = [], [], -1, BLOCK_ROWS
    for size in sizes:
        many.append(max(1, -(-size // BLOCK_ROWS)))
        if many[-1] > 1 or filled + size > BLOCK_ROWS:
            block, filled = block + 1, 0
        first.append(block)
        filled += size
        if many[-1] > 1:
            block, filled = block + many[-1] - 1, BLOCK_ROWS
    return first, many


#: A leaf: node * TREES + tree, the cuts from the root, its rows, and its blocks. Those of one base hold leaves of one tree, so that no row comes twice.
LEAVES = "leaf long, path array<double>, rows long, base long, first long, many long, crowded boolean"


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """The k rows of largest inner product for each row that is a query, itself left out: query_id, rank (from 1), id_col, score.

    The upper levels are cut from a sample of at most about SAMPLE rows; every row is indexed. Leaves of more than CROWDED rows are cut again, stage by
    stage, each from a draw of about OWN of its own rows, until no leaf is crowded or its rows cannot be parted, so that leaves
    do not grow with the table. The driver holds the upper levels only (at most TREES * 2^DEEPEST leaves); what lies below is in tables.

    A query visits the leaves that are nearest by the cuts crossed, of all trees together. A leaf is no nearer than the one above it, so the
    nearest ones of a stage lie below the nearest ones of the stage before, and each stage keeps that many. How many is the smallest
    number by which about AUDIT queries, drawn by a hash and compared with all rows, reach a recall of `target` (all leaves, if
    need be); empty leaves do not count, and a query goes on until the leaves of one tree hold k rows besides it. If these are more
    than VISITS, the nodes of the stage before, or of the level above, take the place of the leaves, and the number is set anew for them, until it
    is at most VISITS: the recall is the same, and the visits grow with the queries, not with the table too. Leaves are put into blocks of
    about BLOCK_ROWS rows, a leaf that holds more into several; queries travel to the blocks of the leaves they visit, in groups of bounded
    size, where all pairs are scored in double precision on the original vectors. A query keeps its k best of each block, then of
    all blocks, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of several widths are an error.
    Null ids take no part. Of rows that repeat an id, one vector is compared. An empty table, or no query, gives no rows.
    """
    spark = table.sparkSession
    rows = table.filter(vectors.usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("v"), F.col(vector_col).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = common.settled(rows.dropDuplicates(["v"]), "vectors")
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    width = vectors.one_width(rows, "x")
    square = F.aggregate(F.transform("x", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    count, asking, longest = rows.agg(F.count("*"), F.count_if("asks"), F.max(square)).first()
    if not count or not asking:
        return spark.createDataFrame([], schema)
    drawn = rows.filter(common.uniform(F.col("v"), seed=5) < min(1.0, SAMPLE / count)).select("x").collect()
    sample = np.array([row["x"] for row in drawn], np.float64).reshape(-1, width) if drawn else np.zeros((1, width))
    forest = plant(sample, count, longest)
    n_leaves, kind = 1 << forest.depth, dict(rows.dtypes)["x"]

    def index(batches):
        for batch in batches:
            own = forest.leaves(vectors.matrix(batch.column(1), width)) + n_leaves
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(own[t] * TREES + t), batch.column(0), batch.column(1)], ["leaf", "v", "x"])

    indexed = common.settled(rows.select("v", "x").mapInArrow(index, f"leaf long, v long, x {kind}"), "forest")
    sizes = {row["leaf"]: row["count"] for row in indexed.groupBy("leaf").count().collect()}
    held = np.array([sizes.get((leaf % n_leaves + n_leaves) * TREES + leaf // n_leaves, 0) for leaf in range(TREES * n_leaves)])
    stages = [(indexed, spark.createDataFrame(upper_leaves(forest, held), LEAVES), forest, None)]
    crowded = bool((held > CROWDED).any())
    while crowded:
        stages.append(recut(stages[-1], len(stages), width, longest, kind))
        crowded = not stages[-1][1].filter("crowded").isEmpty()
    names, asked = drawn_queries(rows, asking)
    near = brute_force(rows, names, asked, "v", "x", k)
    while True:
        leaves = reduce(DataFrame.unionByName, [stage[1].filter("not crowded") for stage in stages[:-1]] + [stages[-1][1]])
        dealt_out = leaves.select("leaf", "base", "first", "many")
        placed = reduce(DataFrame.unionByName, [stage[0].join(dealt_out, "leaf") for stage in stages])
        visits = audited(names, asked, near, leaves, placed, [stage[2] for stage in stages], target)
        if visits <= VISITS or len(stages) == 1 and forest.depth == 1:
            break
        if len(stages) > 1:
            stages.pop()
        else:
            up = min(forest.depth - 1, max(1, int(np.log2(visits / VISITS))))  # a level above has half as many nodes, at most
            forest, held = forest.upper(forest.depth - up), held.reshape(-1, 1 << up).sum(axis=1)
            above = F.shiftright(F.floor(F.col("leaf") / TREES).cast("long"), up) * TREES + F.col("leaf") % TREES
            stages = [(stages[0][0].withColumn("leaf", above), spark.createDataFrame(upper_leaves(forest, held), LEAVES), forest, None)]
    n_leaves = 1 << forest.depth

    def ask(batches):
        for batch in batches:
            values = forest.projected(vectors.matrix(batch.column(1), width), query=True).transpose(1, 0, 2)
            found = [forest.nearest_leaves(own, visits, held, k + 1) for own in values]
            of = np.repeat(np.arange(len(found)), [len(own) for own in found])
            leaf = np.array([one for own in found for one in own], np.int64)
            t, node = leaf // n_leaves, leaf % n_leaves + n_leaves
            far = np.zeros(len(leaf))
            for level in range(forest.depth):
                above = node >> (forest.depth - level)
                beyond = values[of, t, level] - forest.cuts[t, above]
                right = (node >> (forest.depth - level - 1)) & 1 == 1
                far += np.where((beyond > 0) != right, beyond * beyond, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(node * TREES + t), pa.array(far), pa.array(held[leaf])], ["q", "leaf", "far", "rows"])

    queries = rows.filter("asks").select(F.col("v").alias("q"), "x")
    visited = queries.mapInArrow(ask, "q long, leaf long, far double, rows long")
    for _, _, own, cut in stages[1:]:
        visited = below(visited, queries, cut, own, width, visits, k)

    parts = visited.join(leaves.select("leaf", "base", "first", "many"), "leaf").select("q", "leaf", "base", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1)).alias("block"))
    asked = common.settled(parts.groupBy("q", "base", "block").agg(F.collect_list("leaf").alias("leaves")), "visits")
    sent, blocks = asked.agg(F.count("*"), F.count_distinct("base", "block")).first()
    groups = max(1, -(-sent // (blocks * BLOCK_QUERIES)))

    def compare(queries: pa.Table, own: pa.Table) -> pa.Table:
        result = []
        if queries.num_rows and own.num_rows:
            q, names, leaf = vectors.matrix(queries.column("x"), width), own.column("v").to_numpy(), own.column("leaf").to_numpy()
            order = np.lexsort((names, leaf))
            names, leaf, x = names[order], leaf[order], vectors.matrix(own.column("x"), width)[order]
            begins = {int(value): (a, b) for value, a, b in zip(*np.unique(leaf, return_index=True), np.append(np.flatnonzero(np.diff(leaf)) + 1, len(leaf)))}
            asking = queries.column("q").to_numpy()
            for at in range(0, len(q), 512):
                scores = np.full((min(512, len(q) - at), len(x)), -np.inf)
                visitors: dict[int, list[int]] = {}
                for i, visited in enumerate(queries.column("leaves").slice(at, 512).to_pylist()):
                    for one in visited:
                        visitors.setdefault(one, []).append(i)
                for one, who in visitors.items():
                    if one in begins:
                        a, b = begins[one]
                        scores[who, a:b] = q[at + np.array(who)] @ x[a:b].T
                for i, row in enumerate(scores):
                    row[names == asking[at + i]] = -np.inf
                    found, values = best(row, lambda chosen, i=i: (x[chosen] * q[at + i]).sum(axis=1), names, k)
                    result.append((asking[at + i], [{"s": -s, "v": v} for s, v in zip(values, names[found])]))
        return pa.table({"q": pa.array([r[0] for r in result], pa.int64()), "near": pa.array([r[1] for r in result], pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())])))})

    dealt_rows = placed.select("base", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("many"))).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "leaf", "v", "x")
    dealt_queries = asked.join(queries, "q").select("base", "block", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("g"), "leaves", "q", "x")
    keys = ["base", "block", "g"]
    near = dealt_queries.groupBy(*keys).cogroup(dealt_rows.groupBy(*keys)).applyInArrow(compare, "q long, near array<struct<s:double,v:long>>")
    top = near.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return top.select(F.col("q").alias("query_id"), F.posexplode("near").alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.v").alias(id_col), (-F.col("n.s")).alias("score"))


def upper_leaves(forest: Forest, held: np.ndarray) -> list[tuple]:
    """The leaves of the upper levels that hold rows, as LEAVES. held: rows of each leaf (tree * leaves + leaf)."""
    n_leaves, upper = 1 << forest.depth, []
    blocks = [dealt(held[t * n_leaves:(t + 1) * n_leaves].tolist()) for t in range(TREES)]
    for at in np.flatnonzero(held).tolist():
        t, node = at // n_leaves, at % n_leaves + n_leaves
        path = [float(forest.cuts[t][node >> up]) for up in range(forest.depth, 0, -1)]
        upper.append((node * TREES + t, path, int(held[at]), t, *[of[node - n_leaves] for of in blocks[t]], bool(held[at] > CROWDED)))
    return upper


def recut(stage: tuple, number: int, width: int, square: float, kind: str) -> tuple:
    """Cut the crowded leaves of a stage by STEP levels more: the rows of the new leaves, these leaves, the directions, and the cuts of each old leaf
    with the rows of each new one below it. A leaf all of whose rows stay together is not crowded any more; it is compared in blocks."""
    rows, leaves = stage[0], stage[1].filter("crowded").select("leaf", "path", F.col("rows").alias("above"))
    size = 1 << STEP
    own = Forest(drawn_directions(TREES, STEP, width + 1, (3, number)), np.zeros((TREES, size)), square)

    def learn(key, group):
        above = group.column("above")[0].as_py()
        depth = int(np.clip(np.ceil(np.log2(above / LEAF)), 1, STEP))
        cuts = np.full(size, np.inf)
        cuts[:1 << depth] = halves(own.projected(vectors.matrix(group.column("x"), width), query=False)[key[0].as_py() % TREES], depth)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    held = rows.join(leaves.select("leaf", "above"), "leaf")
    draw = held.filter(common.uniform(F.col("v"), F.col("leaf"), seed=7) < F.lit(float(OWN)) / F.col("above"))
    cuts = common.settled(draw.groupBy("leaf").applyInArrow(learn, "leaf long, cuts array<double>"), "forest-cuts")

    def assign(batches):
        for batch in batches:
            leaf, at = batch.column(0).to_numpy(), np.arange(batch.num_rows)
            values, cut = own.projected(vectors.matrix(batch.column(2), width), query=False), vectors.matrix(batch.column(3), size)
            node = np.ones(len(leaf), np.int64)
            for level in range(STEP):
                node = 2 * node + (values[leaf % TREES, at, level] > cut[at, node])
            below = ((leaf // TREES << STEP) + node - size) * TREES + leaf % TREES
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(below), batch.column(1), batch.column(2)], ["above", "leaf", "v", "x"])

    cut_rows = rows.join(cuts, "leaf").select("leaf", "v", "x", "cuts").mapInArrow(assign, f"above long, leaf long, v long, x {kind}")
    indexed = common.settled(cut_rows, "forest")
    counts = indexed.groupBy("above", "leaf").count().groupBy(F.col("above").alias("leaf")).agg(F.map_from_entries(F.collect_list(F.struct("leaf", "count"))).alias("counts"))
    cut = common.settled(leaves.join(cuts, "leaf").join(counts, "leaf"), "forest-cuts")

    def grow(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                counts = dict(row["counts"])
                names = sorted(counts)
                first, many = dealt([counts[name] for name in names])
                for name, begin, number in zip(names, first, many):
                    node = name // TREES % size + size
                    path = row["path"] + [row["cuts"][node >> up] for up in range(STEP, 0, -1)]
                    found.append({"leaf": name, "path": path, "rows": counts[name], "base": row["leaf"], "first": begin, "many": number, "crowded": CROWDED < counts[name] < row["above"]})
            yield pa.RecordBatch.from_pylist(found, ARROW_LEAVES)

    return indexed.select("leaf", "v", "x"), common.settled(cut.mapInArrow(grow, LEAVES), "forest-leaves"), own, cut


ARROW_LEAVES = pa.schema([("leaf", pa.int64()), ("path", pa.list_(pa.float64())), ("rows", pa.int64()), ("base", pa.int64()), ("first", pa.int64()), ("many", pa.int64()), ("crowded", pa.bool_())])


def below(visited: DataFrame, queries: DataFrame, cut: DataFrame, own: Forest, width: int, visits: int, k: int) -> DataFrame:
    """The nearest leaves of each query, after those that were cut again are replaced by what lies below them."""
    size = 1 << STEP

    def descend(batches):
        for batch in batches:
            leaf, at = batch.column(1).to_numpy(), np.arange(batch.num_rows)
            values, cuts = own.projected(vectors.matrix(batch.column(3), width), query=True)[leaf % TREES, at], vectors.matrix(batch.column(4), size)
            far = batch.column(2).to_numpy()[:, None]
            for level in range(STEP):
                here = cuts[:, 1 << level:2 << level]
                beyond = values[:, level, None] - here
                far = np.stack([far + np.where(beyond > 0, beyond * beyond, 0.0), far + np.where(beyond > 0, 0.0, beyond * beyond)], axis=2).reshape(len(leaf), -1)
            of, names, rows = [], [], []
            for i, counts in enumerate(batch.column(5).to_pylist()):
                for name, held in counts:
                    of.append(i)
                    names.append(name)
                    rows.append(held)
            of, names = np.array(of, np.int64), np.array(names, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(names), pa.array(far[of, names // TREES % size]), pa.array(rows, pa.int64())], ["q", "leaf", "far", "rows"])

    lower = visited.join(cut.select("leaf", "cuts", "counts"), "leaf").join(queries, "q").select("q", "leaf", "far", "x", "cuts", "counts").mapInArrow(descend, "q long, leaf long, far double, rows long")
    both = visited.join(cut.select("leaf"), "leaf", "left_anti").select("q", "leaf", "far", "rows").unionByName(lower)
    order = Window.partitionBy("q").orderBy("far", "leaf")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(*[F.coalesce(F.sum(F.when(F.col("leaf") % TREES == t, F.col("rows"))).over(before), F.lit(0)) for t in range(TREES)])
    return both.withColumn("_at", F.row_number().over(order)).withColumn("_seen", seen).filter((F.col("_at") <= visits) | (F.col("_seen") < k + 1)).select("q", "leaf", "far", "rows")


def drawn_queries(rows: DataFrame, asking: int) -> tuple[list[int], np.ndarray]:
    """About AUDIT queries, drawn by a hash: their ids and vectors."""
    audit = rows.filter("asks").filter(common.uniform(F.col("v"), seed=6) < min(1.0, AUDIT / asking)).select("v", "x").collect()
    audit = audit or rows.filter("asks").orderBy(F.xxhash64("v")).select("v", "x").limit(1).collect()
    return [row["v"] for row in audit], np.array([row["x"] for row in audit], np.float64)


def audited(names: list[int], asked: np.ndarray, near: dict, leaves: DataFrame, placed: DataFrame, forests: list[Forest], target: float) -> int:
    """How many leaves a query must visit for a recall of `target` among a few queries, whose nearest rows are given. What is brought to the driver is theirs."""
    spark = leaves.sparkSession
    if not any(near.values()):
        return 1
    values = np.concatenate([own.projected(asked, query=True) for own in forests], axis=2)  # tree, query, level
    wanted = spark.createDataFrame([(v,) for v in sorted({v for own in near.values() for _, v in own})], "v long")
    found = placed.select("leaf", "v").join(F.broadcast(wanted), "v").join(leaves.select("leaf", "path"), "leaf").collect()
    least: dict[int, np.ndarray] = {}
    for row in found:
        far = crossed(values[row["leaf"] % TREES][:, None, :len(row["path"])], np.array([row["leaf"] // TREES]), np.array([row["path"]]))[:, 0]
        least[row["v"]] = np.minimum(least.get(row["v"], np.inf), far)
    bounds = [np.sort([least[v][i] for _, v in near[name]]) for i, name in enumerate(names)]

    def nearer(batches):
        """For each neighbour of each query: how many leaves are as near as its own or nearer, itself counted."""
        total = [np.zeros(len(own), np.int64) for own in bounds]
        for batch in batches:
            leaf, paths = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            length = np.array([len(path) for path in paths])
            for t in range(TREES):
                for levels in np.unique(length):
                    chosen = np.flatnonzero((leaf % TREES == t) & (length == levels))
                    for at in range(0, len(chosen), 512):
                        part = chosen[at:at + 512]
                        far = np.sort(crossed(values[t][:, None, :levels], leaf[part] // TREES, np.array([paths[i] for i in part])), axis=1)
                        for i, own in enumerate(bounds):
                            total[i] += np.searchsorted(far[i], own, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(i, j, n) for i, own in enumerate(total) for j, n in enumerate(own.tolist())])], ["i", "j", "n"])

    turns = leaves.select("leaf", "path").mapInArrow(nearer, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    turns = np.sort([row["n"] for row in turns])
    return int(turns[min(len(turns), int(np.ceil(target * len(turns)))) - 1])


def op10_projection_forest(spark, sf_dir: str) -> DataFrame:
    """Contract: the rows whose id is divisible by 20 ask for their 20 nearest of all others."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
