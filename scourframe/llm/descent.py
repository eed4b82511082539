"""Near-duplicate embeddings: a neighbour graph refined by NN-descent, and the links in it above a cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common, vectors

#: Neighbours in a list at first; a list whose every entry is a link is saturated and doubled, up to LONGEST.
NEIGHBOURS, LONGEST = 8, 32
#: Tables at least that the first lists come from, odds that two rows at the bound meet in one of them, planes in a word of a
#: code (two words a table, since a narrow cone lies on one side of most planes), rows compared at once in a table: BLOCK at most, a
#: quarter of a label if that is less, but SMALLEST at least.
TABLES, MEETING, PLANES, BLOCK, SMALLEST = 8, 0.99, 62, 256, 16
#: Rounds of refinement before recall is measured, times that tables and rounds are added for labels that are short of TARGET, the share of
#: the audited linked rows of a label that must have all their links.
ROUNDS, TURNS, TARGET = 2, 4, 0.99
#: Rows audited of a label, rows on each side of a block of comparisons, rows of it scored at a time.
AUDITED, SIDE, TILE = 2048, 2048, 256

NEAR = "near array<struct<s:double,w:long>>"
NEAR_TYPE = pa.list_(pa.struct([("s", pa.float64()), ("w", pa.int64())]))


def units(table: pa.Table, width: int, column: str = "x") -> np.ndarray:
    x = vectors.matrix(table.column(column), width)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def local_join(table: pa.Table, width: int, least: float) -> list[tuple]:
    """All rows of a small table against each other: for each, better neighbours than it has, and the smallest row linked to it
    through links seen here."""
    names, place = np.unique(table.column("u").to_numpy(), return_index=True)
    if len(names) < 2:
        return []
    table = table.take(pa.array(place))
    x, label, floor, most = units(table, width), table.column("label").to_numpy(), table.column("floor").to_numpy(), table.column("most").to_numpy()
    scores = x @ x.T
    scores[label[:, None] != label[None, :]] = -2
    np.fill_diagonal(scores, -2)
    linked = scores >= least
    root = np.arange(len(names))
    while True:  # names are sorted, so the smallest place is the smallest name
        low = np.minimum(root, np.where(linked, root[None, :], len(names)).min(axis=1))
        if (low == root).all():
            break
        root = low
    rows = []
    for i in range(len(names)):
        better = np.flatnonzero(scores[i] > floor[i])
        if len(better) > most[i]:
            better = better[np.argpartition(-scores[i][better], most[i] - 1)[: most[i]]]
        if len(better) or root[i] != i:
            rows.append((int(names[i]), [{"s": -float(scores[i][j]), "w": int(names[j])} for j in better], int(names[root[i]]) if root[i] != i else None))
    return rows


def joined_runs(df: DataFrame, width: int, least: float) -> DataFrame:
    """`local_join` of the rows of each `key`."""
    def work(batches):
        rows: list[tuple] = []
        for table in common.runs(batches):
            rows += local_join(table, width, least)
            if len(rows) > 20_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], NEAR_TYPE), pa.array([r[2] for r in rows], pa.int64())], ["u", "near", "link"])

    return df.repartition("key").sortWithinPartitions("key").mapInArrow(work, f"u long, {NEAR}, link long")


def merged(rows: DataFrame, least: float) -> DataFrame:
    """Lists of one row joined into the best of all, doubled in length where every entry is a link: u, near, most."""
    every = rows.groupBy("u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), F.max("most").alias("most"))
    saturated = (F.size("near") >= F.col("most")) & (F.element_at("near", F.col("most")).getField("s") <= -least)
    every = every.withColumn("most", F.when(saturated, F.least(F.col("most") * 2, F.lit(LONGEST))).otherwise(F.col("most")))
    return every.select("u", F.slice("near", F.lit(1), F.col("most")).alias("near"), "most")


def first_lists(nodes: DataFrame, sizes: DataFrame, width: int, least: float, turn: int = 0) -> DataFrame:
    """Neighbours among the rows that follow each other in the order of their sides of random planes, in several tables.

    The rows of a label are sorted by all sides and dealt into blocks of about equal size, so that as many planes part them as their own
    number asks for, no row is alone, and none is left out of a crowd. The tables of a label grow with the planes that part it, and
    double with each `turn`, which draws other planes."""
    alike = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(SMALLEST), F.ceil(F.col("rows") / 4)))
    sized = sizes.withColumn("size", block.cast("long"))
    together = F.pow(F.lit(alike), F.ceil(F.log2(F.col("rows") * 2 / F.col("size"))))
    tables = F.when(F.col("rows") < 2 * F.col("size"), 1).when(together >= 1, TABLES).otherwise(F.greatest(F.lit(TABLES), F.ceil(math.log(1 - MEETING) / F.log(1 - together)))) * (1 << turn)
    planned = common.settled(sized.withColumn("tables", tables.cast("long")), "tables")
    most = planned.agg(F.max("tables")).first()[0]
    planes = np.random.default_rng(17 + turn).normal(size=(most, 2 * PLANES, width))

    def place(batches):
        for batch in batches:
            x, tables = vectors.matrix(batch.column("x"), width), batch.column("tables").to_numpy()
            for t in range(most):
                own = np.flatnonzero(tables > t)
                if len(own):
                    sides = (x[own] @ planes[t].T > 0).astype(np.int64).reshape(-1, 2, PLANES)
                    code = sides @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array(code[:, 0]), pa.array(code[:, 1]), *(batch.column(c).take(at) for c in ("u", "label", "rows", "size"))], ["t", "code", "further", "u", "label", "rows", "size"])

    placed = nodes.join(planned, "label").select("u", "label", "x", "rows", "size", "tables").mapInArrow(place, "t long, code long, further long, u long, label long, rows long, size long")
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["code", "further", "u"]
    keyed = placed.withColumn("list", F.struct("label", "t")).repartitionByRange(spread, "list", *order)
    ranked = common.numbered(keyed, "list", order, "rank")
    block = F.least(F.floor(F.col("rank") / F.col("size")), F.greatest(F.floor(F.col("rows") / F.col("size")) - 1, F.lit(0)))
    keyed = ranked.select("u", F.xxhash64("t", "label", block).alias("key")).join(nodes.select("u", "label", "x"), "u")
    return joined_runs(keyed.select("key", "u", "label", "x", F.lit(-2.0).alias("floor"), F.lit(NEIGHBOURS).alias("most")), width, least)


def refined(graph: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """One round: the rows in the list of a row, or whose list it is in, are compared with each other."""
    edges = graph.select("u", F.explode("near").alias("n")).select("u", F.col("n.w").alias("w"), F.col("n.s").alias("s"))
    # of the rows that have one row in their lists, its nearest: as many as its own list may be long
    back = edges.groupBy(F.col("w").alias("key"), F.pmod(F.xxhash64("u"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "u"))), 1, LONGEST).alias("b"))
    back = back.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("b"))), 1, LONGEST).alias("b"))
    pivots = edges.select(F.col("u").alias("key"), F.col("w").alias("u")).unionByName(back.select("key", F.explode("b.u").alias("u"))).distinct()
    bounds = graph.select("u", "most", F.when(F.size("near") < F.col("most"), F.lit(-2.0)).otherwise(-F.element_at("near", -1).getField("s")).alias("floor"))
    members = nodes.join(bounds, "u")
    return joined_runs(pivots.join(members, "u").select("key", "u", "label", "x", "floor", "most"), width, least)


def counted(nodes: DataFrame, component: DataFrame, width: int, least: float) -> DataFrame:
    """Links of every row within its component: u, links. All rows of a component are compared, in blocks, so that lists that were
    too short lose nothing; only sums leave a task."""
    own = nodes.join(component.withColumnRenamed("node", "u"), "u")
    sizes = own.groupBy("component").agg(F.ceil(F.count("*") / SIDE).alias("parts"))
    dealt = own.join(sizes, "component").withColumn("i", F.pmod(F.xxhash64("u"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pairs = dealt.withColumn("j", other).select(
        F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "u", "label", "x", "n", F.col("i").alias("block"), F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))

    def work(batches):
        for table in common.runs(batches):
            x, label, n = units(table, width), table.column("label").to_numpy(), table.column("n").to_numpy()
            block, alone = table.column("block").to_numpy(), table.column("low")[0].as_py() == table.column("high")[0].as_py()
            total = np.zeros(len(x), np.int64)
            for at in range(0, len(x), TILE):
                own = np.arange(at, min(at + TILE, len(x)))
                links = (x[own] @ x.T >= least) & (label[own, None] == label[None, :])
                links[own - at, own] = False
                if not alone:
                    links &= block[own, None] != block[None, :]
                total[own] = links @ n
            yield pa.RecordBatch.from_arrays([table.column("u").combine_chunks(), pa.array(total)], ["u", "links"])

    sums = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(work, "u long, links long")
    return sums.groupBy("u").agg(F.sum("links").alias("links"))


def compared(nodes: DataFrame, asked: DataFrame, sizes: DataFrame, width: int, least: float) -> DataFrame:
    """Rows of `asked` (u, label, x) against all rows of their labels, in blocks: u, label, asked, `truth` (its links; several rows
    a u, to be summed) and `link`, a smaller row reached by links seen in the block, for rows of both sides."""
    many = asked.groupBy("label").agg(F.ceil(F.count("*") / SIDE).alias("groups"))
    shape = sizes.join(many, "label").select("label", F.ceil(F.col("rows") / SIDE).alias("parts"), "groups")
    every = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
    rows = nodes.select("u", "label", "x", "n").join(shape, "label").withColumn("i", F.pmod(F.xxhash64("u", F.lit(1)), F.col("parts"))).withColumn("j", every("groups"))
    ask = asked.select("u", "label", "x", F.lit(0).cast("long").alias("n")).join(shape, "label").withColumn("j", F.pmod(F.xxhash64("u", F.lit(2)), F.col("groups"))).withColumn("i", every("parts"))
    keyed = rows.withColumn("asks", F.lit(False)).unionByName(ask.withColumn("asks", F.lit(True))).select(F.xxhash64("label", "i", "j").alias("key"), "u", "label", "x", "n", "asks")

    def work(batches):
        for table in common.runs(batches):
            x, u, label, n = units(table, width), table.column("u").to_numpy(), table.column("label").to_numpy(), table.column("n").to_numpy()
            asks = table.column("asks").to_numpy()
            a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
            links = np.zeros((len(a), len(b)), bool)
            for at in range(0, len(a), TILE):
                own = a[at: at + TILE]
                links[at: at + TILE] = (x[own] @ x[b].T >= least) & (label[own][:, None] == label[b][None, :]) & (u[own][:, None] != u[b][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(u[a]), pa.array(label[a]), pa.array(np.ones(len(a), bool)), pa.array(links @ n[b]), pa.nulls(len(a), pa.int64())], names)
            left, right = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
            if len(left):
                links, a, b = links[np.ix_(left, right)], a[left], b[right]
                low, other = u[a].copy(), u[b].copy()
                while True:
                    new = np.minimum(low, np.where(links, other[None, :], np.iinfo(np.int64).max).min(axis=1))
                    after = np.minimum(other, np.where(links, new[:, None], np.iinfo(np.int64).max).min(axis=0))
                    if (new == low).all() and (after == other).all():
                        break
                    low, other = new, after
                at, root = np.concatenate([a, b]), np.concatenate([low, other])
                at, root = at[u[at] != root], root[u[at] != root]
                yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(label[at]), pa.array(np.zeros(len(at), bool)), pa.array(np.zeros(len(at), np.int64)), pa.array(root)], names)

    names = ["u", "label", "asked", "truth", "link"]
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(work, "u long, label long, asked boolean, truth long, link long")


def audit(nodes: DataFrame, sizes: DataFrame, width: int, least: float) -> DataFrame:
    """True links of about AUDITED rows of every label, drawn by a hash: u, label, truth. What it costs grows with the rows of a label."""
    chosen = nodes.join(sizes, "label").filter(common.uniform(F.col("u"), seed=4) < AUDITED / F.col("rows")).select("u", "label", "x")
    seen = compared(nodes, chosen, sizes, width, least).filter("asked")
    return common.settled(seen.groupBy("u", "label").agg(F.sum("truth").alias("truth")), "audit")


def recalls(truth: DataFrame, sums: DataFrame) -> DataFrame:
    """By label: `linked` (audited rows with links), `recall` (the share that has all of them in `sums`), `recall_low` (its lower bound at 95 %),
    and `weakest`, the recall of rows with few links or of those with many, whichever is less. A label without a linked row has no line."""
    own = truth.filter("truth > 0").join(sums, "u", "left").select(
        "label", (F.col("truth") <= LONGEST).alias("few"), (F.coalesce("links", F.lit(0)) >= F.col("truth")).cast("long").alias("whole"))
    each = own.groupBy("label", "few").agg(F.count("*").alias("linked"), F.sum("whole").alias("whole"))
    both = each.groupBy("label").agg(F.sum("linked").alias("linked"), F.sum("whole").alias("whole"), F.min(F.col("whole") / F.col("linked")).alias("weakest"))
    z, n, p = 1.645, F.col("linked"), F.col("whole") / F.col("linked")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return both.select("label", "linked", p.alias("recall"), low.alias("recall_low"), "weakest")


def near_vectors(table: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", exact: bool = False) -> DataFrame:
    """Links between vectors of one label whose cosine, in double precision, is at least `least`.

    Returns id_col, `n_links` (other vectors linked directly), `component_id` (smallest id reachable), `kept` (id_col =
    component_id), and for the label of the row `audited_linked`, `recall` and `recall_low`, see `recalls` (null where no audited row of the
    label has a link), a row for each row of `table`.

    Equal vectors of a label form one node. The first lists of neighbours come from orders by random planes; each round joins the
    rows around every row (its list, and the nearest of those that list it) with each other and keeps what is nearer. Lists that
    hold nothing but links are saturated and grow. Every link seen joins two nodes, also one that no list has room for. Then all
    rows of a component are compared in blocks, which completes the lists of crowded groups exactly. Labels of every size take
    this way. An audit compares AUDITED rows of every label with the whole label; labels in which fewer than TARGET of the linked ones have
    all their links, by rows of few and of many links, get twice as many tables and more rounds, up to TURNS times. What is short then
    stays so and is told by `recall`; `exact` compares these labels whole instead, rows times rows.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without label or id link with nothing (a
    null id has a null component and is not kept). Rows that repeat an id are one vector. Entries of a list that are equally near go by the
    smaller id. Vectors of several widths are an error. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    usable = vectors.usable(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = table.filter(usable).select(F.col(id_col).cast("long").alias("v"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
    rows = rows.dropDuplicates(["v"]).withColumn("own", F.md5(F.col("x").cast("string").cast("binary")))
    rows = common.settled(rows, "vectors")
    width = vectors.one_width(rows, "x")
    classes = rows.groupBy("label", "own").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    nodes = common.settled(rows.select("v", "x").join(classes, "v").select(F.col("v").alias("u"), "label", "x", "n", "own"), "nodes")
    sizes = common.settled(nodes.groupBy("label").agg(F.count("*").alias("rows")), "sizes")
    count = sizes.agg(F.sum("rows")).first()[0] if width else 0
    if not count:
        alone = table.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
        return alone.select("*", F.col(id_col).isNotNull().alias("kept"), *[F.lit(None).cast(k).alias(c) for c, k in (("audited_linked", "long"), ("recall", "double"), ("recall_low", "double"))])

    truth = audit(nodes, sizes, width, least)
    left, links, graph = sizes, None, None
    for turn in range(TURNS):
        own = nodes.join(left, "label", "left_semi")
        found = common.settled(first_lists(own, left, width, least, turn), "seen")
        lists = found.select("u", "near", F.lit(NEIGHBOURS).alias("most"))
        if graph is not None:
            lists = lists.unionByName(graph.join(own.select("u"), "u", "left_semi").select("u", "near", "most"))
        graph = common.settled(merged(lists, least), "graph")
        for step in range(ROUNDS + 1):
            seen = found.filter("link is not null").select(F.col("u").alias("a"), F.col("link").alias("b"))
            links = seen if links is None else links.unionByName(seen)
            if step < ROUNDS:
                found = common.settled(refined(graph, nodes, width, least), "seen")
                both = found.join(graph.select("u", "most"), "u").select("u", "near", "most").unionByName(graph.select("u", "near", "most"))
                graph = common.settled(merged(both, least), "graph")
        component = common.components(links.distinct())
        links = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
        sums = common.settled(counted(nodes, component, width, least), "counts")
        measured = common.settled(recalls(truth, sums), "recall")
        left = common.settled(sizes.join(measured.filter(F.col("weakest") < TARGET), "label", "left_semi"), "open")
        if left.isEmpty():
            break
    if exact and not left.isEmpty():
        those = nodes.join(left, "label", "left_semi")
        rest = common.settled(compared(those, those, left, width, least), "rest")
        component = common.components(links.unionByName(rest.filter("link is not null").select(F.col("u").alias("a"), F.col("link").alias("b"))))
        sums = common.settled(counted(nodes, component, width, least), "counts")
        measured = recalls(truth, sums)

    grouped = nodes.select("u", "label", "own", "n").join(component, nodes.u == component.node, "left").join(sums, "u", "left").join(measured, "label", "left")
    shown = [F.col("linked").alias("audited_linked"), "recall", "recall_low"]
    grouped = grouped.select("label", "own", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "u").alias("component_id"), *shown)
    named = rows.select("v", "label", "own").join(grouped, ["label", "own"]).drop("label", "own")
    result = table.select(F.col(id_col).alias("_id")).join(named, F.col("_id").cast("long") == F.col("v"), "left")
    component_id = F.coalesce(F.col("component_id"), F.col("_id").cast("long"))
    return result.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"),
                         F.coalesce(F.col("_id") == component_id, F.lit(False)).alias("kept"), "audited_linked", "recall", "recall_low")


def op2_nn_descent(spark, sf_dir: str) -> DataFrame:
    """Contract: all embeddings, links within a label at a cosine of 0.93."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"), 0.93)
