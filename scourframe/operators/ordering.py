"""Order-dependent results without a window over a whole table or a whole hot group.

Positions in a table: a unique BIGINT key is cut into chunks of fixed width, which bounds the rows of a chunk.

Windows over groups: rows are dealt to range partitions of (group, order), which hold about equal numbers of rows whatever the
keys are; Spark samples the borders. A group may reach over many partitions. Windows run inside (partition, group); what has to
cross a border is scanned over one summary row per (partition, group), so that this table has as many rows as there are partitions and
groups, and joined back on the keys by which the rows are already dealt. Small tables take the same path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scourframe.session import cut_lineage

CHUNK_BITS = 20
PART = "_part"


def _chunk_offsets(counts: DataFrame) -> DataFrame:
    """(chunk, n) -> (chunk, n, offset). The running sum is taken inside super-chunks of at most 2^20 chunks, then
    over the super-chunks, so no task sees more than 2^20 rows for keys below 2^60."""
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    counts = counts.withColumn("_super", F.shiftright("_chunk", CHUNK_BITS))
    inner = Window.partitionBy("_super").orderBy("_chunk").rowsBetween(*before)
    within = counts.withColumn("_within", F.coalesce(F.sum("_n").over(inner), zero))
    supers = counts.groupBy("_super").agg(F.sum("_n").alias("_sn"))
    outer = Window.orderBy("_super").rowsBetween(*before)
    supers = supers.withColumn("_before", F.coalesce(F.sum("_sn").over(outer), zero)).drop("_sn")
    return within.join(supers, "_super").select("_chunk", "_n", (F.col("_within") + F.col("_before")).alias("_offset"))


def chunk_counts(df: DataFrame, key: Column, bits: int = CHUNK_BITS) -> DataFrame:
    """(_chunk, _n, _offset) for a unique, non-negative BIGINT key; reads the key column only."""
    return _chunk_offsets(df.groupBy(F.shiftright(key, bits).alias("_chunk")).agg(F.count(F.lit(1)).alias("_n")))


def with_position(
    df: DataFrame, key: str | Column = "row_id", name: str = "position", tie: str | None = None, bits: int = CHUNK_BITS
) -> DataFrame:
    """0-based position of every row in key order.

    `tie` names a unique column that orders rows with equal keys (for hash keys, where a chunk then holds the rows
    of a hash range instead of a fixed number of ids).
    """
    key = F.col(key) if isinstance(key, str) else key
    order = [key] + ([F.col(tie)] if tie else [])
    offsets = chunk_counts(df, key, bits).select("_chunk", "_offset")
    w = Window.partitionBy("_chunk").orderBy(*order)
    numbered = df.withColumn("_chunk", F.shiftright(key, bits)).withColumn("_rn", F.row_number().over(w))
    return numbered.join(offsets, "_chunk").withColumn(name, F.col("_offset") + F.col("_rn") - 1).drop(
        "_chunk", "_rn", "_offset"
    )


def rows_at_positions(df: DataFrame, positions: DataFrame, key: str = "row_id", bits: int = CHUNK_BITS) -> DataFrame:
    """(position, key) for a list of positions; only the keys are read and numbered, whatever the width of the table."""
    positions = positions.select(F.col("position").cast("bigint").alias("position")).distinct()
    return with_position(df.select(key), key, bits=bits).join(positions, "position").select("position", key)


def lowest(df: DataFrame, h: Column, ties: Sequence[str], k: int) -> DataFrame:
    """The k rows of the lowest hash in [0, 2^32), ties by the columns of `ties`.

    A histogram of the upper bits tells in which bucket rank k falls, and one of the next bits of that bucket in which part of it. What
    lies below needs no order; only the part at the border, a 2^24th of a uniform hash, is sorted. Both histograms have 4,096 rows.
    """
    rows = df.withColumn("_h", h)
    left, edge = k, F.lit(True)
    for shift in (20, 8):
        sizes = rows.filter(edge).groupBy(F.shiftright("_h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b, n in sorted((r["b"], r["n"]) for r in sizes):
            if left <= n:
                break
            left -= n
        else:
            return df  # no more than k rows
        edge = F.shiftright("_h", shift) == b
    below = rows.filter(F.shiftright("_h", 8) < b)
    return below.unionByName(rows.filter(edge).orderBy("_h", *ties).limit(left)).drop("_h")


# -- windows over groups ------------------------------------------------------------------------------------------

def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows in range partitions of (group, order), numbered in column `_part` and written.

    They are written because borders come from a sample, which a second evaluation need not draw alike. Without `parts` Spark
    takes its own number of partitions.
    """
    keys = [F.col(c) for c in (*group, *order)]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return cut_lineage(dealt.withColumn(PART, F.spark_partition_id()))


class GroupWindow:
    """Lag, row number, running sum and running minimum over `group` in `order`; (group, order) is unique.

    All requested columns share one dealing of the rows. A table that still has its `_part` column, from an earlier window over the
    same groups and order, is not dealt again. Rows with a null group form a group of their own.
    """

    def __init__(self, df: DataFrame, group: Sequence[str], order: str | Sequence[str], parts: int | None = None):
        self.group = list(group)
        self.order = [order] if isinstance(order, str) else list(order)
        self.rows = df if PART in df.columns else ranged(df, self.group, self.order, parts)
        self.keys = [PART, *self.group]
        self.inner = Window.partitionBy(*self.keys).orderBy(*self.order)
        self.outer = Window.partitionBy(*self.group).orderBy(PART)
        self.before = self.outer.rowsBetween(Window.unboundedPreceding, -1)
        self.local: dict[str, Column] = {}
        self.carry: list[Column] = []
        self.carried: dict[str, Column] = {}
        self.final: dict[str, Column] = {}

    def _add(self, name: str, local: Column, carry: Column, carried: Callable, final: Callable) -> GroupWindow:
        self.local[f"_l_{name}"] = local
        self.carry.append(carry.alias(f"_c_{name}"))
        self.carried[f"_c_{name}"] = carried(F.col(f"_c_{name}"))
        self.final[name] = final(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        return self

    def lag(self, name: str, value: str) -> GroupWindow:
        self.local["_first"] = F.row_number().over(self.inner) == 1
        return self._add(
            name, F.lag(value).over(self.inner), F.max_by(value, F.struct(*self.order)), lambda c: F.lag(c).over(self.outer),
            lambda local, carried: F.when(F.col("_first"), carried).otherwise(local),
        )

    def row_number(self, name: str) -> GroupWindow:
        return self._add(
            name, F.row_number().over(self.inner).cast("bigint"), F.count(F.lit(1)), lambda c: F.sum(c).over(self.before),
            lambda local, carried: local + F.coalesce(carried, F.lit(0).cast("bigint")),
        )

    def running_sum(self, name: str, value: Column) -> GroupWindow:
        """Sum of a whole number up to and including the row; nulls count nothing."""
        n = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
        frame = self.inner.rowsBetween(Window.unboundedPreceding, 0)
        return self._add(
            name, F.sum(n).over(frame), F.sum(n), lambda c: F.sum(c).over(self.before),
            lambda local, carried: local + F.coalesce(carried, F.lit(0).cast("bigint")),
        )

    def running_min(self, name: str, value: Column) -> GroupWindow:
        """Smallest value up to and including the row."""
        frame = self.inner.rowsBetween(Window.unboundedPreceding, 0)
        return self._add(name, F.min(value).over(frame), F.min(value), lambda c: F.min(c).over(self.before), F.least)

    def following_min(self, name: str, value: Column) -> GroupWindow:
        """Smallest value from the row to the end of its group."""
        back = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, 0)
        later = Window.partitionBy(*self.group).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
        return self._add(name, F.min(value).over(back), F.min(value), lambda c: F.min(c).over(later), F.least)

    def first_where(self, name: str, condition: Column) -> GroupWindow:
        """Order value of the first row of the group, up to and including this one, that meets the condition."""
        hit = F.when(condition, F.col(self.order[0]))
        return self._add(
            name, F.min(hit).over(self.inner.rowsBetween(Window.unboundedPreceding, 0)), F.min(hit),
            lambda c: F.min(c).over(self.before), lambda local, carried: F.least(local, carried),
        )

    def result(self, keep_part: bool = False) -> DataFrame:
        """`keep_part` leaves the column `_part` for a further window over the same groups and order."""
        summary = self.rows.groupBy(*self.keys).agg(*self.carry).select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *[c.alias(n) for n, c in self.carried.items()]
        )
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        rows = self.rows.withColumns(self.local).join(summary, same).withColumns(self.final)
        used = [*self.local, *self.carried, *[f"_k{i}" for i in range(len(self.keys))]]
        return rows.drop(*used, *([] if keep_part else [PART]))


def recent_items(
    df: DataFrame, group: Sequence[str], order: str, item: str, k: int, name: str, parts: int | None = None
) -> DataFrame:
    """List of the items of the last k rows before each row, oldest first; rows without an item add nothing.

    What crosses a border is the last k rows of each (partition, group).
    """
    group = list(group)
    entry = F.struct(F.col(item).alias("i"))

    def items(entries: Column) -> Column:
        return F.array_compact(F.transform(entries, lambda s: s["i"]))

    keys = [PART, *group]
    rows = df if PART in df.columns else ranged(df, group, [order], parts)
    inner = Window.partitionBy(*keys).orderBy(order)
    outer = Window.partitionBy(*group).orderBy(PART).rowsBetween(-k, -1)
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    tails = (
        rows.select(*keys, order, entry.alias("_s"))
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= k)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "_s"))), lambda t: t["_s"]).alias("_tail"))
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.flatten(F.collect_list("_tail").over(outer)).alias("_before"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    both = F.concat(F.coalesce(F.col("_before"), F.filter(F.col("_near"), lambda s: F.lit(False))), F.col("_near"))
    recent = F.slice(F.col("_both"), F.greatest(F.size("_both") - k, F.lit(0)) + 1, F.lit(k))
    return (
        rows.withColumn("_near", F.collect_list(entry).over(inner.rowsBetween(-k, -1)))
        .join(tails, same, "left")
        .withColumn("_both", both)
        .withColumn(name, items(recent))
        .drop(PART, "_near", "_before", "_both", *[f"_k{i}" for i in range(len(keys))])
    )


# -- positions behind drops -----------------------------------------------------------------------------------------

SHIFT_ROWS = 1 << 17


def positions_before_drops(
    ops: DataFrame, group: Sequence[str], order: str, position: str, drop: str, name: str, rows: int = SHIFT_ROWS
) -> DataFrame:
    """Adds `name`: the place that the row now at `position` (not negative) had before any drop of its group.

    A drop at p shifts what stands behind it: place q was q before it, or q + 1 if q >= p. What a run of steps shifts is therefore
    known from the set of places it drops, counted from its begin: sorted as d0 < d1 < ..., place q was q + (number of i with
    d_i - i <= q). Runs are composed pairwise, as a tree: once both halves of a run are expressed from their own begin, the places of
    the later half move to the begin of the run by the drops of the earlier half. A place that does not exist stays at or behind
    the end of the table, so a drop that fails shifts nothing that exists.

    Range partitions of the steps are the leaves; a leaf is resolved by one task, in which the same tree is built over arrays, for all of its groups at once. A group
    inside one partition is finished then. Groups that reach over several are composed partition by partition: ranks and counts are
    running sums over range partitions, so that no step gathers a group.
    """
    group = list(group)
    parts = max(1, -(-ops.count() // rows))
    leaves = ranged(ops, group, [order], parts)
    names = leaves.columns
    at, place, dropping, groups = names.index(order), names.index(position), names.index(drop), [names.index(c) for c in group]

    def resolve(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code = np.zeros(table.num_rows, np.int64)
        for c in groups:
            coded = pc.dictionary_encode(table.column(c).combine_chunks(), null_encoding="encode")
            code = code * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
        sort = pc.sort_indices(pa.table({"code": code, "at": table.column(at)}), sort_keys=[("code", "ascending"), ("at", "ascending")])
        table, code = table.take(sort), code[sort.to_numpy()]
        q = table.column(place).to_numpy().astype(np.int64)
        gone = table.column(dropping).to_numpy(zero_copy_only=False).astype(bool)
        index, size = np.arange(len(q)) - np.searchsorted(code, code), 1  # of a step in its group
        longest = index.max() + 1
        while size < longest:
            run, later = code * longest + index // (2 * size), index // size % 2 == 1
            left = np.flatnonzero(~later & gone)
            left = left[np.lexsort((q[left], run[left]))]
            first = np.searchsorted(run[left], run[left])  # of its run
            shift = q[left] - (np.arange(len(left)) - first)
            right = np.flatnonzero(later)
            values, both = np.unique(np.concatenate([shift, q[right]]), return_inverse=True)
            of = np.unique(run, return_inverse=True)[1]
            keys, asked = of[left] * len(values) + both[: len(left)], of[right] * len(values) + both[len(left):]
            q[right] += np.searchsorted(keys, asked, side="right") - np.searchsorted(run[left], run[right])
            size *= 2
        return table.append_column(name, pa.array(q, pa.int64()))

    kinds = ", ".join(f"`{c}` {t}" for c, t in leaves.dtypes) + f", `{name}` bigint"
    done = leaves.groupBy(PART).applyInArrow(resolve, kinds)
    if parts == 1:
        return done.drop(PART)
    span = leaves.groupBy(*group).agg(F.min(PART).alias("_low"), F.max(PART).alias("_high")).filter("_low < _high")
    span = span.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)])  # one group a border at most, but they may hold most rows
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    done = cut_lineage(done)
    far, near = cut_lineage(done.join(span, same, "left_semi")), done.join(span, same, "left_anti")
    for level in range((parts - 1).bit_length()):
        far = _composed(far, group, order, name, drop, level)
    return near.unionByName(far).drop(PART)


def _composed(rows: DataFrame, group: list[str], order: str, name: str, drop: str, level: int) -> DataFrame:
    """One level of the tree: the later halves of runs of 2^(level + 1) partitions move to the begin of their run."""
    run = [*group, "_run"]
    marked = rows.withColumn("_run", F.shiftright(PART, level + 1)).withColumn("_later", F.shiftright(PART, level) % 2 == 1)
    left = marked.filter(~F.col("_later") & F.col(drop)).select(*run, F.col(name).alias("_d"))
    ranks = GroupWindow(left, run, "_d").row_number("_rank").result()
    kinds = dict(rows.dtypes)
    shifts = ranks.select(*run, (F.col("_d") - F.col("_rank") + 1).alias("_at"), F.lit(0).alias("_asks"), F.col("_d").alias("_tie"), F.lit(None).cast(kinds[order]).alias(order))
    asked = marked.filter("_later").select(*run, F.col(name).alias("_at"), F.lit(1).alias("_asks"), F.col(order).cast("bigint").alias("_tie"), order)
    counted = GroupWindow(shifts.unionByName(asked), run, ["_at", "_asks", "_tie"]).running_sum("_moves", F.col("_asks") == 0).result()
    keys = [*group, order]
    moves = counted.filter("_asks = 1").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], "_moves")
    moved = rows.join(moves, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(keys)], "left").withColumn(name, F.col(name) + F.coalesce("_moves", F.lit(0).cast("bigint")))
    return cut_lineage(moved.select(*rows.columns))
