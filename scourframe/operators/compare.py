"""Comparing a table with another one like it. Digests of key ranges tell where the two differ, and only these ranges are joined.

Both tables are scanned and folded to one narrow row per range before anything is shuffled. Rows that arrive in key order, as they are
stored, leave about one such row per range and task. Ranges nest: a range of the next level holds 2 ** LEVEL_BITS of the one below.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import scalars as X
from scourframe.operators import grade as Q
from scourframe.operators import inject as I
from scourframe.operators import profile as P
from scourframe.session import cut_lineage

ROWS_PER_RANGE = 1024
LEVEL_BITS = 6
MOST_RANGES = 100_000  # of 8 bytes, to every task; above it ranges of a higher level are taken
SALT = 40503


@dataclass(frozen=True)
class Ranges:
    """Where two tables differ. `differing` has one column `node`, at most MOST_RANGES rows; the range of a key is key >> shift.

    `equal` has one row: rows and unequal cells (see `differing_ranges`) of the ranges that do not differ.
    """

    differing: DataFrame
    equal: DataFrame
    shift: int
    row_id: str

    def within(self, df: DataFrame) -> DataFrame:
        """The rows of a table that lie in the ranges that differ: a filter in the scan's own tasks, no exchange of rows."""
        node = F.shiftright(F.col(self.row_id).cast("bigint"), self.shift)
        return df.join(F.broadcast(self.differing), node == self.differing["node"], "left_semi")


def row_digests(row_id: str, columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row. Hash functions skip NULL, so each cell comes with whether it is there."""
    cells = [F.col(row_id).cast("bigint")]
    for c in columns:
        cells += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*cells), F.xxhash64(F.lit(SALT), *cells)


def _leaf_shift(keys: DataFrame, rows_per_range: int) -> tuple[int, int]:
    """Bits of a key inside of a range of about as many rows, and the levels above it up to a single range."""
    low, high, n = keys.agg(F.min("k"), F.max("k"), F.count("k")).first()
    span = 1 if n == 0 else high - low + 1
    shift = max(0, (span * rows_per_range // max(n, 1)).bit_length() - 1)
    return shift, max(0, span.bit_length() - shift) // LEVEL_BITS + 1


def differing_ranges(
    a: DataFrame, b: DataFrame, columns: Sequence[str], row_id: str = "row_id", unequal: Column | None = None,
    rows_per_range: int = ROWS_PER_RANGE, most_ranges: int = MOST_RANGES,
) -> Ranges:
    """Key ranges in which two tables hold different rows, by the given columns, which both have with the same types.

    A range is equal if both sides have as many rows, and the exclusive or of two row hashes and the sum of half a hash agree; none of these
    depends on order, and rows that are repeated show in count and sum. `unequal` is a number per row of `b`, summed over equal ranges
    only. Keys are BIGINT and not NULL.
    """
    keys = a.select(F.col(row_id).cast("bigint").alias("k")).unionAll(b.select(F.col(row_id).cast("bigint").alias("k")))
    shift, levels = _leaf_shift(keys, rows_per_range * 2)  # each key counts twice, once a table
    first, second = row_digests(row_id, columns)
    parts = []
    for df, side in ((a, -1), (b, 1)):
        extra = unequal if unequal is not None and side == 1 else F.lit(0)
        parts.append(df.select(
            F.shiftright(F.col(row_id).cast("bigint"), shift).alias("node"), first.alias("x"), second.alias("y"),
            F.lit(side).cast("bigint").alias("side"), extra.cast("bigint").alias("unequal"),
        ))
    half = F.col("x").bitwiseAND(F.lit(0xFFFFFFFF))
    folded = parts[0].unionAll(parts[1]).groupBy("node").agg(
        F.sum("side").alias("balance"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum(F.col("side") * half).alias("z"),
        F.sum("unequal").alias("unequal"), F.count_if(F.col("side") == 1).alias("rows"),
    )
    same = (F.col("balance") == 0) & (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    leaves = cut_lineage(folded.select("node", (~same).alias("differs"), "rows", "unequal"))
    up = [F.shiftright("node", LEVEL_BITS * k) for k in range(levels + 1)]
    counts = leaves.filter("differs").agg(*[F.count_distinct(node) for node in up]).first()
    level = next((k for k in range(levels + 1) if counts[k] <= most_ranges), levels)
    differing = leaves.filter("differs").select(up[level].alias("node")).distinct()
    rest = leaves.withColumn("node", up[level]).join(F.broadcast(differing), "node", "left_anti")
    zero = F.lit(0).cast("bigint")
    equal = rest.agg(F.coalesce(F.sum("rows"), zero).alias("rows"), F.coalesce(F.sum("unequal"), zero).alias("unequal"))
    return Ranges(differing, equal, shift + LEVEL_BITS * level, row_id)


def cell_match(
    work: DataFrame, clean: DataFrame, row_id: str = "row_id", numeric: Sequence[str] = Q.NUMERIC_CELLS, dates: Sequence[str] = Q.DATE_CELLS,
    null_equal: bool = True,
) -> DataFrame:
    """`grade.cell_match` by row id with the same result; rows of ranges that do not differ are counted and never joined."""
    columns = P.data_columns(clean, row_id)
    a, b = Q.raw_cells(work, columns, row_id), Q.raw_cells(clean, columns, row_id)
    misses = [F.when(Q.same_cell(F.col(c), F.col(c), c, numeric, dates, null_equal), 0).otherwise(1) for c in columns]
    ranges = differing_ranges(a, b, columns, row_id, unequal=sum(misses[1:], misses[0]))
    counts = Q.cell_counts(Q.align_rows(ranges.within(a), ranges.within(b), row_id), columns, null_equal, numeric, dates)
    cells = F.col("rows") * len(columns)
    rest = ranges.equal.select((cells - F.col("unequal")).alias("matches"), cells.alias("total_cells"))
    both = counts.unionByName(rest).agg(F.sum("matches").alias("matches"), F.sum("total_cells").alias("total_cells"))
    return Q.match_result(both)


def count_dirty_cells(dirty: DataFrame, clean: DataFrame, row_id: str = "row_id") -> DataFrame:
    """`inject.count_dirty_cells` with the same result, joined in ranges that differ."""
    columns = P.data_columns(clean, row_id)
    a, b = (t.select(row_id, *[X.as_text(P.present(t, c)).alias(c) for c in columns]) for t in (dirty, clean))
    ranges = differing_ranges(a, b, columns, row_id)
    return I.count_dirty_cells(ranges.within(a), ranges.within(b), row_id)


def changed_cells(old: DataFrame, new: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows that turn `old` into `new`: row_id, the columns of `new`, `_set` (names of cells that changed; all of a new row) and `_gone`.

    Columns that `old` lacks, or has with another type, are set in every row, so that such a change meets all rows.
    """
    columns = P.data_columns(new, row_id)
    before, after = dict(old.dtypes), dict(new.dtypes)
    kept = [c for c in columns if before.get(c) == after[c]]
    a, b = old.select(row_id, *kept), new
    if kept == columns:
        ranges = differing_ranges(a, b, columns, row_id)
        a, b = ranges.within(a), ranges.within(b)
    a = a.select(row_id, *[F.col(c).alias(f"_old_{i}") for i, c in enumerate(kept)], F.lit(True).alias("_a"))
    joined = b.withColumn("_b", F.lit(True)).join(a, row_id, "full")
    fresh = F.col("_a").isNull()
    marks = [
        F.when(fresh | ~F.col(c).eqNullSafe(F.col(f"_old_{kept.index(c)}")) if c in kept else F.lit(True), F.lit(c)) for c in columns
    ]
    gone = F.col("_b").isNull()
    listed = F.when(gone, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))
    out = joined.select(row_id, *columns, listed.alias("_set"), gone.alias("_gone"), fresh.alias("_fresh"))
    return out.filter(F.col("_gone") | F.col("_fresh") | (F.size("_set") > 0)).drop("_fresh")
