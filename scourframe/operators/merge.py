"""Merging sources that name their columns differently, and removing exact and near copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import names as N
from scourframe.functions import scalars as X
from scourframe.operators import ordering as O
from scourframe.operators import profile as P
from scourframe.session import cut_lineage

CASE_CONF = "spark.sql.caseSensitive"
ROUNDING = 0.005  # fixed value: half a unit of the second decimal


# -- conform and union ----------------------------------------------------------------------------------------------

def rename_by_alias(df: DataFrame, alias_to_canonical: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: c for a, c in alias_to_canonical.items() if a in df.columns})


def conform_source(
    df: DataFrame, aliases: Mapping[str, str], date_column: str, date_format: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Rename a source to the canonical columns (`aliases`: canonical -> alias) and render its dates as ISO text."""
    renamed = rename_by_alias(df, N.invert_alias(aliases))
    day = F.try_to_date(X.strip(F.col(date_column)), date_format)
    return renamed.withColumn(date_column, X.iso(day)).select(*keep, *aliases)


def merge_sources(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of differing columns, NULL where a source lacks one. Names that differ by case only stay apart, for
    which the session must be case-sensitive; otherwise this refuses instead of merging them silently."""
    names = {c for f in frames for c in f.columns}
    if len({n.lower() for n in names}) < len(names) and frames[0].sparkSession.conf.get(CASE_CONF) != "true":
        raise ValueError(f"columns differ by case only; conform the sources first or set {CASE_CONF}=true")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coalesce_aliases(
    df: DataFrame,
    sources: Mapping[str, Mapping[str, str]],
    canonical: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Collapse each alias group of an already merged table to its canonical column.

    Columns are taken by position, so names that differ by case only are no problem.
    """
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    where: dict[str, list[str]] = {}
    for i, name in enumerate(df.columns):
        where.setdefault(name, []).append(f"_c{i}")
    out = [F.col(where[k][0]).alias(k) for k in keep]
    for name in canonical:
        aliases = [name] + [m[name] for m in sources.values() if name in m and m[name] != name]
        cells = [F.col(c) for a in aliases for c in where.get(a, [])]
        out.append((F.coalesce(*cells) if cells else F.lit(None).cast("string")).alias(name))
    return flat.select(*out)


def alias_lookup(df: DataFrame, column: str, lookup: Mapping[str, str], name: str = "canonical") -> DataFrame:
    """Canonical name of each alias; the map is a fixed list of columns and rides along as a literal."""
    return df.withColumn(name, X.lookup(lookup, F.col(column)))


# -- copies ---------------------------------------------------------------------------------------------------------

def dedup_exact(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per distinct content, with the lowest row id. Copies fold before the shuffle, so a content that makes
    up a third of the table costs one row per task."""
    columns = P.data_columns(df, row_id)
    return df.groupBy(*columns).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def dedup_by_key(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The row with the lowest row id per key. Only keys and ids are aggregated and joined; the wide rows meet the ids that
    lose."""
    lost = duplicate_pairs(df, keys, row_id).select(F.col("duplicate_id").alias(row_id))
    return df.join(lost, row_id, "left_anti").select(*df.columns)


def duplicate_pairs(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(original_id, duplicate_id): each later row of a key against the first one, never all pairs.

    Keys without a copy are dropped before the join; a hot key is split by the adaptive skew join.
    """
    firsts = df.groupBy(*keys).agg(F.min(row_id).alias("original_id"), F.count(F.lit(1)).alias("_n"))
    copied = firsts.filter(F.col("_n") > 1).drop("_n")
    rows = df.select(*keys, F.col(row_id).alias("duplicate_id"))
    same = [rows[k].eqNullSafe(copied[k]) for k in keys]
    return (
        rows.join(copied, reduce(Column.__and__, same))
        .filter(F.col("duplicate_id") > F.col("original_id"))
        .select("original_id", "duplicate_id")
    )


def near_duplicates(
    df: DataFrame, keys: Sequence[str], amount: str, pct: float = 0.01, row_id: str = "row_id"
) -> DataFrame:
    """(original_id, duplicate_id): rows with the same keys and an amount within `pct` of that of an earlier row,
    with the lowest such earlier row id. Rows without an amount are never copies.

    "Within pct of a" is a fixed distance on the scale u = ln(amount + slack / pct), so the earliest row in reach of
    each row is a sliding minimum. Cutting u into cells as wide as the reach splits every reach into the end of one
    cell and the start of the next; running minima inside cells then answer it. No pair is formed, and equal amounts fold to one row
    first. Cells are scanned over range partitions, so that a cell of any number of amounts is spread, with the minimum of each
    partition carried on. The source is read once.
    """
    keys = [*keys, "_negative"]  # amounts of differing sign are never close
    # Amounts with two decimals are rounded, hence half a unit of slack. Half of the smallest step of `pct * a` on
    # top keeps pairs that lie exactly on the bound inside it whatever the floating-point rounding.
    slack = ROUNDING + pct * ROUNDING
    below, above = F.log(F.lit(1.0 + pct)), -F.log(F.lit(1.0 - pct))
    reach = below + above
    x = X.safe_float(P.present(df, amount))
    base = df.withColumns({"_a": F.abs(x), "_negative": x < 0}).filter(F.col("_a").isNotNull())
    base = cut_lineage(base.select(row_id, *keys, "_a"))
    points = (
        base.groupBy(*keys, "_a")
        .agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_u", F.log(F.col("_a") + F.lit(slack / pct)))
    )
    # kind 1 carries a row id; kind 0 asks for the minimum from here to the end of the cell; kind 2 for the minimum
    # from the start of the next cell to here. At equal places, rows come after the start and before the end of a reach.
    start, end = F.col("_u") - below, F.col("_u") + above
    first_cell = F.floor(start / reach)

    def mark(kind: int, at: Column, cell: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), cell.alias("cell"))

    places = F.array(
        mark(0, start, first_cell), mark(1, F.col("_u"), F.floor(F.col("_u") / reach)), mark(2, end, first_cell + 1)
    )
    marked = points.select(*keys, "_a", "_first", "_n", F.explode(places).alias("_m")).select(
        *keys, "_a", "_first", "_n", F.col("_m.kind").alias("_kind"), F.col("_m.at").alias("_at"), F.col("_m.cell").alias("_cell")
    )
    row_here = F.when(F.col("_kind") == 1, F.col("_first"))
    scan = O.GroupWindow(marked, [*keys, "_cell"], ["_at", "_kind", "_a"]).running_min("_before", row_here).following_min("_after", row_here)
    answer = F.when(F.col("_kind") == 0, F.col("_after")).when(F.col("_kind") == 2, F.col("_before"))
    answers = scan.result().withColumn("_answer", answer).filter(F.col("_answer").isNotNull())
    earliest = (
        answers.groupBy(*keys, "_a")
        .agg(F.min("_answer").alias("original_id"), F.first("_first").alias("_first"), F.first("_n").alias("_n"))
        .filter((F.col("original_id") < F.col("_first")) | (F.col("_n") > 1))  # the rest holds no copy
        .drop("_first", "_n")
    )
    ids = base.select(*keys, "_a", F.col(row_id).alias("duplicate_id"))
    same = [ids[k].eqNullSafe(earliest[k]) for k in [*keys, "_a"]]
    return (
        ids.join(earliest, reduce(Column.__and__, same))
        .filter(F.col("original_id") < F.col("duplicate_id"))
        .select("original_id", "duplicate_id")
    )


def dedup_near(
    df: DataFrame, keys: Sequence[str], amount: str, pct: float = 0.01, row_id: str = "row_id"
) -> DataFrame:
    """Drop every row that has an earlier row with the same keys and an amount within `pct`."""
    copies = near_duplicates(df, keys, amount, pct, row_id).select(F.col("duplicate_id").alias(row_id))
    return df.join(copies, row_id, "left_anti")
