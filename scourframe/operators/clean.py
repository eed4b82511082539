"""Cleaning commands: set, drop, standardize, fill, repair categories, treat outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import names as N
from scourframe.functions import scalars as X
from scourframe.operators import ordering as O
from scourframe.operators import profile as P
from scourframe.session import cut_lineage

FILL_STRATEGIES = ("mean", "median", "mode", "drop")
MEDIAN_ACCURACY = 10_000
MODE_ITEMS = 5_000
COUNTED_TYPES = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp")


@dataclass(frozen=True)
class ActionResult:
    success: bool
    error: str | None = None


# -- cells and rows -------------------------------------------------------------------------------------------------

def last_write_wins(patches: DataFrame, row_id: str = "row_id", step: str = "step") -> DataFrame:
    """The latest value per (row, column); steps are unique. The step is aggregated alone, so rows are hashed and not sorted."""
    cell = [row_id, "column"]
    last = patches.groupBy(*cell).agg(F.max(step).alias(step))
    return patches.join(last, [*cell, step]).select(*cell, "value")


def write_cells(
    df: DataFrame,
    patches: DataFrame,
    row_id: str = "row_id",
    step: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Overwrite cells named by (row_id, column, value); a NULL value writes NULL.

    The patches are folded to one row per table row first, so the table meets them in a single equi-join. With `step` the
    latest patch of a cell counts; without it a cell that is patched twice is an error. `columns` names the columns that can
    be patched.
    """
    patched = list(columns) if columns is not None else P.data_columns(df, row_id)
    cells = last_write_wins(patches, row_id, step) if step else patches
    wide = cells.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_p"))
    types = dict(df.dtypes)
    new = {
        c: F.when(F.coalesce(F.map_contains_key("_p", F.lit(c)), F.lit(False)), F.col("_p")[c].try_cast(types[c])).otherwise(F.col(c))
        for c in patched
    }
    out = df.join(wide, row_id, "left")
    return out.select(row_id, *[new.get(c, F.col(c)).alias(c) for c in P.data_columns(df, row_id)])


def cast_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What casting by column majority needs: column, majority_numeric, all_whole; one aggregate for all columns."""
    ratio = P.parse_ratio(df, columns)
    return ratio.select("column", (F.col("ratio") >= 0.5).alias("majority_numeric"), "all_whole")


def cast_like_column(value: Column, majority_numeric: Column, all_whole: Column) -> Column:
    """struct(value, ok): the text that a new value takes in a column, or ok = false where it does not fit."""
    x = X.safe_float(value)
    whole = all_whole & (x % 1 == 0)
    number = F.when(whole, X.as_text(x.try_cast("decimal(38,0)"))).otherwise(X.as_text(X.round2(x)))
    return F.struct(
        F.when(majority_numeric, number).otherwise(X.strip(value)).alias("value"),
        (~majority_numeric | x.isNotNull()).alias("ok"),
    )


def cast_error(value: Column, column: Column) -> Column:
    # The wording of the error.
    return F.concat(
        F.lit("Cannot cast '"), value, F.lit("' to numeric for column '"), column,
        F.lit("'. Provide a plain number (e.g. '29.99')."),
    )


def check_patches(
    df: DataFrame, patches: DataFrame, row_id: str = "row_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """Adds cast_value, success and error to patches (row_id, column, value, step). `columns` names the columns that
    the patches can hit, so that no other one is read for its majority type."""
    available = P.data_columns(df, row_id)
    stats = F.broadcast(cast_statistics(df, [c for c in available if columns is None or c in columns]))  # a row per column
    ids = patches.select(row_id)
    known = df.select(row_id).join(ids, row_id, "left_semi").withColumn("_known", F.lit(True))
    checked = (
        patches.join(stats, "column", "left")
        .join(known, row_id, "left")
        .withColumn("_cast", cast_like_column(F.col("value"), F.col("majority_numeric"), F.col("all_whole")))
    )
    error = (
        F.when(F.col("majority_numeric").isNull(),
               F.concat(F.lit("Column '"), F.col("column"), F.lit(f"' not found. Available: {available}")))
        .when(F.col("_known").isNull(), F.concat(F.lit("Row "), X.as_text(F.col(row_id)), F.lit(" not found.")))
        .when(~F.col("_cast.ok"), cast_error(F.col("value"), F.col("column")))
    )
    return checked.select(
        *patches.columns, F.col("_cast.value").alias("cast_value"), error.alias("error")
    ).withColumn("success", F.col("error").isNull())


def set_values(df: DataFrame, patches: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Patches (row_id, column, value, step) -> (new table, report with success and error per patch).

    A bad column, an unknown row or a value that does not fit its column leaves the table as it was.
    """
    report = cut_lineage(check_patches(df, patches, row_id))  # read twice: by the table and by the report
    good = report.filter("success").select(row_id, "column", F.col("cast_value").alias("value"), "step")
    return write_cells(df, good, row_id, "step"), report.drop("cast_value")


def drop_rows(df: DataFrame, keys: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.join(keys.select(row_id), row_id, "left_anti")


def flag_protected(drops: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Adds `dropped_protected` to a list of dropped keys."""
    marks = protected.select(key).distinct().withColumn("_mark", F.lit(True))
    return drops.join(marks, key, "left").withColumn("dropped_protected", F.col("_mark").isNotNull()).drop("_mark")


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(P.present(df, column).isNotNull())


# -- standardize ---------------------------------------------------------------------------------------------------

def standardize_plan(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> dict[str, str]:
    """Which treatment each column gets: one aggregate over the table, whatever the number of columns."""
    N.require_columns(df, columns)
    kinds, seen = P.kinds_and_evidence(df, columns, row_id, sniff_dates=True)
    for c, kind in kinds.items():
        counts = seen.get(c)
        if kind == "numeric" and counts and counts["present"] and counts["numbers"] / counts["present"] < P.COERCION_SHARE:
            kinds[c] = "string"
    return kinds


def standardized(df: DataFrame, column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == "numeric":
        return X.to_numeric(P.present(df, column))
    if dict(df.dtypes)[column] != "string":
        c = X.as_text(P.present(df, column))
    return X.normalise_dates(c) if kind == "date" else X.strip(c)


def standardize_cols(
    df: DataFrame, columns: Sequence[str], row_id: str = "row_id", kinds: dict[str, str] | None = None
) -> DataFrame:
    kinds = kinds or standardize_plan(df, columns, row_id)
    return df.withColumns({c: standardized(df, c, kinds[c]) for c in columns})


def standardize_col(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    return standardize_cols(df, [column], row_id)


# -- fill ----------------------------------------------------------------------------------------------------------

def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """The whole column becomes numeric; words count as missing and are filled too."""
    return fill_missing(df, column, "mean")[0]


def exact_medians(df: DataFrame, values: Mapping[str, Column]) -> dict[str, float | None]:
    """Interpolated medians of numeric expressions, all at once and exact at any size; NULL and infinite values do not count.

    The first pass folds mergeable quantile sketches, which put a bracket around each median. The second counts what lies below the bracket
    and each distinct value inside; a running count over range partitions then tells the values at the middle ranks. A bracket
    that misses them, which the sketch allows, is opened, and the values of that column are all counted.
    """
    names = list(values)
    cells = [values[c].cast("double") for c in names]
    x = df.select(*[F.when(F.abs(c) < float("inf"), c).alias(f"x{i}") for i, c in enumerate(cells)])
    margin = min(0.5, 2.0 / MEDIAN_ACCURACY)
    sketches = [F.percentile_approx(f"x{i}", [0.5 - margin, 0.5 + margin], MEDIAN_ACCURACY).alias(f"q{i}") for i in range(len(names))]
    row = x.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))], *sketches).first()
    brackets = {i: tuple(row[f"q{i}"]) for i in range(len(names)) if row[f"n{i}"]}
    medians: dict[str, float | None] = dict.fromkeys(names)
    while brackets:
        found = _at_middle(x, {i: (*bracket, row[f"n{i}"]) for i, bracket in brackets.items()})
        for i in list(brackets):
            low, high = found.get((i, 0)), found.get((i, 1))
            if None in (low, high) or float("-inf") in (low, high):
                brackets[i] = (float("-inf"), float("inf"))
            else:
                medians[names[i]] = 0.5 * low + 0.5 * high
                del brackets[i]
    return medians


def _at_middle(x: DataFrame, brackets: Mapping[int, tuple[float, float, int]]) -> dict[tuple[int, int], float]:
    """The values at the two middle ranks of each column, -inf where they lie below the bracket, nothing where they lie above."""
    def cell(i: int, low: float, high: float) -> Column:
        c = F.col(f"x{i}")
        return F.struct(F.lit(i).alias("i"), F.when(c < low, float("-inf")).when(c <= high, c).alias("x"))

    cells = F.filter(F.array(*[cell(i, low, high) for i, (low, high, _) in brackets.items()]), lambda s: s["x"].isNotNull())
    counts = x.select(F.explode(cells).alias("s")).groupBy("s.i", "s.x").agg(F.count(F.lit(1)).alias("n"))
    middle = F.create_map(*[F.lit(v) for i, (*_, n) in brackets.items() for v in (i, n)])[F.col("i")]
    running = O.GroupWindow(counts, ["i"], "x").running_sum("upto", F.col("n")).result()
    places = [F.floor((middle - 1) / 2), F.floor(middle / 2)]
    holds = [(F.col("upto") > r) & (F.col("upto") - F.col("n") <= r) for r in places]
    rows = running.select("i", "x", holds[0].alias("lower"), holds[1].alias("upper")).filter("lower or upper").collect()  # two a column at most
    return {(r["i"], k): r["x"] for r in rows for k, held in enumerate((r["lower"], r["upper"])) if held}


def exact_median(df: DataFrame, value: Column) -> float | None:
    return exact_medians(df, {"x": value})["x"]


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: column, median (NULL without a number)."""
    medians = exact_medians(df, {c: X.to_numeric(P.present(df, c)) for c in columns})
    return df.sparkSession.createDataFrame(list(medians.items()), "`column` string, median double")


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return fill_missing(df, column, "median")[0]


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, the smallest on a tie. Counting is combined before the shuffle."""
    c = P.present(df, column)
    counts = df.select(c.alias("mode")).filter(F.col("mode").isNotNull()).groupBy("mode").count()
    return counts.orderBy(F.desc("count"), F.asc("mode")).limit(1).select("mode")


def exact_mode(df: DataFrame, column: str):
    """The most frequent value, the smallest on a tie, None where all are missing.

    The first pass folds a mergeable summary of frequent items, whose estimates are too high by at most 3.5 / MODE_ITEMS of the rows; it names every
    value that holds more than twice that share. The second counts only those that may win. If the best of them holds more than any
    value that the summary may have lost, it is the mode, and no other value was shuffled. If none is as frequent, all values are counted.
    """
    if dict(df.dtypes)[column] in COUNTED_TYPES:
        c = P.present(df, column)
        if dict(df.dtypes)[column] in ("double", "float"):
            c = c + F.lit(0.0).cast(dict(df.dtypes)[column])  # zero has one sign
        values = df.select(c.alias("mode")).filter(F.col("mode").isNotNull())
        most = int(MODE_ITEMS / 3.5) + 1  # as many can hold the share of the error, so the list is never cut above it
        items, n = values.agg(F.expr(f"approx_top_k(mode, {most}, {MODE_ITEMS})"), F.count(F.lit(1))).first()
        error = 3.5 / MODE_ITEMS * n
        if items and items[0]["count"] > 2 * error:
            near = [i["item"] for i in items if i["count"] >= items[0]["count"] - error]
            counts = values.filter(F.col("mode").isin(near)).groupBy("mode").count()
            best = counts.orderBy(F.desc("count"), F.asc("mode")).first()
            if best["count"] > 2 * error:
                return best["mode"]
    row = most_frequent(df, column).first()
    return row[0] if row else None


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    return fill_missing(df, column, "mode")[0]


def fill_drop(df: DataFrame, column: str) -> DataFrame:
    return drop_missing(df, column)


def fill_center(df: DataFrame, column: str, strategy: str) -> float | str | None:
    """The value to fill with, NULL where the column offers none."""
    if strategy == "mean":
        return df.agg(X.round2(F.avg(X.to_numeric(P.present(df, column))))).first()[0]
    if strategy == "median":
        center = exact_median(df, X.to_numeric(P.present(df, column)))
        return center if center is None else round(center * 100.0) / 100.0 + 0.0  # ties to even, like X.round2
    return exact_mode(df, column)


def _fill_error(column: str, strategy: str) -> ActionResult:
    # The wording of the errors.
    if strategy == "mode":
        return ActionResult(False, f"No mode found for column {column!r} (all values missing?).")
    return ActionResult(False, f"Cannot compute {strategy} for non-numeric column {column!r}.")


def _fill_names(df: DataFrame, column: str | None, strategy: str | None) -> ActionResult:
    if column not in df.columns:
        return ActionResult(False, N.column_error(column, P.data_columns(df)))
    if strategy not in FILL_STRATEGIES:
        return ActionResult(False, f"Unknown fill_strategy: {strategy!r}")
    return ActionResult(True)


def check_fill(df: DataFrame, column: str | None, strategy: str | None) -> ActionResult:
    """Whether a fill can be done; stops at the first usable cell."""
    named = _fill_names(df, column, strategy)
    if not named.success or strategy == "drop":
        return named
    c = P.present(df, column)
    usable = c if strategy == "mode" else X.to_numeric(c)
    return _fill_error(column, strategy) if df.filter(usable.isNotNull()).isEmpty() else named


def fill_missing(df: DataFrame, column: str, strategy: str) -> tuple[DataFrame, ActionResult]:
    """Fill by strategy; an error leaves the table as it was.

    The center is computed here, once: later jobs on the result carry it as a literal and do not scan for it again.
    """
    named = _fill_names(df, column, strategy)
    if not named.success:
        return df, named
    if strategy == "drop":
        return fill_drop(df, column), named
    center = fill_center(df, column, strategy)
    if center is None:
        return df, _fill_error(column, strategy)
    c = P.present(df, column)
    cell = c if strategy == "mode" else X.to_numeric(c)
    return df.withColumn(column, F.coalesce(cell, F.lit(center))), named


# -- categories and outliers ---------------------------------------------------------------------------------------

def deletions(text: Column, most: int) -> Column:
    """All texts that are left when up to `most` characters of a text are deleted, the text itself included."""
    def shorter(s: Column) -> Column:
        n = F.length(s)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, n)))

    found = F.array(text)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
    return found


def nearest_category(values: DataFrame, domain: DataFrame, max_dist: int = 2) -> DataFrame:
    """(text, value): for distinct texts the closest domain value within `max_dist` edits, the first by name on a tie; no row without one.

    Texts within k edits share what is left after at most k deletions on either side. Both sides are expanded by their deletions
    and meet in an equi-join of hashes; the bounded edit distance is taken of these candidates only. Texts whose length alone puts
    them out of reach of the whole domain are not expanded. Meant for names and codes: a text of n characters has about n * n / 2 entries.
    """
    bounds = domain.agg(F.struct(F.min(F.length("value")).alias("low"), F.max(F.length("value")).alias("high"))).scalar()
    near = values.filter(F.length("text").between(bounds["low"] - max_dist, bounds["high"] + max_dist))

    def index(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(F.transform(deletions(F.col(name), max_dist), lambda s: F.xxhash64(s))).alias("_key"))

    met = index(near, "text").join(index(domain, "value"), "_key")
    ranked = met.select("text", F.struct(F.levenshtein("text", "value", max_dist).alias("d"), "value").alias("s")).filter(F.col("s.d") >= 0)
    return ranked.groupBy("text").agg(F.min("s").alias("s")).select("text", F.col("s.value").alias("value"))


def fix_categories(df: DataFrame, column: str, domain: Sequence[str] | DataFrame, max_dist: int = 2) -> DataFrame:
    """Replace misspelt values by the closest one of a domain, a list or a table of one column, of any size; values too far from it stay.

    Only distinct values outside of the domain are compared; rows take their repair from an equi-join on the value, which Spark may
    broadcast or split.
    """
    c = F.col(column)
    if isinstance(domain, DataFrame):
        known = domain.toDF("value").filter("value is not null").distinct()
    else:
        known = df.sparkSession.createDataFrame([(v,) for v in sorted(set(domain))], "value string")
    texts = df.select(X.strip(c).alias("text")).filter("text is not null").distinct()
    open_texts = texts.join(known, F.col("text") == F.col("value"), "left_anti")
    repairs = nearest_category(open_texts, known, max_dist).unionByName(known.select(F.col("value").alias("text"), "value"))
    joined = df.withColumn("_text", X.strip(c)).join(repairs.toDF("_text", "_value"), "_text", "left")
    return joined.select(*[F.coalesce("_value", c).alias(n) if n == column else F.col(f"`{n}`") for n in df.columns])


def typo_lookup(df: DataFrame, column: str, typo_map: Mapping[str, Sequence[str]]) -> DataFrame:
    """Restore known misspellings (right value -> wrong ones); the map is a fixed list and rides along as a literal."""
    right = {wrong: value for value, wrongs in typo_map.items() for wrong in wrongs}
    return df.withColumn(column, X.lookup(right, X.strip(F.col(column)), F.col(column)))


def handle_outliers(df: DataFrame, column: str, low: float, high: float, mode: str = "drop") -> DataFrame:
    """Amounts outside [low, high] are errors: drop their rows or move them to the bound."""
    x = X.safe_float(P.present(df, column))
    if mode == "drop":
        return df.filter(F.coalesce(x.between(low, high), F.lit(True)))
    if mode == "cap":
        return df.withColumn(column, X.clip(x, float(low), float(high)))
    raise ValueError(f"Unknown mode: {mode!r}")


def zscore_outliers(df: DataFrame, column: str, limit: float = 4.0) -> DataFrame:
    """Adds `z` and `is_outlier`; mean and deviation come from one scalar subquery."""
    x = X.to_numeric(P.present(df, column))
    moments = df.agg(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))).scalar()
    z = (x - moments["m"]) / F.nullif(moments["s"], F.lit(0.0))
    return df.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs(F.col("z")) > limit, F.lit(False)))
