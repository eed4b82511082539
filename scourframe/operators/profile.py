"""Column health: which columns are still broken, and how. One aggregate over the table covers every column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import names as N
from scourframe.functions import scalars as X

NUMERIC_SHARE = 0.7
COERCION_SHARE = 0.8


def data_columns(df: DataFrame, row_id: str | None = "row_id") -> list[str]:
    return [c for c in df.columns if c != row_id]


def present(df: DataFrame, name: str) -> Column:
    """The cell, with NaN folded into NULL."""
    c = F.col(name)
    return X.nan_to_null(c) if dict(df.dtypes)[name] in ("double", "float") else c


def cell_evidence(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """How many cells of each column are present, are numbers, are dates: one aggregate over the whole table."""
    if not columns:
        return {}
    aggs = []
    for i, name in enumerate(columns):
        text = X.as_text(present(df, name))
        aggs += [
            F.count(text).alias(f"n{i}"), F.count(X.to_numeric(text)).alias(f"x{i}"), F.count(X.strict_date(text)).alias(f"d{i}"),
        ]
    row = df.agg(*aggs).first()
    return {c: {"present": row[f"n{i}"], "numbers": row[f"x{i}"], "dates": row[f"d{i}"]} for i, c in enumerate(columns)}


def _is_numeric(name: str, seen: dict | None, whole_token: bool) -> bool:
    if N.names_a_number(name, whole_token):
        return True
    return bool(seen and seen["present"] and seen["numbers"] / seen["present"] >= NUMERIC_SHARE)


def column_kinds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    row_id: str = "row_id",
    sniff_dates: bool = False,
    whole_token: bool = False,
) -> dict[str, str]:
    """'date', 'numeric' or 'string' per column, decided over all cells. Only names that decide nothing cost a job, one for all."""
    return kinds_and_evidence(df, columns, row_id, sniff_dates, whole_token)[0]


def kinds_and_evidence(
    df: DataFrame, columns: Sequence[str] | None = None, row_id: str = "row_id", sniff_dates: bool = False, whole_token: bool = False
) -> tuple[dict[str, str], dict[str, dict]]:
    """The kinds, and what was counted to decide them (with `sniff_dates` for all columns that are no dates by name)."""
    columns = list(columns) if columns is not None else data_columns(df, row_id)
    hints = N.name_hints(columns, whole_token)
    open_names = [c for c in columns if hints[c] is None or (sniff_dates and hints[c] == "numeric")]
    seen = cell_evidence(df, open_names)
    kinds = {}
    for c in columns:
        e = seen.get(c)
        if hints[c] == "date" or (sniff_dates and e and e["dates"] >= max(1, e["present"] // 2)):
            kinds[c] = "date"
        else:
            kinds[c] = "numeric" if _is_numeric(c, e, whole_token) else "string"
    return kinds, seen


def looks_like_date(df: DataFrame, column: str, row_id: str = "row_id") -> bool:
    return column_kinds(df, [column], row_id, sniff_dates=True)[column] == "date"


def looks_like_numeric(df: DataFrame, column: str, row_id: str = "row_id", whole_token: bool = False) -> bool:
    hint_free = N.names_a_number(column, whole_token)
    return hint_free or _is_numeric(column, cell_evidence(df, [column])[column], whole_token)


# -- counts: aggregate expressions --------------------------------------------------------------------------------

def missing_count(c: Column) -> Column:
    return F.count_if(c.isNull())


def bad_date_count(c: Column) -> Column:
    return F.count_if(c.isNotNull() & ~X.is_iso(c))


def future_year_count(c: Column, last_year: int = X.LAST_YEAR) -> Column:
    return F.count_if(X.year_prefix(c) > last_year)


def non_numeric_count(c: Column) -> Column:
    return F.count_if(c.isNotNull() & X.to_numeric(c).isNull())


def whitespace_count(c: Column) -> Column:
    return F.count_if(~X.is_stripped(c))


# Issue suffixes.
MISSING, BAD_DATE, FUTURE_YEAR = "missing", "bad_date_format", "future_year"
NON_NUMERIC, PADDED = "non_numeric_text", "has_whitespace"


def _checks(kind: str, c: Column) -> list[tuple[str, Column]]:
    text = X.as_text(c)
    if kind == "date":
        return [(BAD_DATE, bad_date_count(text)), (FUTURE_YEAR, future_year_count(text))]
    if kind == "numeric":
        return [(NON_NUMERIC, non_numeric_count(text))]
    return [(PADDED, whitespace_count(text))]


def issue_counts(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, dict[str, list[tuple[str, str]]]]:
    """One row with every count, and for each column the (issue, name of the count) pairs in report order."""
    aggs, layout = [], {}
    for i, (name, kind) in enumerate(kinds.items()):
        c = present(df, name)
        layout[name] = []
        for j, (issue, count) in enumerate([(MISSING, missing_count(c)), *_checks(kind, c)]):
            aggs.append(count.alias(f"c{i}_{j}"))
            layout[name].append((issue, f"c{i}_{j}"))
    return df.agg(*aggs), layout


def column_status(
    df: DataFrame, row_id: str = "row_id", kinds: dict[str, str] | None = None, whole_token: bool = False
) -> DataFrame:
    """One row per column: column, missing, standardized, issues."""
    kinds = kinds or column_kinds(df, row_id=row_id, whole_token=whole_token)
    counts, layout = issue_counts(df, kinds)
    rows = []
    for name, parts in layout.items():
        issues = X.issue_array(*[(F.col(n), issue) for issue, n in parts])
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(parts[0][1]).alias("missing"),
                (F.size(issues) == 0).alias("standardized"),
                issues.alias("issues"),
            )
        )
    return counts.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def broken_columns(status: DataFrame) -> DataFrame:
    return status.filter((F.col("missing") > 0) | ~F.col("standardized"))


def all_clean(status: DataFrame) -> DataFrame:
    """One row: all_clean, broken (count)."""
    broken = F.count_if((F.col("missing") > 0) | ~F.col("standardized"))
    return status.agg((broken == 0).alias("all_clean"), broken.alias("broken"))


def parse_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: column, present, numeric, ratio (0 for an empty column), all_whole."""
    cells, aggs = [], []
    for i, name in enumerate(columns):
        c = present(df, name)
        cells += [c.alias(f"c{i}"), X.to_numeric(c).alias(f"x{i}")]  # parsed once, in a projection of their own
        aggs += [F.count(f"c{i}").alias(f"p{i}"), F.count(f"x{i}").alias(f"k{i}"), F.bool_and(F.col(f"x{i}") % 1 == 0).alias(f"w{i}")]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"p{i}").alias("present"),
            F.col(f"k{i}").alias("numeric"),
            (F.col(f"k{i}") / F.greatest(F.col(f"p{i}"), F.lit(1))).alias("ratio"),
            F.coalesce(F.col(f"w{i}"), F.lit(True)).alias("all_whole"),
        )
        for i, name in enumerate(columns)
    ]
    return df.select(*cells).agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def column_center(df: DataFrame, column: str) -> DataFrame:
    """One row with the mean and the numeric count of a column; median and mode have their own distributed forms."""
    x = X.to_numeric(present(df, column))
    return df.agg(F.avg(x).alias("mean"), F.count(x).alias("numeric"))


def valid_fraction(df: DataFrame, column: str, valid: Column) -> DataFrame:
    c = present(df, column)
    return df.agg(
        F.count(c).alias("n_total"),
        F.count_if(c.isNotNull() & valid).alias("n_valid"),
    ).withColumn("valid_ratio", F.col("n_valid") / F.greatest(F.col("n_total"), F.lit(1)))


def filter_suspect(df: DataFrame, column: str) -> DataFrame:
    """Rows whose numeric column holds letters or nothing."""
    return df.filter(F.col(column).isNull() | X.as_text(F.col(column)).rlike("[a-zA-Z]"))
