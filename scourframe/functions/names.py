"""Decisions taken from column names alone, before any job runs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

# Parts of a name that mark a numeric column.
NUMERIC_KEYWORDS = ("price", "amount", "value", "quantity", "qty", "count", "id", "num")
DATE_KEYWORD = "date"


def names_a_date(name: str) -> bool:
    return DATE_KEYWORD in name.lower()


def names_a_number(name: str, whole_token: bool = False) -> bool:
    """`whole_token` keeps 'country' from matching 'count'."""
    low = name.lower()
    if whole_token:
        return any(token in NUMERIC_KEYWORDS for token in low.replace("-", "_").split("_"))
    return any(word in low for word in NUMERIC_KEYWORDS)


def name_hints(names: Iterable[str], whole_token: bool = False) -> dict[str, str | None]:
    """'date', 'numeric' or None for every column name."""
    return {
        n: "date" if names_a_date(n) else "numeric" if names_a_number(n, whole_token) else None for n in names
    }


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(column_error(name, df.columns))


def column_error(name: str | None, available: Sequence[str]) -> str:
    return f"Column {name!r} not found. Available: {list(available)}"


def leftover_columns(names: Sequence[str], canonical: Sequence[str]) -> list[str]:
    return [n for n in names if n not in canonical]


def invert_alias(aliases: Mapping[str, str]) -> dict[str, str]:
    """alias -> canonical."""
    return {alias: canonical for canonical, alias in aliases.items()}


def global_lookup(sources: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    return {alias: name for aliases in sources.values() for alias, name in invert_alias(aliases).items()}
