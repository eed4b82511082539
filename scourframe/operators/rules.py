"""Declared rules, checked together in one aggregate. Only uniqueness needs a shuffle of its own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import scalars as X
from scourframe.operators import merge as M


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    violated: Column | None  # None marks uniqueness


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rule_not_null(column: str) -> Rule:
    return Rule("not_null", column, F.col(column).isNull())


def rule_in_domain(column: str, values: Sequence[str]) -> Rule:
    return Rule("in_domain", column, _flag(~F.col(column).isin(*values)))


def rule_range(column: str, low: float | None = None, high: float | None = None) -> Rule:
    """A number inside the bounds; text that is no number violates the rule."""
    x = X.to_numeric(F.col(column))
    bad = x.isNull()
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return Rule("range", column, _flag(F.col(column).isNotNull() & bad))


def rule_date(column: str, years: Sequence[int] | None = None) -> Rule:
    text = X.as_text(F.col(column))
    good = X.is_iso(text) & F.try_to_date(X.strip(text), "yyyy-MM-dd").isNotNull()
    if years is not None:
        good = good & X.year_prefix(text).isin(*years)
    return Rule("date", column, F.col(column).isNotNull() & ~_flag(good))


def rule_trimmed(column: str) -> Rule:
    return Rule("trimmed", column, _flag(~X.is_stripped(F.col(column))))


def rule_scale(column: str, places: int = 2) -> Rule:
    x = X.to_numeric(F.col(column)).try_cast("decimal(38,10)")
    return Rule("scale", column, _flag(x != F.round(x, places)))


def rule_unique(column: str) -> Rule:
    return Rule("unique", column, None)


def validate_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rule, column, violations (for uniqueness, rows beyond the first of their value)."""
    parts = []
    local = [r for r in rules if r.violated is not None]
    if local:
        counts = df.agg(*[F.count_if(r.violated).alias(f"v{i}") for i, r in enumerate(local)])
        rows = [
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"v{i}").alias("violations"))
            for i, r in enumerate(local)
        ]
        parts.append(counts.select(F.explode(F.array(*rows)).alias("s")).select("s.*"))
    for r in rules:
        if r.violated is None:
            groups = df.filter(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("n"))
            excess = F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint"))
            parts.append(
                groups.agg(excess.alias("violations")).select(
                    F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), "violations"
                )
            )
    return reduce(DataFrame.unionByName, parts)


def violating_rows(df: DataFrame, rule: Rule, row_id: str = "row_id") -> DataFrame:
    """Rows that break a rule; for uniqueness those beyond the first, by row id, of their value. Counts fold before the
    shuffle, and only repeated values are joined back."""
    if rule.violated is None:
        known = df.filter(F.col(rule.column).isNotNull())
        later = M.duplicate_pairs(known, [rule.column], row_id).select(F.col("duplicate_id").alias(row_id))
        return df.join(later, row_id, "left_semi").select(*df.columns)
    return df.filter(rule.violated)
