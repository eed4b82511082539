"""Cleaning of a stream. What needs no state is the same projection as in a batch; statistics for filling come from a
batch profile, since a stream has no final mean."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourframe.functions import scalars as X
from scourframe.operators import clean as C


def standardize_stream(stream: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """`kinds` ('date', 'numeric', 'string' per column) is taken from a batch with `standardize_plan`."""
    return C.standardize_cols(stream, list(kinds), kinds=dict(kinds))


def fill_stream(stream: DataFrame, centers: Mapping[str, float | str]) -> DataFrame:
    """Fill missing cells with values of a batch profile: numbers make the column numeric, text leaves it as it is."""
    out = {}
    for name, center in centers.items():
        cell = X.to_numeric(F.col(name)) if isinstance(center, (int, float)) else F.col(name)
        out[name] = F.coalesce(cell, F.lit(center))
    return stream.withColumns(out)
