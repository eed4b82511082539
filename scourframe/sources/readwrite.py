"""Reading raw tables and writing cleaned ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scourframe.operators import inject as I
from scourframe.operators import profile as P

ROW_INDEX = "row_index"
PREVIEW_ROWS = 20


def raw_schema(columns: Sequence[str], key: str) -> str:
    return ", ".join(f"`{c}` {'BIGINT' if c == key else 'STRING'}" for c in columns)


def read_raw(
    spark: SparkSession, path: str, key: str = "row_id", fmt: str = "parquet", columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A raw table: `row_id` and text columns, NaN folded into NULL.

    CSV files have a header; `columns` names them in order (no inference pass). In CSV an empty field is missing.
    `multi_line` allows line breaks inside cells, at the price of one task per file.
    """
    if fmt == "csv":
        if columns is None:
            raise ValueError("reading CSV needs the list of columns")
        reader = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multi_line)
        reader = reader.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        return reader.schema(raw_schema(columns, key)).csv(path).withColumnRenamed(key, "row_id")
    if fmt != "parquet":
        raise ValueError(f"Unknown format: {fmt!r}")
    df = spark.read.parquet(path).withColumnRenamed(key, "row_id")
    return I.as_raw(df, "row_id")


def write_csv(df: DataFrame, path: str, row_id: str = "row_id", mode: str = "errorifexists") -> None:
    """CSV with header and row_index first. Padding in cells is kept."""
    out = df.select(F.col(row_id).alias(ROW_INDEX), *P.data_columns(df, row_id))
    writer = out.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def snapshot(df: DataFrame, path: str, step: int) -> str:
    """Parquet copy of the table at a step, under its own folder."""
    target = f"{path}/step={step:06d}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{path}/step={step:06d}")


def preview(df: DataFrame, n: int = PREVIEW_ROWS, row_id: str = "row_id") -> DataFrame:
    return head_n(df, n, row_id)


def head_n(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """The first n rows by id (a top-k, no full sort)."""
    return df.orderBy(row_id).limit(n)
