"""A fluent list of cleaning commands: written as an action log, or applied to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scourframe.operators import actions as A


class CleaningPlan:
    def __init__(self, episode_id: str = "plan"):
        self.episode_id = episode_id
        self._rows: list[tuple] = []

    def _add(self, command, row_index=None, column=None, value=None, fill_strategy=None) -> CleaningPlan:
        self._rows.append((self.episode_id, len(self._rows) + 1, command, row_index, column, value, fill_strategy))
        return self

    def set_value(self, row_index: int, column: str, value: str) -> CleaningPlan:
        return self._add("SET_VALUE", row_index, column, str(value))

    def drop_row(self, row_index: int) -> CleaningPlan:
        return self._add("DROP_ROW", row_index)

    def standardize_col(self, column: str) -> CleaningPlan:
        return self._add("STANDARDIZE_COL", column=column)

    def fill_missing(self, column: str, fill_strategy: str) -> CleaningPlan:
        return self._add("FILL_MISSING", column=column, fill_strategy=fill_strategy)

    def done(self) -> CleaningPlan:
        return self._add("DONE")

    def to_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._rows, A.LOG_SCHEMA)

    def apply(self, df: DataFrame, **options) -> A.Outcome:
        return A.apply_actions(df, self.to_log(df.sparkSession), **options)
