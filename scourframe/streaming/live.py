"""Filling a stream by statistics that are rewritten while it runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scourframe.functions import scalars as X
from scourframe.operators import clean as C
from scourframe.operators import profile as P

PROFILE_SCHEMA = "`column` string, strategy string, n bigint, total double, center string, version int"
LIVE_STRATEGIES = ("mean", "median", "mode")


class LiveFill:
    """Fill missing cells of a stream with the statistics of all rows that came before, in increments.

    `advance` takes what has come to a stream since the last call, fills it with the profile in force, appends it to the rows under `path`
    and publishes the next profile. Progress of the stream and the rows are kept by its checkpoint and its file sink, so every row is
    filled once, however often an increment is cut off and repeated: rows carry the number of their increment, and the profile of an
    increment is derived from them, never from what a run remembers. An increment without a published profile is still open; what comes
    on the next call joins it, filled with the same values. There is one writer at a time.

    strategies: 'mean', 'median' or 'mode' for each column to fill. Mean and median turn a column numeric, and words count as missing. Until a
    value is known, missing cells stay NULL. The columns `missing` (which cells of a row were filled or stay NULL) and `increment` are added;
    a stream that has them already is refused. A mean is folded from one sum and count for each increment, which scans only the new
    rows; a median and a mode scan their column in all rows that have come.
    """

    def __init__(self, spark: SparkSession, path: str, strategies: Mapping[str, str]):
        unknown = set(strategies.values()) - set(LIVE_STRATEGIES)
        if unknown:
            raise ValueError(f"unknown strategies: {sorted(unknown)}")
        self.spark, self.path, self.strategies = spark, path.rstrip("/"), dict(strategies)

    def profile(self) -> DataFrame:
        """All published profiles: one row for each column and increment."""
        return self.spark.read.schema(PROFILE_SCHEMA).parquet(f"{self.path}/profile")

    def rows(self) -> DataFrame:
        """All rows filled so far."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def version(self) -> int:
        """The last increment whose profile is published, 0 before the first."""
        try:
            return self.profile().agg(F.max("version")).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def centers(self) -> dict[str, float | str]:
        """The values in force, for the columns that have one."""
        return self._centers(self.version())

    def _centers(self, last: int) -> dict[str, float | str]:
        if not last:
            return {}
        mean = X.round2(F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).cast("string")
        found = self.profile().groupBy("column", "strategy").agg(
            F.when(F.col("strategy") == "mean", mean).otherwise(F.max(F.when(F.col("version") == last, F.col("center")))).alias("center"))
        return {
            r["column"]: r["center"] if r["strategy"] == "mode" else float(r["center"])
            for r in found.collect() if r["center"] is not None and self.strategies.get(r["column"]) == r["strategy"]
        }

    def advance(self, stream: DataFrame) -> int:
        """Fill what has come, publish the profile, and return the number of the last published increment."""
        clashing = {"missing", "increment"} & set(stream.columns)
        if clashing:
            raise ValueError(f"reserved columns: {sorted(clashing)}")
        last = self.version()
        increment, centers = last + 1, self._centers(last)
        cells = {c: P.present(stream, c) if s == "mode" else X.to_numeric(P.present(stream, c)) for c, s in self.strategies.items()}
        kinds = dict(stream.dtypes)
        filled = {c: F.coalesce(x, F.lit(centers[c]).cast(kinds[c] if self.strategies[c] == "mode" else "double")) if c in centers else x for c, x in cells.items()}
        missing = F.array_compact(F.array(*[F.when(x.isNull(), F.lit(c)) for c, x in cells.items()])).cast("array<string>")
        out = stream.select(
            *[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in stream.columns], missing.alias("missing"), F.lit(increment).alias("increment"))
        (out.writeStream.format("parquet").partitionBy("increment").option("checkpointLocation", f"{self.path}/progress")
            .trigger(availableNow=True).start(f"{self.path}/rows").awaitTermination())
        return increment if self._publish(self.spark.read.schema(out.schema).parquet(f"{self.path}/rows"), increment) else last

    def _publish(self, rows: DataFrame, increment: int) -> bool:
        """The profile of an increment as one file, which is there wholly or not at all; none where no row has come."""
        own = rows.filter(F.col("increment") == increment)
        if own.isEmpty():
            return False
        known = {c: F.when(~F.array_contains("missing", c), F.col(f"`{c}`")) for c in self.strategies}
        means = [c for c, s in self.strategies.items() if s == "mean"]
        values = own.agg(F.count(F.lit(1)), *[f(known[c]) for c in means for f in (F.count, F.sum)]).first()
        profile = [(c, "mean", values[1 + 2 * i], values[2 + 2 * i] or 0.0, None, increment) for i, c in enumerate(means)]
        medians = C.exact_medians(rows, {c: known[c] for c, s in self.strategies.items() if s == "median"}) if "median" in self.strategies.values() else {}
        profile += [(c, "median", None, None, None if m is None else repr(round(m * 100.0) / 100.0 + 0.0), increment) for c, m in medians.items()]
        for c in [c for c, s in self.strategies.items() if s == "mode"]:
            mode = C.exact_mode(rows.select(known[c].alias("x")), "x")
            profile.append((c, "mode", None, None, None if mode is None else str(mode), increment))
        one = self.spark.createDataFrame(profile, PROFILE_SCHEMA).drop("version").coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.path}/profile/version={increment}")
        return True
