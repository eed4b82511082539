"""Versions of a table as deltas. A version stores the cells that changed against the one before it, and a manifest row that names them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scourframe.operators import compare
from scourframe.operators import profile as P

MANIFEST_SCHEMA = "folder string, complete boolean, `columns` string, `rows` bigint, cells bigint"


@dataclass(frozen=True)
class Version:
    """`columns`: name, type, and the version since which the column has this type. `rows`, `cells`: how many this version stores."""

    version: int
    folder: str
    complete: bool
    columns: tuple[tuple[str, str, int], ...]
    rows: int
    cells: int


class VersionedTable:
    """Versions of one table under a folder that all executors share. Row ids are unique, BIGINT and not NULL; cells can be compared.

    A commit writes its data to a folder of its own and then one manifest row. A commit that is lost before that row leaves no trace in
    later reads, and the last version stays whole; it can be repeated. There is one writer at a time. Once the deltas hold more cells
    than the last complete copy, the next commit is a complete copy again, so that all versions together stay within a few times the
    table and what changed, and a read folds deltas of at most about the size of the table.
    """

    def __init__(self, spark: SparkSession, path: str, row_id: str = "row_id"):
        self.spark, self.path, self.row_id = spark, path.rstrip("/"), row_id

    def history(self) -> list[Version]:
        """All versions, oldest first: one manifest row each."""
        return [
            Version(r["version"], r["folder"], r["complete"], tuple((n, t, s) for n, t, s in json.loads(r["columns"])), r["rows"], r["cells"])
            for r in (self.manifest().orderBy("version").collect() if self._begun() else [])
        ]

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(f"{MANIFEST_SCHEMA}, version int").json(f"{self.path}/manifest")

    def _begun(self) -> bool:
        try:
            self.manifest().schema
            return True
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def commit(self, df: DataFrame) -> Version:
        """Store a table as the next version."""
        history = self.history()
        number = history[-1].version + 1 if history else 0
        types = dict(df.dtypes)
        names = P.data_columns(df, self.row_id)
        complete = not history or self._outgrown(history)
        before = {n: (t, since) for n, t, since in history[-1].columns} if history and not complete else {}
        columns = tuple((n, types[n], before[n][1] if n in before and before[n][0] == types[n] else number) for n in names)
        if complete:
            out, cells = df.select(self.row_id, *names), F.count(F.lit(1)) * (len(names) + 1)
        else:
            out = compare.changed_cells(self.read(history[-1].version), df.select(self.row_id, *names), self.row_id)
            out, cells = out.withColumn("_version", F.lit(number)), F.sum(F.size("_set") + 1)
        folder = f"data/{uuid.uuid4().hex}"
        seen = Observation()
        out.observe(seen, F.count(F.lit(1)).alias("rows"), cells.alias("cells")).write.parquet(f"{self.path}/{folder}")
        found = seen.get
        version = Version(number, folder, complete, columns, found["rows"], found["cells"] or 0)
        row = [(folder, complete, json.dumps(columns), version.rows, version.cells)]
        manifest = self.spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.path}/manifest/version={number}")
        return version

    @staticmethod
    def _outgrown(history: list[Version]) -> bool:
        start = max(i for i, v in enumerate(history) if v.complete)
        return sum(v.cells for v in history[start + 1:]) > history[start].cells

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last one by default: the complete copy before it, joined once with the fold of the deltas since."""
        history = self.history()
        known = [v.version for v in history]
        if not history or (version is not None and version not in known):
            raise ValueError(f"No version {version!r}; there are {len(history)}.")
        history = history[: known.index(version) + 1] if version is not None else history
        start = max(i for i, v in enumerate(history) if v.complete)
        base, deltas, columns = history[start], history[start + 1:], history[-1].columns
        stored = self.spark.read.parquet(f"{self.path}/{base.folder}")
        if not deltas:
            return stored.select(self.row_id, *[n for n, *_ in columns])
        folded = self._folded(deltas, columns)
        held = {n: F.col(f"_base_{i}") for i, (n, _, since) in enumerate(columns) if since <= base.version}
        old = stored.select(self.row_id, *[F.col(n).alias(f"_base_{i}") for i, (n, *_) in enumerate(columns) if n in held])
        cells = [
            F.when(F.col(f"_c{i}").isNotNull(), F.col(f"_c{i}.v")).otherwise(held.get(n, F.lit(None).cast(t))).alias(n)
            for i, (n, t, _) in enumerate(columns)
        ]
        joined = old.join(folded, self.row_id, "full").filter(~F.coalesce(F.col("_gone"), F.lit(False)))
        return joined.select(self.row_id, *cells)

    def _folded(self, deltas: list[Version], columns: tuple[tuple[str, str, int], ...]) -> DataFrame:
        """One row per row id in the deltas: whether it is gone, and the latest value of each cell that was set, in a struct."""
        alike: dict[tuple, list[Version]] = {}
        for v in deltas:
            alike.setdefault(v.columns, []).append(v)
        parts = None
        for stored, versions in alike.items():
            same = set(stored)
            part = self.spark.read.parquet(*[f"{self.path}/{v.folder}" for v in versions]).select(
                self.row_id, "_version", "_gone",
                *[
                    (F.when(F.array_contains("_set", n), F.struct(F.col(n).alias("v"))) if (n, t, since) in same
                     else F.lit(None).cast(f"struct<v:{t}>")).alias(f"_c{i}")
                    for i, (n, t, since) in enumerate(columns)
                ],
            )
            parts = part if parts is None else parts.unionByName(part)
        cells = [
            F.max_by(f"_c{i}", F.when(F.col(f"_c{i}").isNotNull(), F.col("_version"))).alias(f"_c{i}") for i in range(len(columns))
        ]
        return parts.groupBy(self.row_id).agg(F.max_by("_gone", "_version").alias("_gone"), *cells)
