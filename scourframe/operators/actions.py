"""Logs of cleaning actions: read raw responses, validate, resolve positions, apply to a table.

Action log: episode_id, step, command, row_index, column, value, fill_strategy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scourframe.functions import names as N
from scourframe.functions import scalars as X
from scourframe.operators import clean as C
from scourframe.operators import ordering as O
from scourframe.operators import profile as P
from scourframe.session import cut_lineage

# Commands, synonyms and fill strategies.
COMMANDS = ("SET_VALUE", "DROP_ROW", "STANDARDIZE_COL", "FILL_MISSING", "DONE")
COMMAND_SYNONYMS = {
    "FILL_MISSING": "FILL_MISSING", "STANDARDIZE_COL": "STANDARDIZE_COL", "STANDARDIZE": "STANDARDIZE_COL",
    "SET_VALUE": "SET_VALUE", "DROP_ROW": "DROP_ROW", "DROP": "DROP_ROW",
}
FILL_STRATEGIES = C.FILL_STRATEGIES
DEFAULT_STRATEGY = "median"

LOG_SCHEMA = (
    "episode_id string, step int, command string, row_index bigint, `column` string, value string, fill_strategy string"
)


# -- validation -----------------------------------------------------------------------------------------------------

def action_error(
    command: Column, row_index: Column, column: Column, value: Column, fill_strategy: Column
) -> Column:
    """NULL for a valid action, else what is wrong with it."""
    def absent(*fields: tuple[str, Column]) -> Column:
        names = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in fields]))
        return F.when(F.size(names) > 0, F.concat(command, F.lit(" requires: "), F.array_join(names, ", ")))

    row, col = ("row_index", row_index), ("column", column)
    required = (
        F.when(command == "SET_VALUE", absent(row, col, ("value", value)))
        .when((command == "DROP_ROW") & row_index.isNull(), F.lit("DROP_ROW requires row_index"))
        .when((command == "STANDARDIZE_COL") & column.isNull(), F.lit("STANDARDIZE_COL requires column"))
        .when(command == "FILL_MISSING", absent(col, ("fill_strategy", fill_strategy)))
    )
    known = command.isNotNull() & command.isin(*COMMANDS)
    return (
        F.when(~known, F.lit("command must be one of: " + ", ".join(COMMANDS)))
        .when(row_index < 0, F.concat(F.lit("row_index must be >= 0, got "), X.as_text(row_index)))
        .when(column == "", F.lit("column must not be empty"))
        .when(~fill_strategy.isin(*FILL_STRATEGIES), F.lit("fill_strategy must be one of: " + ", ".join(FILL_STRATEGIES)))
        .otherwise(required)
    )


def validate_actions(log: DataFrame) -> DataFrame:
    """Adds valid and error."""
    error = action_error(*[F.col(c) for c in ("command", "row_index", "column", "value", "fill_strategy")])
    return log.withColumn("error", error).withColumn("valid", F.col("error").isNull())


# -- raw responses --------------------------------------------------------------------------------------------------

_FENCE = "```"
_FIELD_NAMES = ("action", "column", "strategy", "fill_strategy", "row", "row_index", "value")
_FIELDS = ", ".join(f"`{n}` string" for n in _FIELD_NAMES)


def unfence(text: Column) -> Column:
    """Content of a code fence: the first line goes, and the last one if it closes the fence."""
    lines = F.split(text, "\n")
    closed = F.element_at(lines, -1)
    n = F.size(lines)
    keep = F.when(X.strip(closed).startswith(_FENCE), n - 2).otherwise(n - 1)
    inner = F.array_join(F.slice(lines, 2, F.greatest(keep, F.lit(0))), "\n")
    return F.when(text.startswith(_FENCE), X.strip(inner)).otherwise(text)


def json_object(text: Column) -> Column:
    """The first {...} without nesting, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"\{[^{}]*\}", 0), F.lit(""))


def match_column(name: Column, columns: Sequence[str]) -> Column:
    """The exact name, else the one that differs by case only, else NULL. Without a list of columns, the name itself."""
    if not columns:
        return name
    by_lower = {c.lower(): c for c in columns}
    return F.when(name.isin(*columns), name).otherwise(X.lookup(by_lower, F.lower(name)))


def parse_responses(raw: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Adds the five action columns to a table of raw responses; anything unusable becomes DONE.

    Each stage is a projection of its own, so a text is searched and parsed once however often its fields are used.
    """
    found = raw.withColumn("_text", X.strip(F.col(text))).withColumn("_object", json_object(unfence(F.col("_text"))))
    opened = found.withColumn("_json", F.try_parse_json("_object"))
    kinds = [F.schema_of_variant(F.try_variant_get("_json", f"$.{n}", "variant")).alias(n) for n in _FIELD_NAMES]
    typed = opened.withColumns({
        "_kind": F.struct(*kinds), "_data": F.from_json(F.when(F.col("_json").isNotNull(), F.col("_object")), _FIELDS),
    })
    kind, data = F.col("_kind"), F.col("_data")
    given = typed.withColumns({f"_{n}": F.when(kind[n] != "VOID", data[n]) for n in _FIELD_NAMES})

    spoken = F.upper(X.strip(F.coalesce(F.col("_action"), F.lit("DONE"))))
    command = X.lookup(COMMAND_SYNONYMS, F.replace(spoken, F.lit(" "), F.lit("_")), F.lit("DONE"))
    strategy = F.coalesce(F.nullif(F.col("_strategy"), F.lit("")), F.col("_fill_strategy"))
    row = F.coalesce("_row", "_row_index")
    row_kind = F.when(F.col("_row").isNotNull(), kind["row"]).otherwise(kind["row_index"])
    read = given.withColumns({
        "_command": command, "_column": match_column(F.col("_column"), columns), "_strategy": strategy, "_row": row,
        "_row_kind": row_kind,
    })

    unknown = (F.col("_strategy") != "") & ~F.lower("_strategy").isin(*FILL_STRATEGIES)
    whole = F.coalesce(X.try_int(F.col("_row")), X.to_numeric(F.col("_row")).try_cast("bigint"))  # the number 7.9 -> 7
    row_index = (
        F.when(F.col("_row_kind") == "STRING", X.try_int(F.col("_row")))
        .when(F.col("_row_kind") == "BOOLEAN", (F.col("_row") == "true").cast("bigint"))
        .otherwise(whole)
    )
    shown = F.col("_value")
    fraction = kind["value"].rlike("^(DECIMAL|DOUBLE|FLOAT)") | (~kind["value"].isin("STRING", "BOOLEAN") & shown.rlike("^-?[0-9.]*[.eE][-+0-9]*$"))
    value = (
        F.when(kind["value"] == "BOOLEAN", F.initcap(shown))
        .when(fraction, F.coalesce(X.as_text(shown.try_cast("double")), shown))  # the number 29.50 -> 29.5
        .otherwise(shown)
    )
    actions = read.withColumns({
        "_strategy": F.when(unknown, F.lit(DEFAULT_STRATEGY)).otherwise(F.col("_strategy")),
        "_row_index": row_index, "_value": value,
    })
    parts = ("_command", "_row_index", "_column", "_value", "_strategy")
    usable = (F.col("_command") != "DONE") & action_error(*[F.col(c) for c in parts]).isNull()
    judged = actions.withColumn("_usable", usable)
    return judged.select(
        *raw.columns,
        F.when(F.col("_usable"), F.col("_command")).otherwise(F.lit("DONE")).alias("command"),
        *[
            F.when(F.col("_usable"), F.col(c)).alias(n)
            for c, n in zip(parts[1:], ("row_index", "column", "value", "fill_strategy"))
        ],
    )


# -- positions ------------------------------------------------------------------------------------------------------

def resolve_positions(log: DataFrame, n_rows: Column, budget: int | Column | None = None) -> DataFrame:
    """Adds `position` (place before any drop of the episode, NULL when out of range) and `in_range` to SET_VALUE and
    DROP_ROW actions; (episode_id, step) is unique and n_rows is a column of the log or a scalar.

    Every action is resolved as after all steps before it, see `ordering.positions_before_drops`; an episode may be of any length.
    Where a task has a step budget it is given as `budget`; actions beyond it are not executed and come back with `executed` = false.
    """
    positional = F.coalesce(F.col("command").isin("SET_VALUE", "DROP_ROW") & (F.col("row_index") >= 0), F.lit(False))
    executed = F.lit(True) if budget is None else F.coalesce(F.col("step") <= budget, F.lit(False))
    rows = cut_lineage(log.withColumns({"_n": n_rows.cast("bigint"), "executed": executed, "_asks": positional & executed}))  # read several times
    inside = F.col("_asks") & F.coalesce(F.col("row_index") < F.col("_n"), F.lit(False))
    ops = rows.filter(inside).withColumn("_drop", F.col("command") == "DROP_ROW")
    placed = O.positions_before_drops(ops, ["episode_id"], "step", "row_index", "_drop", "position").drop("_drop")
    placed = placed.withColumn("position", F.when(F.col("position") < F.col("_n"), F.col("position")))
    other = rows.filter(~inside).withColumn("position", F.lit(None).cast("bigint"))
    every = placed.unionByName(other).withColumn("in_range", F.when(F.col("_asks"), F.col("position").isNotNull()))
    return every.select(*log.columns, "executed", "position", "in_range")


def row_in_range(log: DataFrame, df: DataFrame) -> DataFrame:
    """Adds in_range: 0 <= row_index < number of rows."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return log.withColumn("in_range", (F.col("row_index") >= 0) & (F.col("row_index") < n))


# -- application ----------------------------------------------------------------------------------------------------

@dataclass
class Outcome:
    """Table after a log, and one row per action: step, command, success, error, dropped_protected."""

    table: DataFrame
    report: DataFrame


_COLUMN_COMMANDS = ("STANDARDIZE_COL", "FILL_MISSING")


def apply_actions(
    df: DataFrame,
    log: DataFrame,
    row_id: str = "row_id",
    protected: DataFrame | None = None,
    protected_key: str | None = None,
    budget: int | None = None,
    episode_id: str | None = None,
) -> Outcome:
    """Apply all actions of one episode in step order; step 0 is the reset.

    Only the column commands come to the driver, for each of them works on the whole table. They cut the log into segments of SET_VALUE and
    DROP_ROW; a segment is resolved, checked, applied and reported by joins, however many actions it holds, and the table is written
    after it. Errors never stop the run. Actions beyond a `budget` are reported as failed and change nothing. A log of several
    episodes is refused unless `episode_id` names one, as is one that repeats a step.
    """
    spark = df.sparkSession
    columns = P.data_columns(df, row_id)
    own = log if episode_id is None else log.filter(F.col("episode_id") == episode_id)
    steps = validate_actions(own).filter(F.col("step") >= 1).select("episode_id", "step", "command", "row_index", "column", "value", "fill_strategy", "valid", "error")
    spent = F.lit(False) if budget is None else F.col("step") > budget
    runs = F.col("valid") & ~spent & F.col("command").isin(*_COLUMN_COMMANDS)
    numbered = O.GroupWindow(steps.withColumn("_all", F.lit(0)), ["_all"], "step").running_sum("segment", runs).result(keep_part=True)
    steps = numbered.drop("_all", O.PART)
    each = F.col("episode_id")
    n, distinct, named, low, high = steps.agg(F.count("step"), F.countDistinct("step"), F.count(each), F.min(each), F.max(each)).first()
    if low != high or named not in (0, n):
        raise ValueError("the log holds several episodes: name one with episode_id")
    if n != distinct:
        raise ValueError("the log repeats a step")
    commands = steps.filter(runs).orderBy("step").collect()

    missing = (F.col("command") == "SET_VALUE") & ~F.col("column").isin(*columns)
    edits = steps.filter(F.col("valid") & ~spent & F.col("command").isin("SET_VALUE", "DROP_ROW") & ~missing).withColumn("_drop", F.col("command") == "DROP_ROW")
    edits = O.positions_before_drops(edits, ["segment"], "step", "row_index", "_drop", "position")
    edits = cut_lineage(edits.select("segment", "step", "command", "row_index", "column", "value", "_drop", "position"))
    present = edits.groupBy("segment").agg(F.collect_set("column").alias("columns"), F.count_if("_drop").alias("drops")).collect()  # a row a segment
    hit = {r["segment"]: (sorted(r["columns"]), r["drops"]) for r in present}

    outcomes, results = [], []
    for segment in range(len(commands) + 1):
        if segment:
            a = commands[segment - 1]
            df, result = _apply_column(df, a, row_id)
            results.append((a["step"], result.success, result.error))
        if segment in hit:
            df, outcome = _apply_segment(df, edits.filter(F.col("segment") == segment), row_id, *hit[segment], protected, protected_key)
            outcomes.append(outcome)
    return Outcome(df, _report(spark, steps, outcomes, results, columns, missing, spent, budget))


def _apply_column(df: DataFrame, a: Row, row_id: str) -> tuple[DataFrame, C.ActionResult]:
    name = a["column"]
    if name not in P.data_columns(df, row_id):
        return df, C.ActionResult(False, N.column_error(name, P.data_columns(df, row_id)))
    if a["command"] == "STANDARDIZE_COL":
        return C.standardize_col(df, name, row_id), C.ActionResult(True)
    return C.fill_missing(df, name, a["fill_strategy"])


def _apply_segment(
    df: DataFrame, edits: DataFrame, row_id: str, hit: list[str], drops: int, protected: DataFrame | None, protected_key: str | None
) -> tuple[DataFrame, DataFrame]:
    """The table after a segment, and its actions with `_rows` (rows before the segment), `away` (no such row), `ok` and `flagged`."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ops = edits.withColumn("_rows", n)
    found = O.rows_at_positions(df, ops.filter(F.col("position") < F.col("_rows")).select("position"), row_id)
    stats = F.broadcast(C.cast_statistics(df, hit)) if hit else None  # a row per column
    placed = ops.join(found, "position", "left")
    if stats is not None:
        placed = placed.join(stats, "column", "left").withColumn("_cast", C.cast_like_column(F.col("value"), F.col("majority_numeric"), F.col("all_whole")))
        fits = F.col("_drop") | F.col("_cast.ok")
        placed = placed.select(*ops.columns, row_id, fits.alias("fits"), F.when(~F.col("_drop"), F.col("_cast.value")).alias("cast_value"))
    else:
        placed = placed.withColumns({"fits": F.lit(True), "cast_value": F.lit(None).cast("string")})
    flagged = F.lit(False)
    if drops and protected is not None and protected_key in df.columns:
        marked = C.flag_protected(df.select(row_id, protected_key), protected, protected_key).filter("dropped_protected").select(row_id, F.lit(True).alias("_mark"))
        placed = placed.join(marked, row_id, "left")
        flagged = F.col("_drop") & F.col("_mark").isNotNull()
    away = F.col(row_id).isNull()
    placed = placed.withColumns({"away": away, "ok": ~away & F.col("fits"), "flagged": flagged})
    placed = cut_lineage(placed.select(*ops.columns, row_id, "cast_value", "away", "ok", "flagged"))
    table = df
    if hit:
        good = placed.filter(F.col("ok") & ~F.col("_drop")).select(row_id, "column", F.col("cast_value").alias("value"), "step")
        table = C.write_cells(table, good, row_id, "step", hit)
    if drops:
        table = C.drop_rows(table, placed.filter(F.col("ok") & F.col("_drop")), row_id)
    return cut_lineage(table), placed.drop(row_id, "cast_value")


def _report(
    spark, steps: DataFrame, outcomes: list[DataFrame], results: list[tuple], columns: list[str], missing: Column, spent: Column, budget: int | None
) -> DataFrame:
    """One row per action. How many rows were left before an action is a running count of the drops of its segment that succeeded."""
    kinds = "step int, success boolean, error string"
    commands = spark.createDataFrame(results, kinds).select("step", F.col("success").alias("_done"), F.col("error").alias("_why"))
    rows = steps.join(F.broadcast(commands), "step", "left")  # a row a column command
    if outcomes:
        every = outcomes[0]
        for more in outcomes[1:]:
            every = every.unionByName(more)
        gone = F.col("_drop") & F.col("ok")
        live = O.GroupWindow(every, ["segment"], "step").running_sum("_gone", gone).result()
        live = live.select("step", (F.col("_rows") - F.col("_gone")).alias("_live"), "away", "ok", "flagged")
        rows = rows.join(live, "step", "left")
    else:
        rows = rows.withColumns({"_live": F.lit(0), "away": F.lit(False), "ok": F.lit(True), "flagged": F.lit(False)})
    # The wording of the errors.
    until = F.when(F.col("command") == "SET_VALUE", F.concat(F.lit(" (0–"), X.as_text(F.col("_live") - 1), F.lit(").")))
    error = (
        F.when(spent, F.lit(f"Step budget of {budget} is used up."))
        .when(~F.col("valid"), F.col("error"))
        .when(missing, F.concat(F.lit("Column "), _quoted(F.col("column")), F.lit(f" not found. Available: {columns}")))
        .when(F.col("away"), F.concat(
            F.lit("Row index "), X.as_text(F.col("row_index")), F.lit(" out of range. DataFrame has "), X.as_text(F.col("_live")), F.lit(" rows"), F.coalesce(until, F.lit("."))))
        .when(~F.col("ok"), C.cast_error(F.col("value"), F.col("column")))
        .otherwise(F.col("_why"))
    )
    return rows.select("step", "command", error.isNull().alias("success"), error.alias("error"), F.coalesce("flagged", F.lit(False)).alias("dropped_protected"))


def _quoted(name: Column) -> Column:
    """A name as Python shows it."""
    text = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    for mark, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(mark), F.lit(shown))
    double = F.contains(name, F.lit("'")) & ~F.contains(name, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
