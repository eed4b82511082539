"""Inputs of the registered queries, all derived from the given tables by expressions that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scourframe.functions import hashing as H
from scourframe.functions import scalars as X
from scourframe.operators import generate as G
from scourframe.operators import inject as I
from scourframe.operators import merge as M
from scourframe.operators import ordering as O

SEED = 7
COPY_SEED = 900
COPY_RATE = 0.05
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_TYPOS = {
    "AUTOMOBILE": ("AUTOMOBLE", "AUTMOBILE", "AUTOMOBIEL"),
    "BUILDING": ("BUILDNG", "BULDING", "BUIDLING"),
    "FURNITURE": ("FURNITUR", "FURNTURE", "FURNITRUE"),
    "HOUSEHOLD": ("HOUSEHLD", "HOUSHOLD", "HOUSEHODL"),
    "MACHINERY": ("MACHINRY", "MACHNERY", "MACHINEYR"),
}
ORDER_ERRORS = (
    I.RateError(I.WORD, "custkey", 0.02),
    I.RateError(I.NULL, "custkey", 0.02),
    I.RateError(I.WHITESPACE, "orderstatus", 0.03),
    I.RateError(I.NULL, "orderstatus", 0.02),
    I.RateError(I.WORD, "price", 0.04),
    I.RateError(I.NULL, "price", 0.03),
    I.RateError(I.FUTURE_DATE, "order_date", 0.03),
    I.RateError(I.WHITESPACE, "priority", 0.05),
)
ACCOUNT_ERRORS = (
    I.RateError(I.OUTLIER, "amount", 0.08),
    I.RateError(I.TYPO, "segment", 0.06),
)
EXTREME_RATE, EXTREME_SALT = 0.03, 77
COMMAND_OF_EVENT = {
    "signup": "SET_VALUE", "click": "STANDARDIZE_COL", "view": "FILL_MISSING", "error": "DROP_ROW", "purchase": "DONE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    """Text with two decimals."""
    return c.cast("decimal(18,2)").cast("string")


def orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("custkey"),
        F.col("o_orderstatus").alias("orderstatus"),
        money(F.col("o_totalprice")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
    )


def orders_dirty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return I.inject_errors(orders_raw(spark, sf_dir), ORDER_ERRORS, SEED)


def orders_with_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with a numeric amount and about 5 % copies, of which some have a slightly changed amount."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("orderstatus"),
        X.round2(F.col("o_totalprice")).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
    )
    return I.inject_copies(o, COPY_RATE, COPY_SEED, ["amount"])


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as transactions with ordinary amounts in [5, 800], a few of them large but legitimate."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    usual = X.round2(X.clip(F.abs(F.col("c_acctbal")) / 13.0, 5.0, 800.0))
    large = H.hash_uniform(k, EXTREME_SALT + 1, *I.VALID_EXTREME)
    return c.select(
        k.alias("row_id"), (k + 9001).alias("tx_id"),
        F.when(is_extreme(k), large).otherwise(usual).alias("amount"), F.col("c_mktsegment").alias("segment"),
    )


def is_extreme(k: Column) -> Column:
    """Planted in rows that get no outlier: the two slices of one hash do not touch."""
    salt = SEED + 10  # the salt under which outliers are put into `amount`, the second data column
    return H.selected(k, salt, EXTREME_RATE, 0.5)


def accounts_dirty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return I.inject_errors(I.as_raw(accounts(spark, sf_dir)), ACCOUNT_ERRORS, SEED, typo_map=SEGMENT_TYPOS)


def customers_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pad = F.when(k % 5 == 0, F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  "))).otherwise(F.col("c_name"))
    return c.select(
        k.alias("row_id"), pad.alias("label"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
    )


def source_blocks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders split over three sources that name their columns and write their dates in their own way."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = G.random_name(F.col("o_custkey"), 31)
    blocks = {}
    for i, source in enumerate(G.SOURCE_ALIASES):
        values = {
            "record_id": k, "customer_id": F.col("o_custkey"), "full_name": name, "email": G.name_to_email(name),
            "amount": F.col("o_totalprice"), "currency": H.hash_choice(k, 33, G.MERGE_CURRENCIES),
            "purchase_date": F.date_format("o_orderdate", G.SOURCE_DATE_FORMATS[source]),
            "product_name": F.col("o_orderpriority"), "region": F.col("o_orderstatus"),
        }
        alias = G.SOURCE_ALIASES[source]
        blocks[source] = o.filter(k % 3 == i).select(*[v.alias(alias[c]) for c, v in values.items()])
    return blocks


def merged_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources as one table of 27 raw columns, prefixed by their source."""
    raw = []
    for source, block in source_blocks(spark, sf_dir).items():
        key = G.SOURCE_ALIASES[source]["record_id"]
        cells = [
            (money(F.col(c)) if c == G.SOURCE_ALIASES[source]["amount"] else F.col(c).cast("string")).alias(f"{source}:{c}")
            for c in block.columns
        ]
        raw.append(block.select(F.col(key).alias("row_id"), *cells))
    return M.union_ragged(raw)


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a step log: a user is an episode, its first event the reset, later ones the steps."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    numbered = O.GroupWindow(e, ["user_id"], "event_id").row_number("rn").result(keep_part=True)
    step = (F.col("rn") - 1).cast("int")
    command = F.when(step > 0, X.lookup(COMMAND_OF_EVENT, F.col("event_type")))
    task = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("user_id") % 3 + 1).cast("int"))
    score = X.round4(F.least(F.lit(1.0), F.lit(0.012) * step + F.col("value") / 2000.0))
    return numbered.select(
        F.col("user_id").cast("string").alias("episode_id"), task.alias("task_id"), step.alias("step"),
        command.alias("command"), score.alias("score"),
        ((command == "DROP_ROW") & (task == "medium") & H.selected(F.col("event_id"), 51, 0.2)).alias("dropped_protected"),
        (F.col("user_id") % 40 + 10).alias("initial_dirty"), "event_id", O.PART,  # the partitions serve for episodes and steps as well
    )


def action_log(spark: SparkSession, sf_dir: str, rows_of: str | None = None) -> DataFrame:
    """Events as an action log; some fields are absent or wrong. Row indexes reach a little beyond the rows of a table, if one is named."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    numbered = O.GroupWindow(e, ["user_id"], "event_id").row_number("rn").result()
    k = F.col("event_id")
    row = H.hash_int(k, 62, -2, 70)
    if rows_of:
        n = table(spark, sf_dir, rows_of).agg(F.count(F.lit(1))).scalar()
        row = F.when(row < 0, row).otherwise((row * n / F.lit(66.0)).cast("bigint"))
    return numbered.select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("rn").cast("int").alias("step"),
        F.when(H.selected(k, 60, 0.02), F.lit("SKIP")).otherwise(X.lookup(COMMAND_OF_EVENT, F.col("event_type"))).alias("command"),
        F.when(~H.selected(k, 61, 0.1), row).alias("row_index"),
        F.when(~H.selected(k, 63, 0.1), H.hash_choice(k, 64, ("price", "quantity", "order_date", ""))).alias("column"),
        F.when(~H.selected(k, 65, 0.1), money(F.col("value"))).alias("value"),
        F.when(~H.selected(k, 66, 0.1), H.hash_choice(k, 67, ("mean", "median", "mode", "drop", "Mean"))).alias("fill_strategy"),
    )


RESPONSE_COLUMNS = ("order_id", "price", "quantity", "order_date")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text responses in the forms an agent writes them, made from the events."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").alias("k"))
    value, k = money(F.col("value")), F.coalesce(F.col("k"), F.lit("0"))

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    forms = [
        text('{"action":"SET_VALUE","row":', k, ',"column":"price","value":"', value, '"}'),
        text('```json\n{"action": "SET_VALUE", "row": "', k, '", "column": "quantity", "value": "', value, '"}\n```'),
        text('Sure: {"action":"drop row","row_index":"', k, '"} as asked'),
        text('{"action":"standardize","column":"ORDER_DATE"}'),
        text('{"action":"FILL_MISSING","column":"quantity","strategy":"average"}'),
        text('{"action":"FILL_MISSING","column":"nope","strategy":"mean"}'),
        text('{"action": "DROP", row: ', k, "}"),
        text("nothing to do here"),
        text('{"action":"FILL_MISSING","column":"quantity","fill_strategy":"Mean"}'),
        text('{"action":"DROP","row":-', k, "1}"),
        text('  {"action":"set value","row":', k, ',"column":"Price","value":29.50}  '),
        text('{"action":"DONE"}'),
        text('{"action":"SET_VALUE","args":{"row":', k, "}}"),
        text('{"action":"SET_VALUE","row":', k, '.9,"column":"price","value":true}'),
        text('```\n{"action":"FILL_MISSING","column":"price","strategy":"","fill_strategy":"mode"}'),
        text('{"action":"DROP_ROW","row":"', k, '.5"}'),
        text('{"action":"STANDARDIZE_COL","column":null}'),
    ]
    which = F.col("event_id") % len(forms)
    chosen = F.when(which == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        chosen = chosen.when(which == i, form)
    return e.select("event_id", chosen.alias("raw"))
