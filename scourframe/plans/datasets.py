"""The three named tasks: a dirty table, its clean truth and the truth of the injected errors."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scourframe.operators import generate as G
from scourframe.operators import grade as Q
from scourframe.operators import inject as I
from scourframe.operators import merge as M
from scourframe.operators import rules as V
from scourframe.session import cut_lineage

# Seeds, sizes and counts of the tasks.
SEEDS = {"easy": 42, "medium": 137, "hard": 999}
EASY_ROWS, EASY_WORDS, EASY_NULLS, EASY_DATES, EASY_PADDED = 50, 10, 8, 5, 6
MEDIUM_ROWS, MEDIUM_OUTLIERS, MEDIUM_EXTREMES, MEDIUM_TYPOS = 200, 15, 5, 12
HARD_SIZES = {"source_a": 134, "source_b": 133, "source_c": 133}
HARD_COPIES = 30


@dataclass
class TaskDataset:
    task_id: str
    dirty: DataFrame
    clean: DataFrame
    schema_hint: str
    truth: Mapping[str, DataFrame]
    rules: list[V.Rule]
    canonical: tuple[str, ...] = ()
    sources: dict[str, DataFrame] = field(default_factory=dict)


EASY_HINT = (
    "Sales orders: order_id integer; customer, product, category, region without outer spaces; price with 2 decimals; "
    "quantity integer; order_date YYYY-MM-DD in 2023 or 2024; no missing values."
)
MEDIUM_HINT = (
    "Transactions: tx_id integer; customer_id 1 to 500; amount 0 to 2000, where 900 to 2000 is legitimate; tx_date "
    "YYYY-MM-DD; category, country and status from fixed lists."
)
HARD_HINT = (
    "Three sources that name their columns differently, with ISO, US and European dates and about 30 copied rows. "
    "Canonical columns: " + ", ".join(G.CANONICAL) + "."
)


def order_rules() -> list[V.Rule]:
    names = ["order_id", "customer", "product", "category", "price", "quantity", "order_date", "region"]
    return [
        *[V.rule_not_null(c) for c in names],
        *[V.rule_trimmed(c) for c in ("customer", "product", "region")],
        V.rule_in_domain("category", G.ORDER_CATEGORIES),
        V.rule_in_domain("region", G.ORDER_REGIONS),
        V.rule_range("price"), V.rule_scale("price", 2), V.rule_range("quantity"),
        V.rule_date("order_date", (2023, 2024)),
    ]


def transaction_rules() -> list[V.Rule]:
    return [
        V.rule_range("tx_id"), V.rule_range("customer_id", 1, 500), V.rule_range("amount", 0, 2000),
        V.rule_date("tx_date"), V.rule_in_domain("category", G.TX_CATEGORIES),
        V.rule_in_domain("country", G.TX_COUNTRIES), V.rule_in_domain("status", G.TX_STATUSES),
    ]


def merge_rules() -> list[V.Rule]:
    return [
        V.rule_unique("record_id"), V.rule_range("customer_id"), V.rule_range("amount"),
        V.rule_in_domain("currency", G.MERGE_CURRENCIES), V.rule_date("purchase_date"),
        V.rule_in_domain("region", G.MERGE_REGIONS),
    ]


def make_easy(spark: SparkSession) -> TaskDataset:
    seed = SEEDS["easy"]
    clean = G.gen_orders(G.sequential_ids(spark, 0, EASY_ROWS), "id", seed)
    dirty, truth = I.inject_counts(
        I.as_raw(clean),
        [
            I.CountError(I.WORD, ("price", "quantity"), EASY_WORDS),
            I.CountError(I.NULL, ("customer", "product", "price", "quantity", "region"), EASY_NULLS),
            I.CountError(I.FUTURE_DATE, ("order_date",), EASY_DATES),
            I.CountError(I.WHITESPACE, ("customer", "product", "category", "region"), EASY_PADDED),
        ],
        seed + 101,
    )
    return TaskDataset("easy", dirty, clean, EASY_HINT, {"injected_cells": truth}, order_rules())


def make_medium(spark: SparkSession) -> TaskDataset:
    seed = SEEDS["medium"]
    clean = G.gen_transactions(G.sequential_ids(spark, 0, MEDIUM_ROWS), "id", seed)
    outliers = cut_lineage(I.sample_rows(clean, MEDIUM_OUTLIERS, seed + 101).select("row_id"))
    extremes = cut_lineage(I.sample_rows(clean, MEDIUM_EXTREMES, seed + 102, exclude=outliers).select("row_id"))
    typo_rows = cut_lineage(I.sample_rows(clean, MEDIUM_TYPOS, seed + 103, exclude=outliers).select("row_id"))
    (clean,) = I.plant_valid_extremes([clean], "amount", extremes, seed + 104)
    dirty, outlier_truth = I.inject_outliers(I.as_raw(clean), "amount", outliers, seed + 105)
    dirty, typo_truth = I.inject_typos(dirty, "category", typo_rows, seed + 106)
    truth = {
        "outlier_rows": outliers, "valid_extreme_rows": extremes,
        "typo_cells": typo_truth.select("row_id", "dirty_value", "clean_value"), "outlier_cells": outlier_truth,
    }
    return TaskDataset("medium", dirty, clean, MEDIUM_HINT, truth, transaction_rules())


def conform(source: str, block: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return M.conform_source(
        block, G.SOURCE_ALIASES[source], "purchase_date", G.SOURCE_DATE_FORMATS[source], keep
    )


def make_hard(spark: SparkSession) -> TaskDataset:
    """Sources stay apart until they are conformed, so that names differing by case only never meet; the dirty table
    keeps one raw column per source and canonical name, in the form `source.alias`."""
    seed = SEEDS["hard"]
    blocks = G.gen_three_sources(spark, HARD_SIZES, seed)
    clean = M.merge_sources([conform(s, b) for s, b in blocks.items()])
    clean = clean.withColumn("row_id", F.col("record_id") - 1).select("row_id", *G.CANONICAL)
    raw = []
    for source, block in blocks.items():
        key = G.SOURCE_ALIASES[source]["record_id"]
        named = [F.col(c).alias(f"{source}:{c}") for c in block.columns]
        raw.append(I.as_raw(block.select((F.col(key) - 1).alias("row_id"), *named)))
    merged = M.union_ragged(raw)
    amounts = [f"{s}:{a['amount']}" for s, a in G.SOURCE_ALIASES.items()]
    with_copies, pairs = I.inject_duplicates(merged, HARD_COPIES, seed + 101, amounts)
    # the pairs name rows by the id they have before the shuffle, kept as source_row
    dirty = I.shuffle_rows(with_copies.withColumn("source_row", F.col("row_id")), seed)
    truth = {"duplicate_pairs": pairs}
    return TaskDataset("hard", dirty, clean, HARD_HINT, truth, merge_rules(), G.CANONICAL, blocks)


def raw_names(dirty: DataFrame) -> list[str]:
    """The raw column names of a merged table as its sources spell them (two may differ by case only)."""
    return [c.split(":", 1)[1] for c in dirty.columns if ":" in c]


def collapse_sources(dirty: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Merged raw table -> canonical columns, all still as text with the date form of their source."""
    sources = {s: {c: f"{s}:{a}" for c, a in m.items()} for s, m in G.SOURCE_ALIASES.items()}
    return M.coalesce_aliases(dirty, sources, G.CANONICAL, keep)


_BUILDERS: dict[str, Callable[[SparkSession], TaskDataset]] = {
    "easy": make_easy, "medium": make_medium, "hard": make_hard,
}


def load_dataset(spark: SparkSession, name: str) -> TaskDataset:
    if name not in _BUILDERS:
        raise ValueError(f"Unknown task_id: {name!r}. Must be easy/medium/hard.")
    return _BUILDERS[name](spark)


def grade(kind: str, work: DataFrame, dataset: TaskDataset) -> DataFrame:
    """Score of a working table by the kind of its task; an empty table scores 0."""
    if kind not in _BUILDERS:
        raise ValueError(f"Unknown task_id: {kind!r}")
    if work.isEmpty():
        return Q.empty_result(work)
    if kind == "easy":
        return Q.cell_match(work, dataset.clean, align="position")
    if kind == "medium":
        t = dataset.truth
        return Q.score_medium(work, dataset.clean, t["outlier_rows"], t["valid_extreme_rows"], t["typo_cells"])
    names = raw_names(work)
    if not names:
        return Q.score_hard(work, sum(HARD_SIZES.values()), G.CANONICAL, copies=HARD_COPIES)
    # still in raw form: the names its sources use decide the schema score
    date = Q.date_column(names)
    cell = next(c for c in work.columns if c.endswith(f":{date}"))
    view = work.select("row_id", F.col(f"`{cell}`").alias(date))
    return Q.score_hard(view, sum(HARD_SIZES.values()), G.CANONICAL, copies=HARD_COPIES, names=names)
