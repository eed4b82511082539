"""The registered queries: one per operator or small group of operators, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scourframe.functions import hashing as H
from scourframe.functions import names as N
from scourframe.functions import scalars as X
from scourframe.operators import actions as A
from scourframe.operators import clean as C
from scourframe.operators import compare
from scourframe.operators import episodes as E
from scourframe.operators import generate as G
from scourframe.operators import grade as Q
from scourframe.operators import inject as I
from scourframe.operators import merge as M
from scourframe.operators import ordering as O
from scourframe.operators import profile as P
from scourframe.operators import rules as V
from scourframe.sources import readwrite as S
from scourframe.sources.versions import VersionedTable
from scourframe.streaming.live import LiveFill
from scourframe.plans import datasets as D
from scourframe.session import shared_dir
from scourframe.plans.cleaning_plan import CleaningPlan
from suite import tables as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _listed(df: DataFrame, *names: str) -> DataFrame:
    """Lists as text, so that any engine can compare them."""
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


def _fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scourframe-{uuid.uuid4().hex}"


# -- profile and rules ------------------------------------------------------------------------------------------------

@query
def profile_orders_dirty(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return _listed(P.column_status(dirty), "issues")


@query
def broken_columns(spark, sf):
    return _listed(P.broken_columns(P.column_status(T.customers_padded(spark, sf))), "issues")


@query
def all_clean(spark, sf):
    before = T.customers_padded(spark, sf)
    after = C.standardize_cols(before, ["label"], kinds={"label": "string"})
    stages = [P.all_clean(P.column_status(t)).withColumn("stage", F.lit(s)) for s, t in (("raw", before), ("clean", after))]
    return stages[0].unionByName(stages[1])


@query
def parse_ratio(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return P.parse_ratio(dirty, ["custkey", "price", "priority"]).withColumn("ratio", X.round4(F.col("ratio")))


@query
def column_centers(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    mean = P.column_center(dirty, "price").select(X.round2(F.col("mean")).alias("mean"), "numeric")
    median = C.exact_median(dirty, X.to_numeric(F.col("price")))
    mode = C.most_frequent(dirty, "custkey").scalar()
    return mean.withColumn("median", X.round2(F.lit(median).cast("double"))).withColumn("mode", mode)


@query
def valid_fraction(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    out = P.valid_fraction(dirty, "order_date", X.valid_iso(F.col("order_date")))
    return out.withColumn("valid_ratio", X.round4(F.col("valid_ratio")))


@query
def filter_suspect(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return P.filter_suspect(dirty, "price").select("row_id", "price")


@query
def validate_rules(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    copies, _ = T.orders_with_copies(spark, sf)
    row_rules = [
        V.rule_not_null("orderstatus"), V.rule_in_domain("orderstatus", ("O", "F", "P")), V.rule_range("custkey", 0, 1000),
        V.rule_range("price", 2000, 400000), V.rule_date("order_date", (1996, 1997, 1998)), V.rule_trimmed("priority"),
        V.rule_scale("price", 1), V.rule_unique("custkey"),
    ]
    return V.validate_rules(dirty, row_rules).unionByName(
        V.validate_rules(copies, [V.rule_unique("amount")])
    )


@query
def violating_rows(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return V.violating_rows(dirty, V.rule_range("price", 2000, 400000)).select("row_id", "price")


@query
def violating_unique(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return V.violating_rows(dirty, V.rule_unique("custkey")).select("row_id", "custkey")


# -- scalar functions -------------------------------------------------------------------------------------------------

@query
def scalar_functions(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    date, price = F.col("order_date"), F.col("price")
    with_comma = F.concat(F.substring(price, 1, 2), F.lit(","), F.substring(price, 3, 20))
    return dirty.select(
        "row_id",
        X.strip(F.col("priority")).alias("stripped"),
        F.lower("priority").alias("lowered"),
        X.zero_padded(F.col("row_id"), 9).alias("padded"),
        X.to_numeric(price).alias("number"),
        X.safe_float(with_comma).alias("number_with_comma"),
        X.numeric_text(price).alias("number_text"),
        X.date_text(date).alias("date_text"),
        X.year_prefix(date).alias("year"),
        X.valid_iso(date).alias("plausible_iso"),
        X.try_int(F.col("custkey")).alias("whole"),
        X.clip(X.to_numeric(price), 2000.0, 400000.0).alias("clipped"),
        X.lookup({"O": "open", "F": "filled"}, X.strip(F.col("orderstatus")), F.lit("other")).alias("status_name"),
        X.days_between(F.lit("1995-01-01").cast("date"), F.try_to_date(date, "yyyy-MM-dd")).alias("days"),
        X.iso(X.add_days(F.try_to_date(date, "yyyy-MM-dd"), F.lit(30))).alias("later"),
        X.is_missing(F.col("custkey")).alias("no_customer"),
    )


@query
def date_forms(spark, sf):
    """Dates written in many ways, read strictly and by a free guess."""
    o = T.table(spark, sf, "orders")
    d, which = F.col("o_orderdate"), F.col("o_orderkey") % 12
    forms = [
        "yyyy-MM-dd", "M/d/yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d yyyy", "MMMM d, yyyy",
        "d MMM yyyy", "dd-MMM-yyyy", "yyyy-MM-dd HH:mm:ss", "MM-dd-yyyy",
    ]
    text = F.when(which == 0, F.date_format(d, forms[0]))
    for i, form in enumerate(forms[1:], 1):
        text = text.when(which == i, F.date_format(d, form))
    return o.select(F.col("o_orderkey").alias("row_id"), text.alias("raw")).select(
        "row_id", "raw", X.normalise_dates(F.col("raw")).alias("normalised"), X.date_text(F.col("raw")).alias("compared")
    )


# -- injection and generation -----------------------------------------------------------------------------------------

@query
def inject_errors(spark, sf):
    return T.orders_dirty(spark, sf)[1]


@query
def inject_counts(spark, sf):
    errors = [
        I.CountError(I.WORD, ("custkey", "price"), 100), I.CountError(I.NULL, ("price", "orderstatus"), 80),
        I.CountError(I.FUTURE_DATE, ("order_date",), 50), I.CountError(I.WHITESPACE, ("orderstatus", "priority"), 60),
    ]
    return I.inject_counts(T.orders_raw(spark, sf), errors, 300)[1]


@query
def inject_outliers_typos(spark, sf):
    return T.accounts_dirty(spark, sf)[1]


@query
def plant_valid_extremes(spark, sf):
    base = T.accounts(spark, sf)
    rows = I.sample_rows(base, 40, 78).select("row_id")
    (planted,) = I.plant_valid_extremes([base], "amount", rows, 79)
    return planted.join(base.select("row_id", F.col("amount").alias("usual")), "row_id").filter(
        F.col("amount") != F.col("usual")
    ).select("row_id", "amount")


@query
def inject_copies(spark, sf):
    return T.orders_with_copies(spark, sf)[1]


@query
def inject_duplicates(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), X.round2(F.col("o_totalprice")).alias("amount"))
    with_copies, pairs = I.inject_duplicates(o, 30, 910, ["amount"])
    return pairs.join(with_copies.select(F.col("row_id").alias("duplicate_id"), "amount"), "duplicate_id")


@query
def sample_rows(spark, sf):
    o = T.orders_raw(spark, sf)
    first = I.sample_rows(o, 200, 80).select("row_id")
    return I.sample_rows(o, 300, 80, exclude=first).select("row_id", "price")


@query
def shuffle_rows(spark, sf):
    return I.shuffle_rows(T.orders_raw(spark, sf).withColumn("old_id", F.col("row_id")), 81).select("row_id", "old_id")


@query
def generate_orders(spark, sf):
    return G.gen_orders(T.table(spark, sf, "orders"), "o_orderkey", 42)


@query
def generate_transactions(spark, sf):
    return G.gen_transactions(T.table(spark, sf, "orders"), "o_orderkey", 137)


@query
def generate_source_block(spark, sf):
    return G.gen_source_block(T.table(spark, sf, "orders"), "o_orderkey", "source_b", 999)


# -- reading, writing, order ------------------------------------------------------------------------------------------

@query
def csv_roundtrip(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    path = _fresh_folder(spark)
    S.write_csv(dirty, path)
    return S.read_raw(spark, path, S.ROW_INDEX, "csv", [S.ROW_INDEX, *P.data_columns(dirty)])


@query
def read_raw(spark, sf):
    return S.read_raw(spark, f"{sf}/customer.parquet", "c_custkey")


@query
def snapshot_versions(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    path = _fresh_folder(spark)
    S.snapshot(dirty, path, 0)
    S.snapshot(C.drop_missing(dirty, "price"), path, 1)
    parts = [
        S.read_snapshot(spark, path, i).agg(F.count(F.lit(1)).alias("rows"), F.count("price").alias("prices")).withColumn("step", F.lit(i))
        for i in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def _versions(spark, sf) -> VersionedTable:
    """Orders in four versions: corrupted, without rows that lack a price, a key filled in, a price as number and a new column."""
    table = VersionedTable(spark, _fresh_folder(spark))
    dirty, _ = T.orders_dirty(spark, sf)
    steps = [
        lambda t: C.drop_missing(t, "price"),
        lambda t: t.withColumn("custkey", F.coalesce("custkey", F.lit("0"))),
        lambda t: t.withColumn("price", X.to_numeric(F.col("price"))).withColumn("flag", F.col("row_id") % 2 == 0),
    ]
    table.commit(dirty)
    for step in steps:
        table.commit(step(table.read()))
    return table


@query
def versions_read(spark, sf):
    """Every version, folded from the copy and the deltas before it."""
    table = _versions(spark, sf)
    parts = []
    for v in table.history():
        t = table.read(v.version)
        flag = F.col("flag").cast("int") if "flag" in t.columns else F.lit(None).cast("int")
        price = X.to_numeric(F.col("price")) if dict(t.dtypes)["price"] == "string" else F.col("price")
        parts.append(t.select(F.lit(v.version).alias("version"), "row_id", "custkey", "orderstatus", price.alias("price"), "order_date", flag.alias("flag")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def versions_stored(spark, sf):
    """How many rows and cells each version stores."""
    return _versions(spark, sf).manifest().select("version", "complete", "rows", "cells")


@query
def preview(spark, sf):
    return S.preview(T.orders_dirty(spark, sf)[0])


@query
def positions(spark, sf):
    kept = C.drop_missing(T.orders_dirty(spark, sf)[0], "price")
    return O.with_position(kept.select("row_id"), "row_id")


@query
def rows_at_positions(spark, sf):
    """Rows at places that the events name."""
    kept = C.drop_missing(T.orders_dirty(spark, sf)[0], "price").select("row_id")
    e = T.table(spark, sf, "events")
    wanted = e.groupBy((F.col("user_id") % 50).alias("g")).agg((F.sum("event_id") % T.table(spark, sf, "orders").agg(F.count(F.lit(1))).scalar()).alias("position")).select("position")
    return O.rows_at_positions(kept, wanted)


@query
def align_rows(spark, sf):
    clean = T.orders_raw(spark, sf)
    work = clean.filter(~H.selected(F.col("row_id"), 90, 0.1)).drop("priority")
    return Q.align_rows(work, clean).drop("c_price", "c_custkey", "w_custkey", "c_order_date", "w_order_date")


@query
def coalesce_first(spark, sf):
    merged = T.merged_raw(spark, sf)
    amounts = [f"{s}:{a['amount']}" for s, a in G.SOURCE_ALIASES.items()]
    return merged.select("row_id", X.coalesce_first(amounts).alias("amount"))


# -- cleaning ---------------------------------------------------------------------------------------------------------

@query
def standardize_dates(spark, sf):
    text = T.merged_raw(spark, sf)
    dates = text.select("row_id", X.coalesce_first([f"{s}:{a['purchase_date']}" for s, a in G.SOURCE_ALIASES.items()]).alias("order_date"))
    return C.standardize_col(dates, "order_date")


@query
def standardize_numeric(spark, sf):
    """One column with few words becomes numeric, one with too many stays text."""
    li = T.table(spark, sf, "lineitem")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    raw = li.select(
        F.col("l_orderkey").alias("row_id"), "l_linenumber",
        F.when(H.selected(k, 95, 0.05), F.lit("N/A")).otherwise(T.money(F.col("l_extendedprice"))).alias("price"),
        F.when(H.selected(k, 96, 0.4), F.lit(" many ")).otherwise(T.money(F.col("l_quantity"))).alias("quantity"),
    )
    return C.standardize_cols(raw, ["price", "quantity"])


@query
def standardize_strings(spark, sf):
    return C.standardize_cols(T.customers_padded(spark, sf), ["label", "segment"])


@query
def standardize_all(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return C.standardize_cols(dirty, P.data_columns(dirty))


@query
def fill_mean(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return C.fill_missing(dirty, "price", "mean")[0].select("row_id", "price")


@query
def fill_median(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return C.fill_missing(dirty, "price", "median")[0].select("row_id", "price")


@query
def fill_mode(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return C.fill_missing(dirty, "custkey", "mode")[0].select("row_id", "custkey")


@query
def fill_mode_hot(spark, sf):
    """A column with nearly as many values as rows, of which one is frequent."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(
        H.selected(k, 97, 0.05), F.lit("unknown")).when(~H.selected(k, 98, 0.05), k.cast("string")).alias("label"))
    return C.fill_missing(lines, "label", "mode")[0]


@query
def fill_live(spark, sf):
    """Orders that come as a stream of files, in three increments: each is filled with the statistics of those before it."""
    dirty, _ = T.orders_dirty(spark, sf)
    folder = _fresh_folder(spark)
    dirty.select("row_id", "custkey", "orderstatus", "price").write.parquet(f"{folder}/orders")
    dirty = spark.read.parquet(f"{folder}/orders")
    live = LiveFill(spark, f"{folder}/filled", {"price": "mean", "custkey": "median", "orderstatus": "mode"})
    for part in range(3):
        dirty.filter(H.hash_int(F.col("row_id"), 111, 0, 3) == part).write.mode("append").parquet(f"{folder}/incoming")
        live.advance(spark.readStream.schema(dirty.schema).parquet(f"{folder}/incoming"))
    return live.rows().withColumn("missing", F.array_join("missing", ","))


@query
def fill_drop(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return C.fill_missing(dirty, "orderstatus", "drop")[0].select("row_id", "orderstatus")


def _patches(spark, sf):
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    column = H.hash_choice(k, 100, ("price", "price", "custkey", "priority", "absent"))
    good = F.when(column == "custkey", X.as_text(H.hash_int(k, 101, 1, 999))).when(column == "priority", F.lit(" 9-NEW ")).otherwise(
        F.concat(F.lit("1,"), X.zero_padded(H.hash_int(k, 102, 0, 1000), 3), F.lit(".255")))
    value = F.when(H.selected(k, 103, 0.1), F.lit("abc")).otherwise(good)
    target = F.when(H.selected(k, 104, 0.05), k + 100_000_000).otherwise(F.shiftright(k, 1))
    return o.filter(H.selected(k, 105, 0.2)).select(target.alias("row_id"), column.alias("column"), value.alias("value"), k.alias("step"))


@query
def set_values_patch(spark, sf):
    return C.set_values(T.orders_raw(spark, sf), _patches(spark, sf))[0]


@query
def set_values_report(spark, sf):
    report = C.set_values(T.orders_raw(spark, sf), _patches(spark, sf))[1]
    return report.select("step", "row_id", "column", "value", "success", "error")


@query
def last_write_wins(spark, sf):
    return C.last_write_wins(_patches(spark, sf))


@query
def cast_like_column(spark, sf):
    raw = T.orders_raw(spark, sf)
    stats = F.broadcast(C.cast_statistics(raw, P.data_columns(raw)))  # one row per column
    cast = C.cast_like_column(F.col("value"), F.col("majority_numeric"), F.col("all_whole"))
    return _patches(spark, sf).join(stats, "column").select("step", "column", cast["value"].alias("cast_value"), cast["ok"].alias("ok"))


def _drops(spark, sf):
    dirty = T.accounts(spark, sf)
    drops = dirty.filter((F.col("amount") > 700) | H.selected(F.col("row_id"), 110, 0.05))
    return dirty, drops.select("row_id", "tx_id"), dirty.filter(T.is_extreme(F.col("row_id"))).select("tx_id")


@query
def drop_rows(spark, sf):
    table, drops, _ = _drops(spark, sf)
    return C.drop_rows(table, drops)


@query
def drop_rows_protected(spark, sf):
    _, drops, protected = _drops(spark, sf)
    return C.flag_protected(drops, protected, "tx_id")


@query
def fix_categories(spark, sf):
    dirty, _ = T.accounts_dirty(spark, sf)
    return C.fix_categories(dirty, "segment", T.SEGMENTS).select("row_id", "segment")


@query
def fix_categories_table(spark, sf):
    """Part names with one or two letters lost, added or exchanged, repaired by the table of names that occur."""
    part, k, name = T.table(spark, sf, "part"), F.col("p_partkey"), F.col("p_name")
    at = (k % F.length(name) + 1).cast("int")
    lost = F.concat(name.substr(F.lit(1), at - 1), name.substr(at + 1, F.length(name)))
    label = F.when(k % 3 == 0, lost).when(k % 5 == 1, F.concat(name, F.lit("x"))).when(k % 7 == 2, F.concat(F.lit("q"), lost)).when(k % 11 == 3, F.concat(name, F.lit(" unknown"))).otherwise(name)
    return C.fix_categories(part.select("p_partkey", label.alias("label")), "label", part.select("p_name"))


@query
def column_medians(spark, sf):
    """Exact medians of four columns at once."""
    medians = C.column_medians(T.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return medians.select("column", F.round("median", 6).alias("median"))


@query
def inject_listed_typos(spark, sf):
    """Misspellings put into a given list of rows."""
    accounts = T.accounts(spark, sf)
    rows = accounts.filter(H.selected(F.col("row_id"), 310, 0.1)).select("row_id")
    _, truth = I.inject_typos(I.as_raw(accounts), "segment", rows, 311)
    return truth.select("row_id", "column", "kind", (F.length("dirty_value") > 0).alias("filled"), "clean_value")


@query
def typo_lookup(spark, sf):
    dirty, _ = T.accounts_dirty(spark, sf)
    return C.typo_lookup(dirty, "segment", T.SEGMENT_TYPOS).select("row_id", "segment")


@query
def outlier_range(spark, sf):
    dirty, _ = T.accounts_dirty(spark, sf)
    return C.handle_outliers(dirty, "amount", 0, 2000).select("row_id", "amount")


@query
def outlier_cap(spark, sf):
    dirty, _ = T.accounts_dirty(spark, sf)
    return C.handle_outliers(dirty, "amount", 5, 800, "cap").select("row_id", "amount")


@query
def outlier_zscore(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "value")
    return C.zscore_outliers(e, "value", 3.0).filter("is_outlier").select("event_id", "value", X.round4(F.col("z")).alias("z"))


# -- merge and copies -------------------------------------------------------------------------------------------------

@query
def conform_sources(spark, sf):
    return M.merge_sources([D.conform(s, b) for s, b in T.source_blocks(spark, sf).items()])


@query
def coalesce_aliases(spark, sf):
    return D.collapse_sources(T.merged_raw(spark, sf))


@query
def union_ragged(spark, sf):
    """Which raw columns each row fills."""
    merged = T.merged_raw(spark, sf)
    filled = sum(F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in merged.columns if c != "row_id")
    return merged.select("row_id", filled.alias("filled"), F.lit(len(merged.columns) - 1).alias("raw_columns"))


@query
def alias_lookup(spark, sf):
    """Canonical name of every filled raw cell, counted."""
    merged = T.merged_raw(spark, sf)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c.split(":", 1)[1]).alias("alias"), F.col(f"`{c}`").alias("v")) for c in merged.columns if ":" in c
    ]))
    counted = merged.select(cells.alias("c")).select("c.*").filter(F.col("v").isNotNull()).groupBy("alias").agg(F.count(F.lit(1)).alias("cells"))
    return M.alias_lookup(counted, "alias", N.global_lookup(G.SOURCE_ALIASES))


@query
def dedup_exact(spark, sf):
    copies, _ = T.orders_with_copies(spark, sf)
    return M.dedup_exact(copies)


@query
def dedup_exact_documents(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return M.dedup_exact(docs, "doc_id")


@query
def dedup_near(spark, sf):
    copies, _ = T.orders_with_copies(spark, sf)
    return M.dedup_near(copies, ["custkey", "orderstatus", "order_date", "priority"], "amount")


@query
def near_duplicates_wide(spark, sf):
    """Few large blocks: orders of one priority and status, whatever the customer."""
    copies, _ = T.orders_with_copies(spark, sf)
    return M.near_duplicates(copies, ["orderstatus", "priority"], "amount", 0.0001)


@query
def dedup_by_key(spark, sf):
    copies, _ = T.orders_with_copies(spark, sf)
    return M.dedup_by_key(copies, ["custkey", "order_date"])


@query
def duplicate_pairs(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.sha2("text", 256).alias("digest"))
    return M.duplicate_pairs(docs, ["digest"])


@query
def exclude_rows(spark, sf):
    raw = T.orders_raw(spark, sf)
    return I.exclude_rows(raw, raw.filter(F.col("price").cast("double") > 250000)).select("row_id", "price")


# -- comparison with the truth ----------------------------------------------------------------------------------------

def _flat(graded: DataFrame) -> DataFrame:
    return graded.select("score", "issues_remaining", "detail", "breakdown.*")


@query
def count_dirty_cells(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return I.count_dirty_cells(dirty, T.orders_raw(spark, sf))


_ORDER_CELLS = {"numeric": ("price", "custkey"), "dates": ("order_date",)}


@query
def grade_cells(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return _flat(Q.cell_match(C.drop_missing(dirty, "price"), T.orders_raw(spark, sf), **_ORDER_CELLS))


@query
def grade_cells_positional(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return _flat(Q.cell_match(C.drop_missing(dirty, "price"), T.orders_raw(spark, sf), align="position", **_ORDER_CELLS))


def _mended(spark, sf):
    """Orders that are still wrong in one of twenty stretches of keys, and lack some rows there."""
    truth = T.orders_raw(spark, sf)
    dirty, _ = T.orders_dirty(spark, sf)
    late = F.shiftright("row_id", 8) % 20 == 3
    return dirty.filter(late & (F.col("row_id") % 11 != 0)).unionByName(truth.filter(~late)), truth


@query
def grade_cells_ranges(spark, sf):
    return _flat(compare.cell_match(*_mended(spark, sf), **_ORDER_CELLS))


@query
def count_dirty_cells_ranges(spark, sf):
    return compare.count_dirty_cells(*_mended(spark, sf))


@query
def changed_cells(spark, sf):
    out = compare.changed_cells(T.orders_raw(spark, sf), _mended(spark, sf)[0])
    return out.select("row_id", F.array_join("_set", ",").alias("changed"), F.col("_gone").alias("gone"))


@query
def grade_dispatch(spark, sf):
    """Grades by the kind of the task, on given tables; a table without rows scores nothing."""
    dirty, _ = T.orders_dirty(spark, sf)
    truth = T.orders_raw(spark, sf)
    work = C.drop_missing(dirty, "price")
    task = D.TaskDataset("easy", dirty, truth, "", {}, [])
    accounts, clean, outliers, extremes, typos = _account_truth(spark, sf)
    medium = D.TaskDataset("medium", accounts, clean, "", {"outlier_rows": outliers, "valid_extreme_rows": extremes, "typo_cells": typos}, [])
    parts = [
        D.grade(kind, table, data).select(F.lit(case).alias("case"), "score", "issues_remaining", "detail")
        for case, kind, table, data in (
            ("easy", "easy", work, task), ("easy, empty", "easy", work.filter(F.col("row_id") < 0), task),
            ("medium, empty", "medium", accounts.filter(F.col("row_id") < 0), medium),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _account_truth(spark, sf):
    dirty, truth = T.accounts_dirty(spark, sf)
    clean = T.accounts(spark, sf)
    extremes = clean.filter(T.is_extreme(F.col("row_id"))).select("row_id")
    return dirty, clean, truth.filter(F.col("kind") == I.OUTLIER), extremes, truth.filter(F.col("kind") == I.TYPO)


@query
def grade_outliers_typos(spark, sf):
    """After a run that repairs categories and drops everything above 1500 and below 0, protected rows included."""
    dirty, clean, outliers, extremes, typos = _account_truth(spark, sf)
    work = C.handle_outliers(C.fix_categories(dirty, "segment", T.SEGMENTS, 1), "amount", 0, 1500)
    return _flat(Q.score_medium(work, clean, outliers, extremes, typos, category="segment"))


@query
def truth_outcomes(spark, sf):
    dirty, clean, outliers, extremes, typos = _account_truth(spark, sf)
    work = C.handle_outliers(dirty, "amount", 0, 1500)
    return Q.outlier_outcomes(work, clean, outliers, extremes, typos, "tx_id", "amount", "segment")


@query
def row_loss(spark, sf):
    dirty, clean, outliers, _, _ = _account_truth(spark, sf)
    work = C.handle_outliers(dirty, "amount", 0, 1500)
    return Q.row_loss(work, clean, clean.join(outliers.select("row_id"), "row_id"), "tx_id")


@query
def grade_schema_dedup_dates(spark, sf):
    copies, pairs = T.orders_with_copies(spark, sf)
    work = C.drop_missing(copies.withColumn("purchase_date", F.when(F.col("row_id") % 7 == 0, F.date_format(F.to_date("order_date"), "MM/dd/yyyy")).otherwise(F.col("order_date"))), "amount")
    work = work.filter(~(H.selected(F.col("row_id"), 120, 0.03))).drop("order_date").withColumnRenamed("custkey", "customer_id")
    return _flat(Q.score_hard(work, T.table(spark, sf, "orders").count(), G.CANONICAL, copies=pairs.count()))


@query
def row_excess(spark, sf):
    copies, _ = T.orders_with_copies(spark, sf)
    return Q.row_excess(copies, T.table(spark, sf, "orders").count())


@query
def live_ids(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return Q.live_ids(dirty, "custkey")


@query
def grade_dedup_identity(spark, sf):
    copies, pairs = T.orders_with_copies(spark, sf)
    work = copies.filter(~H.selected(F.col("row_id"), 121, 0.3))
    clean = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return Q.dedup_identity_score(work, clean, pairs)


# -- action logs ------------------------------------------------------------------------------------------------------

@query
def parse_responses(spark, sf):
    return A.parse_responses(T.responses(spark, sf), "raw", T.RESPONSE_COLUMNS).drop("raw")


@query
def validate_actions(spark, sf):
    return A.validate_actions(T.action_log(spark, sf))


@query
def row_in_range(spark, sf):
    log = T.action_log(spark, sf, "supplier").select("episode_id", "step", "row_index")
    return A.row_in_range(log, T.table(spark, sf, "supplier"))


@query
def resolve_positions(spark, sf):
    """Positions in a table of as many rows as there are suppliers."""
    log = T.action_log(spark, sf, "supplier").select("episode_id", "step", "command", "row_index")
    return A.resolve_positions(log, T.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar())


@query
def resolve_positions_hot(spark, sf):
    """All events as one episode of drops and edits all over the orders."""
    n = T.table(spark, sf, "orders").agg(F.count(F.lit(1))).scalar()
    drop = F.col("event_id") % 100 == 7
    log = T.table(spark, sf, "events").select(
        F.lit("all").alias("episode_id"), F.col("event_id").alias("step"), F.when(drop, "DROP_ROW").otherwise("SET_VALUE").alias("command"),
        H.hash_int(F.col("event_id"), 67, 0, 1 << 30).alias("row_index"))
    return A.resolve_positions(log.withColumn("row_index", F.col("row_index") % (n + 2)), n).drop("episode_id")


def _apply_log(spark, sf) -> DataFrame:
    """One episode of about 200 actions on rows all over the orders table, folded from all events."""
    g = F.col("g")
    n_rows = T.table(spark, sf, "orders").agg(F.count(F.lit(1))).scalar()
    e = T.table(spark, sf, "events").groupBy((F.col("event_id") % 200).alias("g")).agg(
        F.sum("event_id").alias("s"), F.sum("value").cast("decimal(18,2)").cast("string").alias("v")
    )
    edits = e.select(
        F.lit("one").alias("episode_id"), (g + 1).cast("int").alias("step"),
        F.when(g % 4 == 3, F.lit("DROP_ROW")).otherwise("SET_VALUE").alias("command"),
        F.when(g % 10 == 9, F.lit(10**12)).otherwise(F.col("s") % n_rows).cast("bigint").alias("row_index"),
        F.when(g % 4 == 3, F.lit(None).cast("string")).when(g % 5 == 0, F.lit("priority")).when(g % 11 == 0, F.lit("absent")).otherwise("price").alias("column"),
        F.when(g % 4 == 3, F.lit(None).cast("string")).when(g % 13 == 0, F.lit("abc")).otherwise(F.col("v")).alias("value"),
        F.lit(None).cast("string").alias("fill_strategy"),
    )
    # the last two steps hang on the groups that exist, so they too come from the events
    last = e.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.explode(F.array(
        F.struct((F.col("n") + 1).alias("step"), F.lit("STANDARDIZE_COL").alias("command"), F.lit("priority").alias("column"), F.lit(None).cast("string").alias("fill_strategy")),
        F.struct((F.col("n") + 2).alias("step"), F.lit("FILL_MISSING").alias("command"), F.lit("price").alias("column"), F.lit("mean").alias("fill_strategy")),
    )).alias("a")).select(
        F.lit("one").alias("episode_id"), "a.step", "a.command", F.lit(None).cast("bigint").alias("row_index"), "a.column",
        F.lit(None).cast("string").alias("value"), "a.fill_strategy",
    )
    return edits.unionByName(last)


@query
def apply_actions(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    return A.apply_actions(dirty, _apply_log(spark, sf)).table


@query
def apply_actions_report(spark, sf):
    dirty, _ = T.orders_dirty(spark, sf)
    protected = dirty.filter(F.col("row_id") % 5 == 0).select("custkey")
    return A.apply_actions(dirty, _apply_log(spark, sf), protected=protected, protected_key="custkey").report


@query
def plan_applied(spark, sf):
    """A plan of 161 commands on rows all over the orders."""
    plan, n = CleaningPlan(), T.table(spark, sf, "orders").count()
    for i in range(160):
        plan.set_value(i * n // 160, "price", f"{1000 + i}.5")
    return plan.drop_row(0).apply(T.orders_dirty(spark, sf)[0]).table.select("row_id", "price")


@query
def check_fill(spark, sf):
    """Which fills of the dirty orders can be done, and why others can't."""
    dirty, _ = T.orders_dirty(spark, sf)
    wanted = [("price", "mean"), ("price", "median"), ("priority", "mean"), ("priority", "mode"), ("priority", "zero"), ("orderstatus", "drop")]
    results = [(c, s, C.check_fill(dirty, c, s)) for c, s in wanted]
    return spark.createDataFrame([(c, s, r.success, r.error) for c, s, r in results], "`column` string, strategy string, success boolean, error string")


# -- episodes ---------------------------------------------------------------------------------------------------------

@query
def step_rewards(spark, sf):
    return E.step_rewards(T.step_log(spark, sf)).select("episode_id", "step", "command", "score", "prev_score", "reward", "done")


@query
def done_gate(spark, sf):
    log = T.step_log(spark, sf)
    episodes = log.filter(F.col("step") == 0).select("episode_id")
    i = F.col("i")
    broken = episodes.select("episode_id", F.posexplode(F.array(*[F.lit(c) for c in "abcdefg"])).alias("i", "column")).filter(
        i < F.col("episode_id").cast("bigint") % 8
    ).select("episode_id", "column", i.alias("ordinal"))
    return E.done_gate(log, broken).withColumn("still_broken", F.array_join("still_broken", ","))


@query
def termination(spark, sf):
    return E.termination(T.step_log(spark, sf))


@query
def cut_at_terminal(spark, sf):
    return E.cut_at_terminal(T.step_log(spark, sf)).select("episode_id", "step", "score", "done")


@query
def episode_totals(spark, sf):
    return E.episode_totals(E.step_rewards(T.step_log(spark, sf)))


@query
def episode_summary(spark, sf):
    summary = E.episode_summary(T.step_log(spark, sf), rewards=True)
    return _listed(summary.withColumn("rewards", F.col("rewards").cast("array<decimal(10,4)>")), "rewards")


@query
def episode_rewards(spark, sf):
    return E.episode_rewards(T.step_log(spark, sf)).select("episode_id", "task_id", "step", "score", "reward", "done")


@query
def step_position(spark, sf):
    return E.step_position(T.step_log(spark, sf)).select("episode_id", "step", "step_number", "remaining")


@query
def current_state(spark, sf):
    return E.current_state(T.step_log(spark, sf))


@query
def recent_actions(spark, sf):
    return _listed(E.recent_actions(T.step_log(spark, sf)).select("episode_id", "step", "recent"), "recent")


@query
def inject_listed_rows(spark, sf):
    """Outliers put into a given list of rows."""
    accounts = T.accounts(spark, sf)
    rows = accounts.filter(H.selected(F.col("row_id"), 300, 0.1)).select("row_id")
    _, truth = I.inject_outliers(I.as_raw(accounts), "amount", rows, 301)
    return truth.select("row_id", "column", "kind", F.col("dirty_value").cast("double").alias("dirty"), F.col("clean_value").cast("double").alias("clean"))
