import pytest
from pyspark.sql import functions as F

from scourframe.operators import grade as Q
from scourframe.operators import inject as I
from scourframe.operators import clean as C
from scourframe.operators import merge as M
from scourframe.operators import generate as G
from scourframe.operators import rules as V
from scourframe.plans import datasets as D


def score(df):
    return df.first()


def test_unknown_name(spark):
    with pytest.raises(ValueError):
        D.load_dataset(spark, "nope")


def test_easy(spark):
    ds = D.load_dataset(spark, "easy")
    dirty, clean = ds.dirty.cache(), ds.clean
    assert dirty.count() == clean.count() == 50
    assert ds.truth["injected_cells"].count() == 29
    assert ds.truth["injected_cells"].select("row_id", "column").distinct().count() == 29
    assert I.count_dirty_cells(dirty, clean).first()[0] == 29
    r = score(D.grade("easy", dirty, ds))
    assert r.score == 0.9425 and r.issues_remaining == 23
    assert r.detail == "377/400 cells correct (94.2%) — 23 still need fixing."
    assert score(D.grade("easy", clean, ds)).score == 1.0
    empty = score(D.grade("easy", clean.limit(0), ds))
    assert empty.score == 0.0 and empty.detail.startswith("Empty")


def test_easy_position_and_row_id_alignment(spark):
    ds = D.load_dataset(spark, "easy")
    fewer = ds.clean.filter("row_id != 10")
    by_id = score(Q.cell_match(fewer, ds.clean))
    by_place = score(Q.cell_match(fewer, ds.clean, align="position"))
    assert by_id.issues_remaining == 8
    assert by_place.issues_remaining > 100
    more = ds.clean.unionByName(ds.clean.withColumn("row_id", F.col("row_id") + 50))
    assert score(Q.cell_match(more, ds.clean, align="position")).score == 1.0
    lacking = ds.clean.drop("region")
    assert score(Q.cell_match(lacking, ds.clean)).issues_remaining == 50


def test_medium(spark):
    ds = D.load_dataset(spark, "medium")
    dirty, clean, t = ds.dirty.cache(), ds.clean, ds.truth
    assert dirty.count() == 200
    assert I.count_dirty_cells(dirty, clean).first()[0] == 27
    r = score(D.grade("medium", dirty, ds))
    assert r.score == 0.0 and r.issues_remaining == 27 and r.breakdown.outlier_fp == 0
    assert score(D.grade("medium", clean, ds)).score == 1.0
    fixed = C.fix_categories(dirty, "category", G.TX_CATEGORIES)
    half = score(D.grade("medium", fixed, ds))
    assert half.score == 0.5 and half.breakdown.typos_fixed == 12
    done = score(D.grade("medium", C.handle_outliers(fixed, "amount", 0, 2000), ds))
    assert done.score == 1.0 and done.breakdown.outlier_tp == 15
    # dropping the protected rows costs precision: F1 of 15 tp, 5 fp
    greedy = score(D.grade("medium", C.handle_outliers(fixed, "amount", 0, 800), ds))
    assert greedy.breakdown.outlier_fp == 5
    assert abs(greedy.breakdown.outlier_f1 - 2 * 0.75 / 1.75) < 1e-3
    assert Q.row_loss(C.handle_outliers(fixed, "amount", 0, 800), clean, clean.join(t["outlier_rows"], "row_id"), "tx_id").first()[0] == 5
    capped = score(D.grade("medium", C.handle_outliers(fixed, "amount", 5, 2000, "cap"), ds))
    assert capped.breakdown.outlier_tp < 15


def test_hard(spark):
    ds = D.load_dataset(spark, "hard")
    dirty, clean = ds.dirty.cache(), ds.clean
    assert dirty.count() == 430 and clean.count() == 400
    names = D.raw_names(dirty)
    assert len(names) == 27 and len(set(names)) == 27
    assert [r[0] for r in dirty.select("row_id").orderBy("row_id").collect()] == list(range(430))
    assert score(D.grade("hard", dirty, ds)).score == 0.2222
    assert score(D.grade("hard", clean, ds)).score == 1.0

    merged = D.collapse_sources(dirty, ("row_id", "source_row"))
    assert merged.filter(F.col("record_id").isNull()).isEmpty()
    iso = C.standardize_col(merged, "purchase_date")
    renamed = score(D.grade("hard", iso.drop("source_row"), ds))
    assert renamed.score == 0.65
    unique = M.dedup_by_key(iso, ["record_id"])
    final = score(D.grade("hard", unique.drop("source_row"), ds))
    assert final.score == 1.0
    by_source = clean.withColumnRenamed("row_id", "source_row")
    ident = Q.dedup_identity_score(unique, by_source, ds.truth["duplicate_pairs"], "source_row").first()
    assert ident.copies == 30 and ident.copies_removed == 30 and ident.f1 == 1.0
    again = C.standardize_col(M.dedup_near(iso, [c for c in G.CANONICAL if c != "amount"], "amount"), "purchase_date")
    assert again.count() == 400
    checks = {(r.rule, r.column): r.violations for r in V.validate_rules(iso, ds.rules).collect()}
    assert checks[("unique", "record_id")] == 30
    assert sum(checks.values()) == 30


def test_rules_find_injected_errors(spark):
    ds = D.load_dataset(spark, "easy")
    kinds = {r["kind"]: r["n"] for r in ds.truth["injected_cells"].groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"word": 10, "null": 8, "future_date": 5, "whitespace": 6}
    got = {(r.rule, r.column): r.violations for r in V.validate_rules(ds.dirty, ds.rules).collect()}
    assert sum(v for (rule, _), v in got.items() if rule == "not_null") == 8
    assert got[("range", "price")] + got[("range", "quantity")] == 10
    assert got[("date", "order_date")] == 5
    assert not V.violating_rows(ds.dirty, V.rule_date("order_date", (2023, 2024))).isEmpty()
