"""How close a cleaned table is to its ground truth. Every grader returns one row:
score DOUBLE, issues_remaining BIGINT, detail STRING, breakdown STRUCT."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import names as N
from scourframe.functions import scalars as X
from scourframe.operators import ordering as O
from scourframe.operators import profile as P

# Tolerances and weights of the scores.
EPS = 1e-9
VALID_AMOUNT = (5.0, 800.0)
EXTREME_TOLERANCE = 0.05
OUTLIER_WEIGHT, TYPO_WEIGHT = 0.50, 0.50
SCHEMA_WEIGHT, DEDUP_WEIGHT, FORMAT_WEIGHT = 0.40, 0.35, 0.25
RENAME_BONUS = 0.10
INJECTED_COPIES = 30
DATE_ALIASES = ("purchase_date", "date", "PurchaseDate")
NUMERIC_CELLS, DATE_CELLS = ("price", "quantity"), ("order_date",)
EMPTY_DETAIL = "Empty DataFrame — no score."


# -- shared pieces --------------------------------------------------------------------------------------------------

def _fixed(c: Column, places: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    scale = float(10**places)
    return F.format_string(f"%.{places}f", F.rint(c * scale) / scale)


def result(df: DataFrame, score: Column, issues: Column, detail: Column, breakdown: Mapping[str, Column]) -> DataFrame:
    return df.select(
        X.round4(X.clip(score, 0.0, 1.0)).alias("score"),
        issues.cast("bigint").alias("issues_remaining"),
        detail.alias("detail"),
        F.struct(*[c.alias(n) for n, c in breakdown.items()]).alias("breakdown"),
    )


def harmonic(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + EPS)


def f1(tp: Column, fp: Column, n: Column) -> Column:
    return harmonic(tp / (tp + fp + EPS), tp / (n + EPS))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    total = None
    for weight, score in parts:
        total = weight * score if total is None else total + weight * score
    return total


# -- cell match -----------------------------------------------------------------------------------------------------

def ensure_columns(df: DataFrame, columns: Sequence[str], mark: str = X.MISSING_COLUMN_MARK) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(mark) for c in absent}) if absent else df


def normalise_cells(
    df: DataFrame,
    columns: Sequence[str],
    row_id: str = "row_id",
    numeric: Sequence[str] = NUMERIC_CELLS,
    dates: Sequence[str] = DATE_CELLS,
) -> DataFrame:
    """Comparable text of every cell; a column that the table lacks is filled with a mark."""
    out = []
    for name in columns:
        cell = comparable(P.present(df, name), name, numeric, dates) if name in df.columns else F.lit(X.MISSING_COLUMN_MARK)
        out.append(cell.alias(name))
    return df.select(row_id, *out)


def comparable(cell: Column, name: str, numeric: Sequence[str] = NUMERIC_CELLS, dates: Sequence[str] = DATE_CELLS) -> Column:
    if name in numeric:
        return X.numeric_text(cell)
    if name in dates:
        return X.date_text(cell)
    return F.coalesce(X.strip(X.as_text(cell)), F.lit(X.NAN_MARK))


def raw_cells(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Every cell as the text it is, NaN as NULL; a column that the table lacks is filled with a mark."""
    there = [X.as_text(P.present(df, n)).alias(n) if n in df.columns else F.lit(X.MISSING_COLUMN_MARK).alias(n) for n in columns]
    return df.select(row_id, *there)


def align_rows(work: DataFrame, clean: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per clean row: w_<column> and c_<column>. Rows that the work table lacks are filled with a mark, rows
    beyond the clean table are cut."""
    columns = P.data_columns(clean, row_id)
    work = ensure_columns(work, columns)
    w = work.select(row_id, *[X.as_text(F.col(c)).alias(f"w_{c}") for c in columns], F.lit(True).alias("_here"))
    c = clean.select(row_id, *[X.as_text(F.col(c)).alias(f"c_{c}") for c in columns])
    joined = c.join(w, row_id, "left")
    pad = F.when(F.col("_here").isNull(), F.lit(X.MISSING_ROW_MARK))
    return joined.select(
        row_id, *[f"c_{n}" for n in columns], *[F.coalesce(pad, F.col(f"w_{n}")).alias(f"w_{n}") for n in columns]
    )


def same_cell(
    work: Column, clean: Column, name: str, numeric: Sequence[str] = NUMERIC_CELLS, dates: Sequence[str] = DATE_CELLS,
    null_equal: bool = True,
) -> Column:
    """Whether two raw texts are the same after normalisation. Only texts that differ are normalised at all."""
    absent = work.isin(X.MISSING_ROW_MARK, X.MISSING_COLUMN_MARK)
    return (
        F.when(work.isNull() | clean.isNull(), work.isNull() & clean.isNull() & F.lit(null_equal))
        .when(absent, False)
        .when(work == clean, True)
        .otherwise(comparable(work, name, numeric, dates) == comparable(clean, name, numeric, dates))
    )


def cell_counts(
    aligned: DataFrame, columns: Sequence[str], null_equal: bool = True, numeric: Sequence[str] = NUMERIC_CELLS,
    dates: Sequence[str] = DATE_CELLS,
) -> DataFrame:
    """One row: matches, total_cells, from rows of raw texts w_<column> and c_<column>."""
    hits = [F.when(same_cell(F.col(f"w_{n}"), F.col(f"c_{n}"), n, numeric, dates, null_equal), 1).otherwise(0) for n in columns]
    per_row = sum(hits[1:], hits[0])
    return aligned.agg(
        F.coalesce(F.sum(per_row), F.lit(0).cast("bigint")).alias("matches"),
        (F.count(F.lit(1)) * len(columns)).alias("total_cells"),
    )


def cell_match(
    work: DataFrame,
    clean: DataFrame,
    row_id: str = "row_id",
    align: str = "row_id",
    numeric: Sequence[str] = NUMERIC_CELLS,
    dates: Sequence[str] = DATE_CELLS,
    null_equal: bool = True,
) -> DataFrame:
    """Share of cells that equal the truth after normalisation.

    `align="row_id"` compares each row with its own truth; `align="position"` compares by place in row order, so a
    dropped row shifts all later ones against the truth.
    """
    columns = P.data_columns(clean, row_id)
    if align == "position":
        work = O.with_position(work, row_id, "_pos").withColumn(row_id, F.col("_pos")).drop("_pos")
        clean = O.with_position(clean, row_id, "_pos").withColumn(row_id, F.col("_pos")).drop("_pos")
    aligned = align_rows(raw_cells(work, columns, row_id), raw_cells(clean, columns, row_id), row_id)
    return match_result(cell_counts(aligned, columns, null_equal, numeric, dates))


def match_result(counts: DataFrame) -> DataFrame:
    """The grade from one row: matches, total_cells."""
    matched, total = F.col("matches"), F.col("total_cells")
    wrong, score = total - matched, matched / F.nullif(total, F.lit(0))
    detail = F.concat(
        X.as_text(matched), F.lit("/"), X.as_text(total), F.lit(" cells correct ("), _fixed(score * 100, 1),
        F.lit("%) — "), X.as_text(wrong), F.lit(" still need fixing."),
    )
    return result(counts, score, wrong, detail, {
        "cell_match_ratio": X.round4(score), "cells_matched": matched, "total_cells": total, "cells_mismatched": wrong,
    })


# -- outliers and typos ---------------------------------------------------------------------------------------------

def truth_to_key(truth: DataFrame, clean: DataFrame, key: str, row_id: str = "row_id", extra: Sequence[str] = ()) -> DataFrame:
    """Stable key (and further clean columns) of the rows a truth table names by row id."""
    return truth.join(clean.select(row_id, key, *extra), row_id)


def key_of(c: Column) -> Column:
    """Integer key in a raw cell, also where it was written as a decimal; NULL where it is none."""
    return F.coalesce(X.try_int(c), X.safe_float(c).try_cast("bigint"))


def live_rows(work: DataFrame, keys: DataFrame, key: str, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The first row, by row id, of each wanted key that is still in the table."""
    wanted = keys.select(F.col(key).cast("bigint").alias(key)).distinct()
    rows = work.select(key_of(F.col(key)).alias(key), row_id, *columns)
    mine = rows.join(wanted, key, "left_semi")
    first = mine.groupBy(key).agg(F.min(row_id).alias(row_id))  # numbers only, so that rows are hashed and not sorted
    return mine.join(first, [key, row_id]).select(key, F.lit(True).alias("_alive"), *[F.col(c).alias(f"w_{c}") for c in columns])


def join_truth(truth: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Truth rows with the live row of their key; `_alive` is NULL where the row was dropped."""
    return truth.withColumn(key, F.col(key).cast("bigint")).join(live, key, "left")


def outlier_outcomes(work: DataFrame, clean: DataFrame, outliers: DataFrame, extremes: DataFrame, typos: DataFrame,
                     key: str, amount: str, category: str, row_id: str = "row_id") -> DataFrame:
    """One row per truth item: kind (outlier, extreme, typo) and ok.

    The three truth tables are joined to the work table together: one pass over it, one lookup join.
    """
    listed = outliers.select(row_id, F.lit("outlier").alias("kind"), F.lit(None).cast("string").alias("want"))
    listed = listed.unionByName(extremes.select(row_id, F.lit("extreme").alias("kind"), F.lit(None).cast("string").alias("want")))
    listed = listed.unionByName(typos.select(row_id, F.lit("typo").alias("kind"), F.col("clean_value").alias("want")))
    parts = truth_to_key(listed, clean, key, row_id, [amount]).select(
        key, "kind", F.col(amount).cast("double").alias("amount"), "want"
    )
    live = live_rows(work, parts, key, [amount, category], row_id)
    joined = join_truth(parts, live, key)
    dropped = F.col("_alive").isNull()
    x = X.safe_float(F.col(f"w_{amount}"))
    near = x.between(F.col("amount") * (1 - EXTREME_TOLERANCE), F.col("amount") * (1 + EXTREME_TOLERANCE))
    ok = (
        F.when(F.col("kind") == "outlier", dropped | F.coalesce(x.between(*VALID_AMOUNT), F.lit(False)))
        .when(F.col("kind") == "extreme", ~dropped & F.coalesce(near, F.lit(False)))
        .otherwise(~dropped & F.coalesce(X.strip(F.col(f"w_{category}")) == F.col("want"), F.lit(False)))
    )
    return joined.select("kind", key, ok.alias("ok"))


def score_medium(
    work: DataFrame, clean: DataFrame, outliers: DataFrame, extremes: DataFrame, typos: DataFrame,
    key: str = "tx_id", amount: str = "amount", category: str = "category", row_id: str = "row_id",
) -> DataFrame:
    """Half F1 on outlier rows (protected large rows count as false positives when damaged), half share of
    misspellings restored."""
    items = outlier_outcomes(work, clean, outliers, extremes, typos, key, amount, category, row_id)
    kind, ok = F.col("kind"), F.col("ok")
    counts = items.agg(
        F.count_if((kind == "outlier") & ok).alias("tp"),
        F.count_if((kind == "outlier") & ~ok).alias("fn"),
        F.count_if((kind == "extreme") & ~ok).alias("fp"),
        F.count_if((kind == "typo") & ok).alias("fixed"),
        F.count_if(kind == "typo").alias("typos"),
    )
    tp, fn, fp, fixed, typos_n = (F.col(c) for c in ("tp", "fn", "fp", "fixed", "typos"))
    precision, recall = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    outlier_f1 = harmonic(precision, recall)
    typo = fixed / F.greatest(typos_n, F.lit(1))
    score = weighted([(OUTLIER_WEIGHT, outlier_f1), (TYPO_WEIGHT, typo)])
    detail = F.concat(
        F.lit("Outlier F1="), _fixed(outlier_f1, 3), F.lit(" (TP="), X.as_text(tp), F.lit(", FP="), X.as_text(fp),
        F.lit(", FN="), X.as_text(fn), F.lit(") | Typos "), X.as_text(fixed), F.lit("/"), X.as_text(typos_n),
        F.lit(" fixed → score="), _fixed(score, 3),
    )
    return result(counts, score, fn + (typos_n - fixed), detail, {
        "outlier_f1": X.round4(outlier_f1), "outlier_tp": tp, "outlier_fn": fn, "outlier_fp": fp,
        "precision": X.round4(precision), "recall": X.round4(recall), "typo_score": X.round4(typo),
        "typos_fixed": fixed, "typos_total": typos_n, "combined": X.round4(score),
    })


def row_loss(work: DataFrame, clean: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """One row: clean rows, and those lost although the truth does not allow dropping them (which the scores above
    do not look at)."""
    alive = live_ids(work, key)
    lost = clean.select(F.col(key).cast("bigint").alias(key)).join(alive, key, "left_anti")
    lost = lost.join(allowed.select(F.col(key).cast("bigint").alias(key)), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("rows_lost"))


# -- schema, copies, date format ------------------------------------------------------------------------------------

def schema_score(columns: Sequence[str], canonical: Sequence[str]) -> dict[str, float]:
    """From names alone: share of the canonical columns, plus a bonus when nothing else is left."""
    found = sum(c in columns for c in canonical)
    leftover = len(N.leftover_columns(list(dict.fromkeys(columns)), canonical))
    bonus = RENAME_BONUS if found == len(canonical) and leftover == 0 else 0.0
    return {
        "score": min(1.0, found / len(canonical) + bonus), "canonical_found": found,
        "canonical_total": len(canonical), "leftover_aliases": leftover, "rename_bonus": bonus,
    }


def dedup_score(rows: Column, n_clean: int, copies: int = INJECTED_COPIES) -> dict[str, Column]:
    """From row counts alone: how many copies must have gone, and how many good rows went with them."""
    n, zero = F.lit(copies), F.lit(0)
    removed = F.greatest(zero, F.lit(n_clean + copies) - rows)
    true = F.least(removed, n)
    over = F.greatest(zero, removed - n)
    precision = F.greatest(zero, true - over) / (removed + EPS)
    recall = true / (n + EPS)
    return {
        "rows_removed": removed, "true_dups_removed": true, "over_deletion": over,
        "precision": precision, "recall": recall, "f1": harmonic(precision, recall),
    }


def row_excess(df: DataFrame, n_clean: int) -> DataFrame:
    """One row: rows, excess (rows beyond the clean count)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("excess", F.greatest(F.lit(0), F.col("rows") - n_clean))


def live_ids(work: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are still in the table; keys that are no number are left out."""
    ids = work.select(key_of(F.col(key)).alias(key))
    return ids.filter(F.col(key).isNotNull()).distinct()


def dedup_identity_score(work: DataFrame, clean: DataFrame, pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Which rows went, not only how many: one row with copies, copies_removed, originals_lost, precision, recall, f1.
    A pair counts as resolved when one of its two rows is left."""
    alive = work.select(F.col(row_id)).withColumn("_alive", F.lit(True))
    ids = pairs.select("original_id", "duplicate_id")
    first = alive.select(F.col(row_id).alias("original_id"), F.col("_alive").alias("_o"))
    second = alive.select(F.col(row_id).alias("duplicate_id"), F.col("_alive").alias("_d"))
    state = ids.join(first, "original_id", "left").join(second, "duplicate_id", "left")
    one_left = F.col("_o").isNull() != F.col("_d").isNull()
    copied = state.agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(one_left).alias("copies_removed"),
        F.count_if(F.col("_o").isNull() & F.col("_d").isNull()).alias("both_lost"),
    )
    others = clean.select(row_id).join(alive, row_id, "left_anti").join(
        ids.select(F.col("original_id").alias(row_id)), row_id, "left_anti"
    )
    tp, fp = F.col("copies_removed"), F.col("both_lost") + others.agg(F.count(F.lit(1))).scalar()
    return copied.select(
        "copies", "copies_removed", fp.alias("originals_lost"),
        X.round4(tp / (tp + fp + EPS)).alias("precision"),
        X.round4(tp / (F.col("copies") + EPS)).alias("recall"),
        X.round4(f1(tp, fp, F.col("copies"))).alias("f1"),
    )


def date_column(columns: Sequence[str], aliases: Sequence[str] = DATE_ALIASES) -> str | None:
    return next((a for a in aliases if a in columns), None)


def score_hard(
    work: DataFrame, n_clean: int, canonical: Sequence[str], row_id: str = "row_id",
    copies: int = INJECTED_COPIES, date_aliases: Sequence[str] = DATE_ALIASES,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Schema, copies and date format in one pass that reads a single column. `names` stands in for the column names
    where the table holds them in another spelling."""
    columns = P.data_columns(work, row_id)
    schema = schema_score(names or columns, canonical)
    date = date_column(columns, date_aliases)
    text = X.as_text(P.present(work, date)) if date else F.lit(None).cast("string")
    counts = work.agg(
        F.count(F.lit(1)).alias("rows"), F.count(text).alias("n_total"), F.count_if(X.valid_iso(text)).alias("n_valid")
    )
    rows, n_total, n_valid = F.col("rows"), F.col("n_total"), F.col("n_valid")
    dup = dedup_score(rows, n_clean, copies)
    fmt = n_valid / F.greatest(n_total, F.lit(1))
    score = weighted([(SCHEMA_WEIGHT, F.lit(schema["score"])), (DEDUP_WEIGHT, dup["f1"]), (FORMAT_WEIGHT, fmt)])
    issues = F.lit(len(canonical) - schema["canonical_found"]) + F.greatest(F.lit(0), rows - n_clean)
    detail = F.concat(
        F.lit("Schema="), _fixed(F.lit(schema["score"]), 3), F.lit(" | Dedup="), _fixed(dup["f1"], 3),
        F.lit(" | DateFmt="), _fixed(fmt, 3), F.lit(" → score="), _fixed(score, 3),
    )
    shown = {k: X.round4(v) if k in ("precision", "recall", "f1") else v for k, v in dup.items()}
    return result(counts, score, issues, detail, {
        "schema_score": F.lit(round(schema["score"], 4)), "dedup_score": X.round4(dup["f1"]),
        "format_score": X.round4(fmt), "combined": X.round4(score),
        **{f"schema_{k}": F.lit(v) for k, v in schema.items() if k != "score"},
        **{f"dedup_{k}": v for k, v in shown.items()},
        "fmt_date_col_found": F.lit(date is not None), "fmt_date_col_used": F.lit(date).cast("string"),
        "fmt_n_total": n_total, "fmt_n_valid_iso": n_valid, "fmt_n_year_ok": n_valid, "fmt_valid_ratio": X.round4(fmt),
    })


def empty_result(df: DataFrame) -> DataFrame:
    """Score of a table without rows."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("issues_remaining"),
        F.lit(EMPTY_DETAIL).alias("detail"), F.struct(F.col("n").alias("rows")).alias("breakdown"),
    )
