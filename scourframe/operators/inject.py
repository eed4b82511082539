"""Error injection with a recorded truth. Two forms of every injector:

* by rate: a cell is hit when its keyed hash falls in a slice of [0, 1); one projection, no shuffle, any size;
* by count: exactly k cells or rows, the k lowest by keyed hash (a top-k, no full sort).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.functions import hashing as H
from scourframe.functions import scalars as X
from scourframe.operators import clean as C
from scourframe.operators import ordering as O
from scourframe.operators import profile as P
from scourframe.session import cut_lineage

# What injected errors look like.
BAD_WORDS = ("N/A", "unknown", "missing", "null", "TBD", "??", "-", "n/a", "none", "—")
FUTURE_DATES = ("2099-01-15", "2099-07-04", "2099-12-31", "2099-03-22", "2099-11-11")
TYPO_MAP: Mapping[str, Sequence[str]] = {
    "Electronics": ("Electrnics", "Electronis", "Electonics"),
    "Food": ("Foood", "Fod", "Fo0d"),
    "Travel": ("Travle", "Trevel", "Travell"),
    "Healthcare": ("Helthcare", "Healtcare", "Heathcare"),
    "Entertainment": ("Entertainmnt", "Entertainmet", "Entertainmen"),
}
PADDING = "  "
OUTLIER_HIGH, OUTLIER_LOW = (5000.0, 15000.0), (-500.0, -10.0)
OUTLIER_HIGH_SHARE = 0.7
VALID_EXTREME = (900.0, 2000.0)
NEAR_COPY_SHARE, NEAR_COPY_PCT = 0.4, 0.01

WORD, NULL, FUTURE_DATE, WHITESPACE, OUTLIER, TYPO = "word", "null", "future_date", "whitespace", "outlier", "typo"


# -- dirty values ---------------------------------------------------------------------------------------------------

def as_raw(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """All columns as text next to the row id: the form of a raw table."""
    return df.select(row_id, *[X.as_text(P.present(df, c)).alias(c) for c in P.data_columns(df, row_id)])


def dirty_value(kind: str, old: Column, key: Column, salt: int, typo_map: Mapping[str, Sequence[str]] = TYPO_MAP) -> Column:
    """Text that an injected error puts in place of `old`."""
    if kind == WORD:
        return H.hash_choice(key, salt, BAD_WORDS)
    if kind == NULL:
        return F.lit(None).cast("string")
    if kind == FUTURE_DATE:
        return H.hash_choice(key, salt, FUTURE_DATES)
    if kind == WHITESPACE:
        return F.concat(F.lit(PADDING), old, F.lit(PADDING))
    if kind == OUTLIER:
        return X.as_text(outlier_amount(key, salt))
    if kind == TYPO:
        return misspelt(old, key, salt, typo_map)
    raise ValueError(f"Unknown kind of error: {kind!r}")


def outlier_amount(key: Column, salt: int) -> Column:
    high = H.hash_uniform(key, salt + 1, *OUTLIER_HIGH)
    low = H.hash_uniform(key, salt + 2, *OUTLIER_LOW)
    return F.when(H.hash_unit(key, salt) < OUTLIER_HIGH_SHARE, high).otherwise(low)


def misspelt(old: Column, key: Column, salt: int, typo_map: Mapping[str, Sequence[str]]) -> Column:
    """One of the misspellings of a value, or the value itself if none is known."""
    out = None
    for value, wrong in typo_map.items():
        choice = H.hash_choice(key, salt, wrong)
        out = F.when(old == value, choice) if out is None else out.when(old == value, choice)
    return out.otherwise(old)


# -- by rate --------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class RateError:
    kind: str
    column: str
    rate: float


def inject_errors(
    df: DataFrame, errors: Sequence[RateError], seed: int, row_id: str = "row_id",
    typo_map: Mapping[str, Sequence[str]] = TYPO_MAP,
) -> tuple[DataFrame, DataFrame]:
    """(dirty, truth). Errors of one column take disjoint slices of its hash, so no cell is hit twice.

    truth: row_id, column, kind, dirty_value, clean_value - one row per injected cell.
    """
    key = F.col(row_id)
    names = P.data_columns(df, row_id)
    hit_columns = [n for n in names if any(e.column == n for e in errors)]
    salts = {n: seed + 10 * names.index(n) for n in hit_columns}
    hashed = df.withColumns({f"_h_{n}": H.keyed_hash(key, salts[n]) for n in hit_columns})
    marks = {}
    for n in hit_columns:
        end, kind = 0.0, None
        for e in [e for e in errors if e.column == n]:
            end += e.rate  # the slices touch, and the first bound not reached decides
            name = F.lit(e.kind) if e.kind not in (TYPO, WHITESPACE) else F.when(F.col(n).isNotNull(), F.lit(e.kind))
            below = F.col(f"_h_{n}") < F.lit(int(end * H.SPACE))
            kind = F.when(below, name) if kind is None else kind.when(below, name)
        marks[f"_k_{n}"] = kind
    marked = hashed.withColumns(marks)
    new = {}
    for n in hit_columns:
        cell = None
        for kind in dict.fromkeys(e.kind for e in errors if e.column == n):
            hit, value = F.col(f"_k_{n}") == kind, dirty_value(kind, F.col(n), key, salts[n] + 1, typo_map)
            cell = F.when(hit, value) if cell is None else cell.when(hit, value)
        new[n] = cell.otherwise(F.col(n))
    dirty = marked.select(row_id, *[new.get(n, F.col(n)).alias(n) for n in names])
    cells = [
        F.when(
            F.col(f"_k_{n}").isNotNull(),
            F.struct(F.lit(n).alias("column"), F.col(f"_k_{n}").alias("kind"), new[n].alias("dirty_value"), F.col(n).alias("clean_value")),
        )
        for n in hit_columns
    ]
    truth = marked.select(row_id, F.explode(F.array_compact(F.array(*cells))).alias("e")).select(row_id, "e.*")
    return dirty, truth


def inject_copies(
    df: DataFrame, rate: float, seed: int, amount: Sequence[str], row_id: str = "row_id",
    near_share: float = NEAR_COPY_SHARE, pct: float = NEAR_COPY_PCT,
) -> tuple[DataFrame, DataFrame]:
    """(table with copies appended, pairs). A share of the copies gets its amount changed by up to `pct`; `amount`
    lists the columns of which the first non-missing one is the amount. Copies get ids above the highest row id."""
    stride = F.coalesce(df.agg(F.max(row_id)).scalar(), F.lit(0)) + 1
    picked = df.filter(H.selected(F.col(row_id), seed, rate))
    copies = _copies(picked, stride + F.col(row_id), seed, amount, row_id, near_share, pct)
    pairs = copies.select(F.col("_orig").alias("original_id"), F.col(row_id).alias("duplicate_id"), "near")
    return df.unionByName(copies.drop("_orig", "near")), pairs


def _copies(picked, new_id, seed, amount, row_id, near_share, pct) -> DataFrame:
    key = F.col(row_id)
    near = H.selected(key, seed + 1, near_share)
    factor = F.lit(1.0 - pct) + F.lit(2 * pct) * H.hash_unit(key, seed + 2)
    types = dict(picked.dtypes)
    changed, earlier = {}, F.lit(False)
    for name in amount:
        here = near & ~earlier & F.col(name).isNotNull()
        value = X.round2(X.safe_float(F.col(name)) * factor)
        changed[name] = F.when(here, value.cast(types[name])).otherwise(F.col(name))
        earlier = earlier | F.col(name).isNotNull()
    columns = P.data_columns(picked, row_id)
    return picked.select(
        new_id.alias(row_id), *[changed.get(c, F.col(c)).alias(c) for c in columns], key.alias("_orig"), near.alias("near")
    )


# -- by count -------------------------------------------------------------------------------------------------------

def sample_rows(df: DataFrame, k: int, seed: int, row_id: str = "row_id", exclude: DataFrame | None = None) -> DataFrame:
    """k rows without replacement: the k lowest by keyed hash, outside `exclude`."""
    if exclude is not None:
        df = exclude_rows(df, exclude, row_id)
    return O.lowest(df, H.keyed_hash(F.col(row_id), seed), [row_id], k)


def exclude_rows(df: DataFrame, keys: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.join(keys.select(row_id), row_id, "left_anti")


def shuffle_rows(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Seeded full shuffle: new row ids 0..n-1 in hash order. Rows are numbered inside slices of the hash range."""
    h = H.keyed_hash(F.col(row_id), seed)
    placed = O.with_position(df.withColumn("_h", h), "_h", "_new", tie=row_id, bits=12)
    return placed.withColumn(row_id, F.col("_new")).select(*df.columns)


def pick_cells(
    df: DataFrame, columns: Sequence[str], k: int, seed: int, row_id: str = "row_id",
    exclude: DataFrame | None = None, filled: bool = False,
) -> DataFrame:
    """(row_id, column, pick, clean_value): k distinct cells, none of them in `exclude`; `filled` asks for cells that
    hold a value. `pick` is the hash the choice went by."""
    each = [
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), X.as_text(F.col(c)).alias("v"))
        for i, c in enumerate(columns)
    ]
    cells = df.select(row_id, F.explode(F.array(*each)).alias("c")).select(row_id, "c.*")
    if filled:
        cells = cells.filter(F.col("v").isNotNull())
    if exclude is not None:
        cells = cells.join(exclude.select(row_id, "column"), [row_id, "column"], "left_anti")
    pick = H.keyed_hash(F.col(row_id) * len(columns) + F.col("i"), seed)
    top = O.lowest(cells.withColumn("pick", pick), F.col("pick"), [row_id, "column"], k)
    return top.select(row_id, "column", "pick", F.col("v").alias("clean_value"))


@dataclass(frozen=True)
class CountError:
    kind: str
    columns: tuple[str, ...]
    k: int


def _truth_of(cells: DataFrame, kind: str, seed: int, row_id: str) -> DataFrame:
    value = dirty_value(kind, F.col("clean_value"), F.col("pick"), seed)
    return cells.select(row_id, "column", F.lit(kind).alias("kind"), value.alias("dirty_value"), "clean_value")


def _written(df: DataFrame, truth: DataFrame, row_id: str) -> DataFrame:
    return C.write_cells(df, truth.select(row_id, "column", F.col("dirty_value").alias("value")), row_id)


def inject_counts(
    df: DataFrame, errors: Sequence[CountError], seed: int, row_id: str = "row_id", exclude: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(dirty, truth): the listed numbers of errors in a raw table, no cell hit twice.

    All cells are picked from the same table and written in one join. Each kind takes the lowest hashes of its own among cells that
    no kind before it took; these lie among as many lowest as all kinds so far need, so that two scans find the candidates of all
    kinds, and the picks, which depend on each other, are taken from the candidates and checkpointed one by one.
    """
    parts, taken = [], None
    candidates = cut_lineage(_candidates(df, errors, seed, row_id, exclude))
    for n, e in enumerate(errors):
        own = candidates.filter(F.col("n") == n).drop("n")
        if taken is not None:
            own = own.join(taken, [row_id, "column"], "left_anti")
        cells = O.lowest(own, F.col("pick"), [row_id, "column"], e.k)
        part = cut_lineage(_truth_of(cells, e.kind, seed + n, row_id))
        parts.append(part)
        hit = part.select(row_id, "column")
        taken = hit if taken is None else taken.unionByName(hit)
    truth = truth_table(parts)
    return _written(df, truth, row_id), truth


def _candidates(df: DataFrame, errors: Sequence[CountError], seed: int, row_id: str, exclude: DataFrame | None) -> DataFrame:
    """(n, row_id, column, pick, clean_value): for each kind at least as many cells of lowest hash as all kinds up to it need.

    One histogram of the upper bits of the hash, for all kinds at once, tells up to which bucket each of them goes.
    """
    names = list(dict.fromkeys(c for e in errors for c in e.columns))
    each = [F.struct(F.lit(c).alias("column"), X.as_text(F.col(c)).alias("clean_value")) for c in names]
    cells = df.select(row_id, F.explode(F.array(*each)).alias("c")).select(row_id, "c.*")
    if exclude is not None:
        cells = cells.join(exclude.select(row_id, "column"), [row_id, "column"], "left_anti")
    kinds = []
    for n, e in enumerate(errors):
        at = X.lookup({c: i for i, c in enumerate(e.columns)}, F.col("column"))
        fits = at.isNotNull() & (F.col("clean_value").isNotNull() if e.kind in (WHITESPACE, TYPO) else F.lit(True))
        pick = H.keyed_hash(F.col(row_id) * len(e.columns) + at, seed + n)
        kinds.append(F.when(fits, F.struct(F.lit(n).alias("n"), pick.alias("pick"))))
    picks = cells.select(row_id, "column", "clean_value", F.explode(F.array_compact(F.array(*kinds))).alias("p"))
    picks = picks.select("p.n", row_id, "column", "p.pick", "clean_value")
    bucket = F.shiftright("pick", 20)
    sizes = sorted(tuple(r) for r in picks.groupBy("n", bucket.alias("b")).agg(F.count(F.lit(1)).alias("size")).collect())  # 4,096 a kind
    last, seen = {}, dict.fromkeys(range(len(errors)), 0)
    for n, b, size in sizes:
        if seen[n] < sum(e.k for e in errors[: n + 1]):
            last[n] = b
        seen[n] += size
    if not last:
        return picks
    return picks.filter(bucket <= X.lookup(last, F.col("n")))


def inject_words(df: DataFrame, columns: Sequence[str], k: int, seed: int, row_id: str = "row_id", exclude: DataFrame | None = None):
    return inject_counts(df, [CountError(WORD, tuple(columns), k)], seed, row_id, exclude)


def inject_nulls(df: DataFrame, columns: Sequence[str], k: int, seed: int, row_id: str = "row_id", exclude: DataFrame | None = None):
    return inject_counts(df, [CountError(NULL, tuple(columns), k)], seed, row_id, exclude)


def inject_future_dates(df: DataFrame, column: str, k: int, seed: int, row_id: str = "row_id", exclude: DataFrame | None = None):
    return inject_counts(df, [CountError(FUTURE_DATE, (column,), k)], seed, row_id, exclude)


def inject_whitespace(df: DataFrame, columns: Sequence[str], k: int, seed: int, row_id: str = "row_id", exclude: DataFrame | None = None):
    """Only cells that hold a value are padded."""
    return inject_counts(df, [CountError(WHITESPACE, tuple(columns), k)], seed, row_id, exclude)


def inject_rows(df: DataFrame, column: str, rows: DataFrame, kind: str, seed: int, row_id: str = "row_id"):
    """One kind of error in one column of the given rows: (dirty, truth)."""
    known = df.select(row_id, X.as_text(F.col(column)).alias("clean_value")).join(rows.select(row_id), row_id, "left_semi")
    cells = known.withColumn("column", F.lit(column)).withColumn("pick", F.col(row_id))
    truth = _truth_of(cells, kind, seed, row_id)
    return _written(df, truth, row_id), truth


def inject_outliers(df: DataFrame, column: str, rows: DataFrame, seed: int, row_id: str = "row_id"):
    """Impossible amounts in the given rows."""
    return inject_rows(df, column, rows, OUTLIER, seed, row_id)


def inject_typos(df: DataFrame, column: str, rows: DataFrame, seed: int, row_id: str = "row_id"):
    return inject_rows(df, column, rows, TYPO, seed, row_id)


def plant_valid_extremes(frames: Sequence[DataFrame], column: str, rows: DataFrame, seed: int, row_id: str = "row_id") -> list[DataFrame]:
    """The same large but legitimate amounts in the given rows of every frame (the clean and the dirty one)."""
    value = X.as_text(H.hash_uniform(F.col(row_id), seed, *VALID_EXTREME))
    patches = rows.select(row_id, F.lit(column).alias("column"), value.alias("value"))
    return [C.write_cells(f, patches, row_id) for f in frames]


def inject_duplicates(
    df: DataFrame, k: int, seed: int, amount: Sequence[str], row_id: str = "row_id",
    near_share: float = NEAR_COPY_SHARE, pct: float = NEAR_COPY_PCT,
) -> tuple[DataFrame, DataFrame]:
    """Exactly k copied rows: (table, pairs)."""
    stride = F.coalesce(df.agg(F.max(row_id)).scalar(), F.lit(0)) + 1
    copies = _copies(sample_rows(df, k, seed, row_id), stride + F.col(row_id), seed, amount, row_id, near_share, pct)
    pairs = copies.select(F.col("_orig").alias("original_id"), F.col(row_id).alias("duplicate_id"), "near")
    return df.unionByName(copies.drop("_orig", "near")), pairs


# -- truth ----------------------------------------------------------------------------------------------------------

def truth_table(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_dirty_cells(dirty: DataFrame, clean: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row `dirty_cells`: cells whose text differs, rows matched by id."""
    columns = P.data_columns(clean, row_id)
    d = dirty.select(row_id, *[X.as_text(P.present(dirty, c)).alias(f"d_{c}") for c in columns])
    c = clean.select(row_id, *[X.as_text(P.present(clean, c)).alias(f"c_{c}") for c in columns])
    differs = [F.when(F.col(f"d_{n}").eqNullSafe(F.col(f"c_{n}")), 0).otherwise(1) for n in columns]
    both = d.join(c, row_id)
    per_row = sum(differs[1:], differs[0])
    return both.agg(F.coalesce(F.sum(per_row), F.lit(0).cast("bigint")).alias("dirty_cells"))
