import random
import statistics
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scourframe.operators import clean as C
from scourframe.operators import inject as I
from scourframe.operators import profile as P


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, " + schema)


def status(df, **kw):
    return {r["column"]: (r["missing"], r["standardized"], r["issues"]) for r in P.column_status(df, **kw).collect()}


def test_column_status(spark):
    df = frame(spark, [
        ("x", "2023-01-01", "1", float("nan"), "US"), (" y ", "01/02/2023", "N/A", 2.0, "UK"), (None, "2099-01-01", None, 3.0, "CA"),
    ], "name string, order_date string, price string, score double, country string")
    got = status(df)
    assert got["name"] == (1, False, ["1_missing", "1_has_whitespace"])
    assert got["order_date"] == (0, False, ["1_bad_date_format", "1_future_year"])
    assert got["price"] == (1, False, ["1_missing", "1_non_numeric_text"])
    assert got["score"] == (1, False, ["1_missing"])
    assert got["country"] == (0, False, ["3_non_numeric_text"])  # the name holds "count"
    assert status(df, whole_token=True)["country"] == (0, True, [])
    assert P.broken_columns(P.column_status(df)).count() == 5


def test_kinds_by_content(spark):
    rows = [(str(i), f"0{i % 9 + 1}/02/2023", str(i) if i < 12 else "x") for i in range(20)]  # all cells count, not the first
    df = frame(spark, rows, "code string, day string, mixed string")
    assert P.column_kinds(df, sniff_dates=True) == {"code": "numeric", "day": "date", "mixed": "string"}
    assert P.column_kinds(df) == {"code": "numeric", "day": "string", "mixed": "string"}
    assert P.looks_like_date(df, "day") and not P.looks_like_date(df, "code") and P.looks_like_numeric(df, "code")


def test_kinds_look_past_an_empty_head(spark):
    df = spark.range(1500).select(
        F.col("id").alias("row_id"), F.when(F.col("id") >= 1200, F.col("id").cast("string")).alias("late"),
        F.lit(None).cast("string").alias("never"))
    assert P.column_kinds(df, sniff_dates=True) == {"late": "numeric", "never": "string"}


def test_standardize(spark):
    rows = [(" a ", "1", "5"), ("b", "x", "x"), ("c", "3", "7"), ("d", "4", "8"), (None, None, None), ("e", "5", "q")]
    df = frame(spark, rows, "name string, price string, amount string")
    out = C.standardize_cols(df, ["name", "price", "amount"]).orderBy("row_id").collect()
    assert [r["name"] for r in out] == ["a", "b", "c", "d", None, "e"]
    assert [r["price"] for r in out] == [1, None, 3, 4, None, 5]  # 4 of 5 numeric
    assert [r["amount"] for r in out] == ["5", "x", "7", "8", None, "q"]  # 3 of 5: stays text
    with pytest.raises(ValueError):
        C.standardize_col(df, "nope")


@pytest.mark.parametrize("value,want,ok", [
    ("29.99", "29.99", True), ("30", "30.0", True), ("1,234.567", "1234.57", True), ("abc", None, False)])
def test_cast_fraction_column(spark, value, want, ok):
    df = frame(spark, [("1.5",), ("2",), ("x",)], "v string")
    stats = {r["column"]: r for r in C.cast_statistics(df, ["v"]).collect()}["v"]
    assert stats["majority_numeric"] and not stats["all_whole"]
    got = spark.range(1).select(C.cast_like_column(F.lit(value), F.lit(True), F.lit(False)).alias("c")).first()["c"]
    assert (got["value"], got["ok"]) == (want, ok)


def test_cast_whole_and_text_columns(spark):
    one = lambda v, num, whole: spark.range(1).select(C.cast_like_column(F.lit(v), F.lit(num), F.lit(whole)).alias("c")).first()["c"]["value"]
    assert one(" 30.0 ", True, True) == "30" and one("30.5", True, True) == "30.5" and one("  text ", False, True) == "text"


def test_set_values(spark):
    df = frame(spark, [("1", "a"), ("2", "b"), ("3", "c")], "n string, s string")
    patches = spark.createDataFrame(
        [(0, "n", "9", 1), (0, "n", "8", 2), (1, "s", " z ", 3), (1, "n", "bad", 4), (7, "n", "1", 5), (0, "q", "1", 6)],
        "row_id bigint, `column` string, value string, step int")
    table, report = C.set_values(df, patches)
    assert [(r.n, r.s) for r in table.orderBy("row_id").collect()] == [("8", "a"), ("2", "z"), ("3", "c")]
    assert [r["success"] for r in report.orderBy("step").collect()] == [True, True, True, False, False, False]


def test_fill(spark):
    df = frame(spark, [("1",), ("2",), (None,), ("word",), ("4",)], "v string")
    col = lambda d: [r["v"] for r in d.orderBy("row_id").collect()]
    for lazy, strategy in ((C.fill_mean, "mean"), (C.fill_median, "median")):
        want = [1, 2, 2.33, 2.33, 4] if strategy == "mean" else [1, 2, 2, 2, 4]
        assert col(lazy(df, "v")) == want and col(C.fill_missing(df, "v", strategy)[0]) == want
    assert col(C.fill_mode(df, "v")) == ["1", "2", "1", "word", "4"] == col(C.fill_missing(df, "v", "mode")[0])
    assert col(C.fill_missing(df, "v", "drop")[0]) == ["1", "2", "word", "4"]


def test_fill_errors(spark):
    words = frame(spark, [("a",), (None,)], "v string")
    empty = frame(spark, [(None,), (None,)], "v string")
    for d, column, strategy, text in ((words, "v", "mean", "Cannot compute mean"), (words, "v", "median", "Cannot compute median"),
                                      (empty, "v", "mode", "No mode"), (words, "q", "mean", "not found"), (words, "v", "zero", "Unknown")):
        same, result = C.fill_missing(d, column, strategy)
        assert same is d and not result.success and text in result.error
        assert C.check_fill(d, column, strategy) == result
    assert C.check_fill(words, "v", "mode").success and C.check_fill(words, "v", "drop").success


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, 4.0], [5.0] * 50 + [1.0, 9.0], [1e-9, 1.0, 1e12, 1e300, -1e300, 0.0, 3.0], [7.0],
    [random.Random(1).gauss(0, 1) for _ in range(801)], [1.0] * 40 + [2.0] * 40,
    [random.Random(2).choice([1.0, 2.0, 1e6]) for _ in range(200)],
])
def test_exact_median_narrows(spark, monkeypatch, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    extra = df.unionByName(spark.createDataFrame([(float("inf"),), (None,)], "v double"))
    for accuracy in (10_000, 5, 2):
        monkeypatch.setattr(C, "MEDIAN_ACCURACY", accuracy)
        assert C.exact_median(extra, F.col("v")) == pytest.approx(statistics.median(values), rel=1e-12)
    assert C.exact_median(df.limit(0), F.col("v")) is None


def test_medians_of_all_columns_and_missed_brackets(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), None if i else 4.5, None) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(9)
    want = {"a": statistics.median(r[0] for r in rows), "b": statistics.median(r[1] for r in rows), "c": 4.5, "d": None}
    assert C.exact_medians(df, {c: F.col(c) for c in "abcd"}) == want
    # a bracket that misses the middle is opened
    real = C._at_middle
    moved = lambda x, b: real(x, {i: (low + 5, high + 5, n) if low > float("-inf") else (low, high, n) for i, (low, high, n) in b.items()})
    monkeypatch.setattr(C, "_at_middle", moved)
    assert C.exact_medians(df, {c: F.col(c) for c in "abcd"}) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_category_index_equals_comparison_of_all(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randrange(n)))
    domain, texts = sorted({word(8) for _ in range(60)}), [word(9) for _ in range(300)] + ["", " ", "a", None, "abc" * 30]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id int, c string, value string")
    names = spark.createDataFrame([(d,) for d in domain] + [(None,), (domain[-1],)], "c string")

    def want(t):
        if t is None:
            return None
        near = min(((edits(t.strip(), d), d) for d in domain), default=(9, ""))
        return near[1] if near[0] <= most else t

    for given in (names, domain):
        got = {r.row_id: r.c for r in C.fix_categories(df, "c", given, most).collect()}
        assert got == {i: want(t) for i, t in enumerate(texts)}
    empty = C.fix_categories(df, "c", names.filter("false"), most).collect()
    assert {r.row_id: r.c for r in empty} == dict(enumerate(texts))


def test_categories(spark):
    wrong = [(w, right) for right, ws in I.TYPO_MAP.items() for w in ws]
    df = frame(spark, [(w, r) for w, r in wrong] + [(" Food ", "Food"), ("Unrelated", "Unrelated"), (None, None)], "c string, want string")
    domain = list(I.TYPO_MAP)
    assert C.fix_categories(df, "c", domain).filter(~F.col("c").eqNullSafe(F.col("want"))).isEmpty()
    many = domain + [f"zzzzzzzzzzzzzz{i}" for i in range(60)]
    assert C.fix_categories(df, "c", many).filter(~F.col("c").eqNullSafe(F.col("want"))).isEmpty()


def test_outliers(spark):
    df = frame(spark, [("-5",), ("100",), ("1,500",), ("9000",), ("word",)], "amount string")
    assert [r.amount for r in C.handle_outliers(df, "amount", 0, 2000).orderBy("row_id").collect()] == ["100", "1,500", "word"]
    assert [r.amount for r in C.handle_outliers(df, "amount", 0, 2000, "cap").orderBy("row_id").collect()] == [0, 100, 1500, 2000, None]
    z = C.zscore_outliers(frame(spark, [(1.0,)] * 50 + [(100.0,)], "x double"), "x")
    assert [r.row_id for r in z.filter("is_outlier").collect()] == [50]
    flat = C.zscore_outliers(frame(spark, [(1.0,)] * 3, "x double"), "x")
    assert flat.filter("is_outlier").isEmpty()
    with pytest.raises(ValueError):
        C.handle_outliers(df, "amount", 0, 1, "squash")


@pytest.mark.parametrize("kind, draw", [
    ("string", lambda r: r.choice(["a", "b", "c", None])),
    ("string", lambda r: "hot" if r.random() < 0.02 else str(r.random())),
    ("string", lambda r: str(r.randrange(4000))),
    ("double", lambda r: r.choice([0.0, -0.0, float("nan"), 1.5]) if r.random() < 0.1 else r.random()),
    ("bigint", lambda r: None),
    ("decimal(6,2)", lambda r: Decimal(r.randrange(3))),
])
def test_mode_as_counted(spark, kind, draw):
    rng = random.Random(3)
    cells = [draw(rng) for _ in range(20000)]
    counts = Counter(c for c in cells if c is not None and c == c)
    want = min(counts, key=lambda c: (-counts[c], c)) if counts else None
    df = spark.createDataFrame([(c,) for c in cells], f"x {kind}").repartition(6)
    assert C.exact_mode(df, "x") == want


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "z"]], "x string")
    assert C.exact_mode(df, "x") == "a" and C.exact_mode(df.filter("x = 'q'"), "x") is None


def test_frequent_mode_counts_no_other_value(spark, monkeypatch):
    monkeypatch.setattr(C, "most_frequent", None)  # the count of all values is not asked for
    df = spark.range(100000).select(F.when(F.col("id") % 50 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("x"))
    assert C.exact_mode(df, "x") == "hot"


@pytest.mark.parametrize("counts", [(40, 30, 20, 25), (700, 600, 900, 50), (3000, 1, 1, 1)])
def test_counted_errors_as_picked_one_by_one(spark, counts):
    rng = random.Random(4)
    df = frame(spark, [(rng.choice(["a", "b", None]), str(i), rng.choice([" c", "d"])) for i in range(1000)], "x string, y string, z string")
    kinds = [(I.WORD, ("x", "y")), (I.NULL, ("y", "z")), (I.WHITESPACE, ("x", "z")), (I.FUTURE_DATE, ("x",))]
    errors = [I.CountError(kind, columns, k) for (kind, columns), k in zip(kinds, counts)]
    shut = spark.createDataFrame([(i, "x") for i in range(0, 1000, 9)], "row_id bigint, column string")
    want, taken = [], shut
    for n, e in enumerate(errors):
        cells = I.pick_cells(df, e.columns, e.k, 50 + n, exclude=taken, filled=e.kind == I.WHITESPACE).collect()
        want += [(e.kind, r.row_id, r.column, r.clean_value) for r in cells]
        taken = taken.unionByName(spark.createDataFrame([(r.row_id, r.column) for r in cells] or [], "row_id bigint, column string"))
    dirty, truth = I.inject_counts(df, errors, 50, exclude=shut)
    assert sorted(map(repr, want)) == sorted(repr((r.kind, r.row_id, r.column, r.clean_value)) for r in truth.collect())
    assert dirty.count() == 1000
