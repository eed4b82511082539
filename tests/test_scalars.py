import pytest
from pyspark.sql import functions as F

from scourframe.functions import hashing as H
from scourframe.functions import names as N
from scourframe.functions import scalars as X


def each(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_numbers(spark):
    given = [" 12 ", "1,000", "1e3", "+5", ".5", "5.", "N/A", "-", "", "5d", "0x10", "inf", "nan", "1_000", None, "-2.5E-1"]
    assert each(spark, X.to_numeric, given) == [12, None, 1000, 5, 0.5, 5, None, None, None, None, None, None, None, None, None, -0.25]
    assert each(spark, X.safe_float, ["1,000", " 2,5 ", "x", None]) == [1000, 25, None, None]
    assert each(spark, X.numeric_text, [" 12 ", "1,000", "1e3", ".5", "N/A", None, "0.125", "-0"]) == [
        "12.00", "1000.00", "1000.00", "0.50", "__INVALID__", "__NAN__", "0.12", "0.00"]
    assert each(spark, X.try_int, ["7", " 7 ", "-3", "7.5", "x", None, "99999999999999999999"]) == [7, 7, -3, None, None, None, None]


def test_strict_dates(spark):
    given = ["2023-04-15", "2023-4-5", "04/15/2023", "05/04/2023", "15/04/2023", "15.04.2023", "05.04.2023", "2023/04/15",
             "2099-01-15", "2023-02-30", "13/13/2023", "N/A", " 2023-04-15 ", None, "1/2/2300", "1600-01-01", "99-1-1", "04/31/2023"]
    want = ["2023-04-15", "2023-04-05", "2023-04-15", "2023-05-04", "2023-04-15", "2023-04-15", "2023-04-05", "2023-04-15",
            "2099-01-15", "2023-02-30", "13/13/2023", "N/A", "2023-04-15", None, "1/2/2300", "1600-01-01", "99-1-1", "04/31/2023"]
    assert each(spark, X.normalise_dates, given) == want


def test_guessed_dates(spark):
    given = ["20230415", "Apr 15 2023", "april 15, 2023", "15 Apr 2023", "15-APR-2023", "2023", "2023-04", "04/2023", "Apr 2023",
             "2023-04-15 10:00:00", "2023-04-15T10:00:00Z", "05-04-2023", "15-04-2023", "2023.04.15", "2035-07-01 10:00", "Aprx 1 2023", "12", "May 3 2023"]
    want = ["2023-04-15"] * 5 + ["2023-01-01"] + ["2023-04-01"] * 3 + ["2023-04-15"] * 2 + [
        "2023-05-04", "2023-04-15", "2023-04-15", "2035-07-01 10:00", "Aprx 1 2023", "12", "2023-05-03"]
    assert each(spark, X.normalise_dates, given) == want


def test_date_text(spark):
    given = ["2023-04-15", "05/04/2023", "05.04.2023", "15.04.2023", "2099-01-15", "2023-02-30", "N/A", None, "1999-12-31", "2030-01-01", "1500-01-01"]
    want = ["2023-04-15", "2023-05-04", "2023-05-04", "2023-04-15", "__BAD_DATE__", "__INVALID_DATE__", "__INVALID_DATE__",
            "__NAN__", "__BAD_DATE__", "2030-01-01", "__INVALID_DATE__"]
    assert each(spark, X.date_text, given) == want


def test_strip_and_iso(spark):
    assert each(spark, X.strip, ["  x y　\t", "  ", None, "\x1cq"]) == ["x y", "", None, "q"]
    assert each(spark, X.valid_iso, ["2023-01-01", " 2030-12-31 ", "2031-01-01", "1999-01-01", "01/01/2023", None]) == [
        True, True, False, False, False, False]
    assert each(spark, X.year_prefix, ["2099-01-01", "20x9", "99", None]) == [2099, None, 99, None]
    assert each(spark, lambda c: X.zero_padded(c, 3), ["7", "1234"]) == ["007", "1234"]
    assert each(spark, lambda c: X.lookup({"a": "b"}, c, F.lit("z")), ["a", "q", None]) == ["b", "z", "z"]
    assert each(spark, lambda c: X.clip(X.to_numeric(c), 1.0, 2.0), ["0", "1.5", "9", "x"]) == [1, 1.5, 2, None]


def test_names():
    assert N.name_hints(["order_date", "country", "region", "Amount"]) == {
        "order_date": "date", "country": "numeric", "region": None, "Amount": "numeric"}
    assert N.name_hints(["country", "item_count"], whole_token=True) == {"country": None, "item_count": "numeric"}
    with pytest.raises(ValueError, match="not found"):
        N.require_columns(type("D", (), {"columns": ["a"]})(), ["b"])


def test_hash_is_uniform_and_independent(spark):
    k = F.col("id")
    df = spark.range(20000).select(
        H.hash_unit(k, 1).alias("u"), H.hash_unit(k, 2).alias("v"), H.hash_int(k, 3, 5, 9).alias("i"),
        H.hash_choice(k, 4, ["a", "b", "c"]).alias("c"), H.hash_normal(k, 5, 150.0, 60.0).alias("n"),
        H.random_date(k, 8, "2023-01-01", "2023-01-04").cast("string").alias("d"), H.selected(k, 9, 0.25).alias("s"),
    )
    r = df.agg(F.avg("u"), F.corr("u", "v"), F.min("i"), F.max("i"), F.avg("n"), F.stddev("n"), F.countDistinct("c"),
               F.min("d"), F.max("d"), F.avg(F.col("s").cast("int"))).first()
    assert abs(r[0] - 0.5) < 0.02 and abs(r[1]) < 0.03 and (r[2], r[3]) == (5, 8)
    assert abs(r[4] - 150) < 2 and abs(r[5] - 60) < 2 and r[6] == 3
    assert (r[7], r[8]) == ("2023-01-01", "2023-01-03") and abs(r[9] - 0.25) < 0.02


def test_keys_beyond_32_bits_hash_apart(spark):
    from scourframe.functions import hashing as H

    keys = [5, 5 + 2**32, 5 + 2**33, -1, 2**62 + 5]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select(H.keyed_hash(F.col("k"), 3).alias("h")).collect()
    assert len({r.h for r in rows}) == len(keys) and all(0 <= r.h < 2**32 for r in rows)


def test_numbers_that_overflow_are_none(spark):
    row = spark.createDataFrame([("1e999", "-1e999", "1e300")], "a string, b string, c string").select(*[X.to_numeric(F.col(c)).alias(c) for c in "abc"]).first()
    assert (row.a, row.b, row.c) == (None, None, 1e300)
