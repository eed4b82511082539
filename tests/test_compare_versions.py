import random

import pytest
from pyspark.sql import functions as F

from scourframe.operators import compare
from scourframe.operators import grade as Q
from scourframe.operators import inject as I
from scourframe.sources.versions import VersionedTable

SCHEMA = "row_id bigint, a string, price string"


def tables(spark, n, changed, seed=1, step=1):
    draw = random.Random(seed)
    clean = [(i * step - 50, draw.choice(["x", " y", None, "z"]), draw.choice(["1.50", "2", None, "word"])) for i in range(n)]
    work = [list(r) for r in clean]
    for i in changed:
        work[i][draw.choice([1, 2])] = draw.choice(["1.5", None, "new", "__missing__"])
    return [tuple(r) for r in work], clean


@pytest.mark.parametrize("n, changed, step", [(3000, range(100, 120), 1), (3000, range(0, 3000, 7), 1), (500, [], 10**12), (500, [3, 499], 10**12), (0, [], 1)])
@pytest.mark.parametrize("null_equal", [True, False])
def test_ranges_count_as_the_full_join(spark, n, changed, step, null_equal):
    work, clean = tables(spark, n, changed, step=step)
    work = work[: n // 2] + work[n // 2 + 5:] + [(10**15, "extra", "1")]  # rows lost, one beyond the truth
    w, c = spark.createDataFrame(work, SCHEMA), spark.createDataFrame(clean, SCHEMA)
    want = Q.cell_match(w, c, null_equal=null_equal).collect()
    assert compare.cell_match(w, c, null_equal=null_equal).collect() == want
    assert compare.count_dirty_cells(w, c).collect() == I.count_dirty_cells(w, c).collect()


def test_only_ranges_that_differ_are_joined(spark):
    work, clean = tables(spark, 20000, [7, 8, 15000])
    w, c = (spark.createDataFrame(t, SCHEMA) for t in (work, clean))
    ranges = compare.differing_ranges(w, c, ["a", "price"], rows_per_range=64)
    assert 0 < ranges.within(w).count() <= 3 * 128
    few = compare.differing_ranges(w, c, ["a", "price"], rows_per_range=64, most_ranges=2)  # keys on both sides of zero never share a range
    assert few.differing.count() <= 2 and few.within(w).filter("row_id in (-43, 14950)").count() == 2


def test_repeated_rows_and_moved_nulls_differ(spark):
    one = spark.createDataFrame([(1, "x", None), (2, "y", "1")], SCHEMA)
    moved = spark.createDataFrame([(1, None, "x"), (2, "y", "1")], SCHEMA)
    thrice = one.unionAll(one).unionAll(one)
    for other in (moved, thrice):
        assert compare.differing_ranges(one, other, ["a", "price"], rows_per_range=1).differing.count() >= 1
    assert compare.differing_ranges(one, one, ["a", "price"]).differing.count() == 0


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_fold_to_what_was_committed(spark, tmp_path):
    draw, table = random.Random(5), VersionedTable(spark, str(tmp_path))
    with pytest.raises(ValueError):
        table.read()
    rows = {i: {"a": str(i), "b": float(i)} for i in range(60)}
    want = []
    for step in range(9):
        for _ in range(4):
            i = draw.randrange(70)
            if i in rows and draw.random() < 0.4:
                del rows[i]
            else:  # new, come again, or changed to a value or to nothing
                rows[i] = {"a": draw.choice([None, "u", "v"]), "b": draw.choice([None, float("nan"), 0.5])}
        types = {"a": "string", "b": "double"}
        if step >= 4:
            types["b"] = "string"  # another type
        if step in (2, 3, 7, 8):
            types["c"] = "int"  # comes, goes, comes again
        cells = [(i, *[None if (v := r.get(n, i)) is None else str(v) if t == "string" else v for n, t in types.items()]) for i, r in rows.items()]
        df = spark.createDataFrame(cells, "row_id bigint, " + ", ".join(f"{n} {t}" for n, t in types.items()))
        table.commit(df)
        want.append((df.columns, as_rows(df)))
    for step, (columns, cells) in enumerate(want):
        got = table.read(step)
        assert got.columns == columns and repr(as_rows(got)) == repr(cells)
    assert repr(as_rows(table.read())) == repr(want[-1][1])
    with pytest.raises(ValueError):
        table.read(9)


def test_a_version_stores_only_what_changed(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("a"), F.lit("k").alias("b"))
    table.commit(df)
    for step in range(3):
        df = df.withColumn("a", F.when(F.col("row_id") == step * 1000, F.lit("new")).otherwise(F.col("a")))
        table.commit(df)
    table.commit(df)
    assert [(v.complete, v.rows) for v in table.history()] == [(True, 5000), (False, 1), (False, 1), (False, 1), (False, 0)]
    assert table.read().filter("a = 'new'").count() == 3


def test_a_lost_write_leaves_the_last_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "x", "1"), (2, "y", "2")], SCHEMA)
    table.commit(df)
    broken = df.withColumn("a", F.when(F.col("row_id") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise("w"))
    with pytest.raises(Exception):
        table.commit(broken)
    (tmp_path / "data" / "half").mkdir()
    (tmp_path / "manifest" / "version=1" / "_temporary").mkdir(parents=True)
    assert len(table.history()) == 1 and as_rows(table.read()) == as_rows(df)
    table.commit(df.filter("row_id = 1"))
    assert table.read().count() == 1 and table.read(0).count() == 2


def test_many_changes_make_a_complete_copy(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    for step in range(4):
        table.commit(spark.createDataFrame([(i, str(step), "p") for i in range(20)], SCHEMA))
    assert [v.complete for v in table.history()] == [True, False, False, True]
    assert [table.read(s).first()["a"] for s in range(4)] == ["0", "1", "2", "3"]
