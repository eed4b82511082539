import random

import pytest
from pyspark.sql import functions as F

from scourframe.operators import grade as Q
from scourframe.operators import merge as M
from scourframe.operators import ordering as O


def test_positions_with_sparse_ids(spark):
    ids = sorted(random.Random(3).sample(range(1 << 45), 200))
    df = spark.createDataFrame([(i,) for i in ids], "row_id bigint")
    for bits in (4, 20, 40, 50):
        got = O.with_position(df, bits=bits).orderBy("position").collect()
        assert [(r.row_id, r.position) for r in got] == [(v, i) for i, v in enumerate(ids)]


@pytest.mark.parametrize("bits", [5, 20])
def test_rows_at_positions(spark, bits):
    ids = list(range(0, 3000, 7))
    df = spark.createDataFrame([(i,) for i in ids], "row_id bigint")
    wanted = spark.createDataFrame([(0,), (5,), (428,), (99999,), (5,)], "position bigint")
    want = {(0, 0), (5, 35), (428, 2996)}
    assert {tuple(r) for r in O.rows_at_positions(df, wanted, bits=bits).collect()} == want


def hot_log(n=60):
    rng = random.Random(4)
    rows, step = [], {}
    for _ in range(n):
        g = "hot" if rng.random() < 0.6 else rng.choice("abc")
        step[g] = step.get(g, -1) + rng.choice([1, 1, 2, 9])
        rows.append((g, step[g], round(rng.random(), 3) if rng.random() < 0.9 else None, rng.choice(["x", "y", None])))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_windows_over_hot_and_small_groups(spark, parts):
    rows = hot_log()
    df = spark.createDataFrame(rows, "g string, step int, v double, c string")
    w = (O.GroupWindow(df, ["g"], "step", parts).lag("prev", "v").row_number("rn").first_where("hit", F.col("v") > 0.8))
    got = {(r.g, r.step): (r.prev, r.rn, r.hit) for r in w.result().collect()}
    recent = {(r.g, r.step): r.recent for r in O.recent_items(df, ["g"], "step", "c", 3, "recent", parts).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        for i, r in enumerate(mine):
            hits = [x[1] for x in mine[: i + 1] if x[2] is not None and x[2] > 0.8]
            assert got[(g, r[1])] == (mine[i - 1][2] if i else None, i + 1, min(hits) if hits else None)
            assert recent[(g, r[1])] == [x[3] for x in mine[max(0, i - 3): i] if x[3] is not None]


def brute_near(rows, pct):
    out = {}
    for i, k, a in rows:
        for j, k2, b in rows:
            if j < i and k == k2 and a is not None and b is not None and abs(round(a * 100) - round(b * 100)) <= pct * abs(round(b * 100)) + 0.5 + 1e-9:
                out[i] = min(out.get(i, j), j)
    return {(j, i) for i, j in out.items()}


@pytest.mark.parametrize("pct,spread", [(0.01, 40), (0.05, 3), (0.01, 0.5), (0.0001, 20)])
def test_near_duplicates_equal_brute_force(spark, pct, spread):
    rng = random.Random(int(pct * 1e4 + spread))
    rows = [(i, rng.choice(["hot", "hot", "k", None]), round(100 + rng.random() * spread, 2)) for i in range(150)]
    rows += [(150 + i, "hot", 100.5 * 1.01 + 0.005) for i in range(2)] + [(152, "hot", 100.5), (153, "hot", 0.0), (154, "hot", 0.0), (155, "k", -50.0), (156, "k", -50.2), (157, "k", 50.0), (158, "k", None), (159, "k", None)]
    rows = [(i, k, None if a is None else round(a, 2)) for i, k, a in rows]
    df = spark.createDataFrame(rows, "row_id bigint, k string, amount double")
    got = {tuple(r) for r in M.near_duplicates(df, ["k"], "amount", pct).collect()}
    assert got == brute_near(rows, pct)
    kept = {r.row_id for r in M.dedup_near(df, ["k"], "amount", pct).collect()}
    assert kept == {r[0] for r in rows} - {d for _, d in got}


def test_exact_copies_keep_the_lowest_id(spark):
    rows = [(5, "a", 1), (2, "a", 1), (9, None, 1), (3, None, 1), (4, "b", 2)]
    df = spark.createDataFrame(rows, "row_id bigint, k string, n int")
    assert sorted(r.row_id for r in M.dedup_exact(df).collect()) == [2, 3, 4]
    assert sorted(r.row_id for r in M.dedup_by_key(df, ["n"]).collect()) == [2, 4]
    assert {tuple(r) for r in M.duplicate_pairs(df, ["k", "n"]).collect()} == {(2, 5), (3, 9)}


def test_union_refuses_to_merge_names_that_differ_by_case(spark):
    a = spark.createDataFrame([(1, "x")], "id int, currency string")
    b = spark.createDataFrame([(2, "y")], "id int, Currency string")
    with pytest.raises(ValueError, match="case"):
        M.union_ragged([a, b])
    spark.conf.set(M.CASE_CONF, "true")
    try:
        assert M.union_ragged([a, b]).columns == ["id", "currency", "Currency"]
        both = M.union_ragged([a, b])
        sources = {"s": {"currency": "Currency"}}
        assert sorted(r.currency for r in M.coalesce_aliases(both, sources, ["currency"], ["id"]).collect()) == ["x", "y"]
    finally:
        spark.conf.set(M.CASE_CONF, "false")


def test_schema_and_dedup_scores(spark):
    canonical = ["a", "b", "c"]
    assert Q.schema_score(["a", "b", "c"], canonical)["score"] == 1.0
    assert Q.schema_score(["a", "b", "c", "x"], canonical)["score"] == 1.0
    assert Q.schema_score(["a", "x"], canonical)["score"] == pytest.approx(1 / 3)
    score = lambda rows: spark.range(1).select(Q.dedup_score(F.lit(rows), 400)["f1"].alias("f")).first().f
    assert score(430) == 0 and score(400) == pytest.approx(1, abs=1e-6) and score(415) == pytest.approx(2 / 3, abs=1e-6)
    assert score(395) == pytest.approx(2 * (25 / 35) / (25 / 35 + 1), abs=1e-6) and score(300) == 0
    assert Q.date_column(["x", "PurchaseDate"]) == "PurchaseDate" and Q.date_column(["x"]) is None
    none = Q.score_hard(spark.createDataFrame([(0, "x")], "row_id bigint, q string"), 400, canonical).first()
    assert none.breakdown.fmt_date_col_found is False and none.breakdown.format_score == 0


@pytest.mark.parametrize("k", [0, 1, 50, 997, 1000, 2000])
def test_lowest_rows(spark, k):
    """Uniform, equal and clustered hashes."""
    rng = random.Random(k)
    for draw in (lambda: rng.randrange(1 << 32), lambda: 77, lambda: (5 << 20) + rng.randrange(300), lambda: rng.choice([0, (1 << 32) - 1])):
        rows = [(i, draw()) for i in range(1000)]
        got = O.lowest(spark.createDataFrame(rows, "row_id bigint, h bigint"), F.col("h"), ["row_id"], k).collect()
        assert sorted(r.row_id for r in got) == sorted(i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:k])


@pytest.mark.parametrize("parts", [1, 6, 30])
def test_running_minima_over_borders(spark, parts):
    rows = hot_log(90)
    df = spark.createDataFrame(rows, "g string, step int, v double, c string")
    w = O.GroupWindow(df, ["g"], "step", parts).running_min("low", F.col("v")).following_min("later", F.col("v")).running_sum("n", F.when(F.col("c") == "x", 1))
    for r in w.result().collect():
        mine = sorted(x for x in rows if x[0] == r.g)
        before, after = [x for x in mine if x[1] <= r.step], [x for x in mine if x[1] >= r.step]
        assert r.low == min((x[2] for x in before if x[2] is not None), default=None)
        assert r.later == min((x[2] for x in after if x[2] is not None), default=None)
        assert r.n == sum(x[3] == "x" for x in before)
