import random

import pytest
from pyspark.sql import functions as F

from scourframe.operators import actions as A
from scourframe.operators import ordering as O
from scourframe.plans import datasets as D
from scourframe.plans.cleaning_plan import CleaningPlan

COLUMNS = ["order_id", "price", "quantity", "order_date"]


def test_validation(spark):
    rows = [
        ("SET_VALUE", 3, "price", "29.99", None, None), ("DROP_ROW", 17, None, None, None, None),
        ("FILL_MISSING", None, "quantity", None, "median", None), ("STANDARDIZE_COL", None, "order_date", None, None, None),
        ("DONE", None, None, None, None, None), ("SET_VALUE", None, "price", "10.0", None, "SET_VALUE requires: row_index"),
        ("SET_VALUE", None, None, None, None, "SET_VALUE requires: row_index, column, value"),
        ("FILL_MISSING", None, "price", None, None, "FILL_MISSING requires: fill_strategy"),
        ("DROP_ROW", None, None, None, None, "DROP_ROW requires row_index"),
        ("STANDARDIZE_COL", None, None, None, None, "STANDARDIZE_COL requires column"),
        ("DROP_ROW", -1, None, None, None, "row_index must be >= 0, got -1"),
        ("STANDARDIZE_COL", None, "", None, None, "column must not be empty"),
        ("FILL_MISSING", None, "price", None, "Mean", "fill_strategy must be one of: mean, median, mode, drop"),
        ("JUMP", None, None, None, None, "command must be one of: SET_VALUE, DROP_ROW, STANDARDIZE_COL, FILL_MISSING, DONE"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, command string, row_index bigint, `column` string, value string, fill_strategy string, want string")
    for r in A.validate_actions(df).orderBy("i").collect():
        assert r.error == r.want and r.valid == (r.want is None)


DONE = ("DONE", None, None, None, None)


@pytest.mark.parametrize("raw,want", [
    ('{"action":"SET_VALUE","row":3,"column":"price","value":"29.99"}', ("SET_VALUE", 3, "price", "29.99", None)),
    ('```json\n{"action":"DROP_ROW","row":5}\n```', ("DROP_ROW", 5, None, None, None)),
    ('```\n{"action":"DROP_ROW","row":5}', ("DROP_ROW", 5, None, None, None)),
    ('I think {"action":"drop","row_index":"7"} is best', ("DROP_ROW", 7, None, None, None)),
    ('{"action":"standardize","column":"ORDER_DATE"}', ("STANDARDIZE_COL", None, "order_date", None, None)),
    ('{"action":"fill missing","column":"price","strategy":"average"}', ("FILL_MISSING", None, "price", None, "median")),
    ('{"action":"FILL_MISSING","column":"price","strategy":"Mean"}', DONE),
    ('{"action":"FILL_MISSING","column":"price","strategy":null,"fill_strategy":"mode"}', ("FILL_MISSING", None, "price", None, "mode")),
    ('{"action":"FILL_MISSING","column":"nope","strategy":"mean"}', DONE),
    ('{"action":"DROP_ROW","row":null,"row_index":4}', ("DROP_ROW", 4, None, None, None)),
    ('{"action":"DROP_ROW","row":"x","row_index":4}', DONE),
    ('{"action":"DROP_ROW","row":7.9}', ("DROP_ROW", 7, None, None, None)),
    ('{"action":"DROP_ROW","row":true}', ("DROP_ROW", 1, None, None, None)),
    ('{"action":"DROP_ROW","row":-2}', DONE),
    ('{"action":"SET_VALUE","row":1,"column":"price","value":10}', ("SET_VALUE", 1, "price", "10", None)),
    ('{"action":"SET_VALUE","row":1,"column":"price","value":10.50}', ("SET_VALUE", 1, "price", "10.5", None)),
    ('{"action":"SET_VALUE","row":1,"column":"price","value":10.0}', ("SET_VALUE", 1, "price", "10.0", None)),
    ('{"action":"SET_VALUE","row":1,"column":"price","value":false}', ("SET_VALUE", 1, "price", "False", None)),
    ('{"action":"SET_VALUE","row":1,"column":"price","value":null}', DONE),
    ('{"action":"SET_VALUE","row":1,"column":"price","value":"1.50"}', ("SET_VALUE", 1, "price", "1.50", None)),
    ('{"action":"jump"}', DONE), ('{"action": broken}', DONE), ("", DONE), ("no json", DONE), (None, DONE),
    ('{"a":{"action":"DROP_ROW","row":2}}', ("DROP_ROW", 2, None, None, None)),
    ('{"column":"price"}', DONE),
])
def test_parse(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = A.parse_responses(df, "raw", COLUMNS).first()
    assert (r.command, r.row_index, r.column, r.value, r.fill_strategy) == want


def simulate(n, actions):
    """Places of rows by deleting from a list."""
    live, out = list(range(n)), []
    for command, p in actions:
        ok = p < len(live)
        out.append(live[p] if ok else None)
        if ok and command == "DROP_ROW":
            live.pop(p)
    return out


def test_positions(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for e in range(6):
        acts = [(rng.choice(["DROP_ROW", "SET_VALUE"]), rng.randrange(45)) for _ in range(50 if e else 160)]
        places = simulate(40, acts)
        for i, (c, p) in enumerate(acts):
            rows.append((str(e), i + 1, c, p))
            want[(str(e), i + 1)] = places[i]
    log = spark.createDataFrame(rows, "episode_id string, step int, command string, row_index bigint")
    for r in A.resolve_positions(log, F.lit(40)).collect():
        assert r.position == want[(r.episode_id, r.step)] and r.executed
    for r in A.resolve_positions(log, F.lit(40), 150).collect():
        assert r.position == (want[(r.episode_id, r.step)] if r.step <= 150 else None) and r.executed == (r.step <= 150)


@pytest.mark.parametrize("rows", [20, 300, 1 << 17])
def test_positions_of_a_hot_episode(spark, rows):
    """A third of the log and more in one episode, over many range partitions and over one."""
    rng = random.Random(rows)
    log, want = [], {}
    for e, n in ((None, 50), ("hot", 700), ("a", 90), ("b", 60)):
        steps = sorted(rng.sample(range(10**6), n))
        acts = [(rng.choice(["DROP_ROW", "SET_VALUE"]), rng.choice([rng.randrange(420), 0, 399])) for _ in steps]
        for s, (c, p), place in zip(steps, acts, simulate(400, acts)):
            log.append((e, s, p, c == "DROP_ROW"))
            want[e, s] = place
    ops = spark.createDataFrame(log, "e string, s int, q bigint, gone boolean").repartition(7)
    out = O.positions_before_drops(ops, ["e"], "s", "q", "gone", "origin", rows)
    assert {(r.e, r.s): r.origin if r.origin < 400 else None for r in out.collect()} == want


def test_a_long_log_is_applied_whole(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(200)], "row_id bigint, num string")
    plan = CleaningPlan()
    for i in range(160):
        plan.set_value(i, "num", str(1000 + i))
    log = plan.to_log(spark)
    out = A.apply_actions(df, log)
    assert out.report.filter("success").count() == 160
    assert out.table.filter("cast(num as int) >= 1000").count() == 160
    cut = A.apply_actions(df, log, budget=150)
    late = cut.report.filter("step > 150").collect()
    assert len(late) == 10 and not any(r.success for r in late) and cut.table.filter("cast(num as int) >= 1000").count() == 150
    two = log.unionByName(CleaningPlan("other").drop_row(0).to_log(spark))
    with pytest.raises(ValueError, match="several episodes"):
        A.apply_actions(df, two)
    assert A.apply_actions(df, two, episode_id="other").table.count() == 199
    with pytest.raises(ValueError, match="repeats"):
        A.apply_actions(df, log.unionByName(log))


def test_apply_a_plan_to_the_dirty_orders(spark):
    ds = D.load_dataset(spark, "easy")
    plan = CleaningPlan()
    for c in ("price", "quantity", "order_date", "customer", "product", "category", "region"):
        plan.standardize_col(c)
    plan.fill_missing("price", "median").fill_missing("quantity", "median").fill_missing("region", "mode")
    plan.set_value(0, "DOES_NOT_EXIST", "0").set_value(9999, "price", "10.0").fill_missing("region", "zero").done()
    out = plan.apply(ds.dirty)
    report = out.report.orderBy("step").collect()
    assert [r.success for r in report] == [True] * 10 + [False] * 3 + [True]
    assert "not found" in report[10].error and "out of range" in report[11].error
    before, after = D.grade("easy", ds.dirty, ds).first(), D.grade("easy", out.table, ds).first()
    assert after.score >= before.score and out.table.count() == 50


def test_apply_runs_of_edits(spark):
    rng = random.Random(8)
    ids = [i * 3 for i in range(30)]
    df = spark.createDataFrame([(i, str(i), "t") for i in ids], "row_id bigint, num string, txt string")
    plan, live = CleaningPlan(), {i: [str(i), "t"] for i in ids}
    want = []
    for n in range(30):
        p, order = rng.randrange(33), sorted(live)
        if n in (10, 20):
            plan.standardize_col("txt")
            want.append(True)
        elif rng.random() < 0.5:
            plan.drop_row(p)
            want.append(p < len(order))
            if p < len(order):
                del live[order[p]]
        else:
            value = rng.choice(["77", "bad", "88.256"])
            plan.set_value(p, "num", value)
            ok = p < len(order) and value != "bad"
            want.append(ok)
            if ok:
                live[order[p]][0] = value if value == "77" else "88.26"
    protected = spark.createDataFrame([("0",), ("30",)], "num string")
    out = plan.apply(df, protected=protected, protected_key="num")
    assert [r.success for r in out.report.orderBy("step").collect()] == want
    got = {r.row_id: [r.num, r.txt] for r in out.table.collect()}
    number = lambda v: float(v)
    assert {k: number(v[0]) for k, v in got.items()} == {k: number(v[0]) for k, v in live.items()}


def test_protected_drop_is_flagged(spark):
    ds = D.load_dataset(spark, "medium")
    extreme = ds.truth["valid_extreme_rows"].first().row_id
    keys = ds.truth["valid_extreme_rows"].join(ds.clean, "row_id").select(F.col("tx_id").cast("string").alias("tx_id"))
    plan = CleaningPlan().drop_row(extreme).drop_row(0 if extreme else 5)
    report = plan.apply(ds.dirty, protected=keys, protected_key="tx_id").report.orderBy("step").collect()
    assert report[0].dropped_protected and report[0].success


def test_row_in_range(spark):
    log = spark.createDataFrame([(0,), (2,), (3,), (-1,), (None,)], "row_index bigint")
    assert [r.in_range for r in A.row_in_range(log, spark.range(3)).collect()] == [True, True, False, False, None]
