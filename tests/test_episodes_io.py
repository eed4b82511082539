import pytest
from pyspark.sql import functions as F

from scourframe.operators import clean as C
from scourframe.operators import episodes as E
from scourframe.sources import readwrite as S
from scourframe.streaming import stateless

SCHEMA = "episode_id string, task_id string, step int, command string, score double, dropped_protected boolean, initial_dirty int"


def log_of(spark, episodes):
    rows = []
    for name, task, steps in episodes:
        for s, step in enumerate(steps):
            command, score, *rest = step
            rows.append((name, task, s, command, score, bool(rest and rest[0]), 29))
    return spark.createDataFrame(rows, SCHEMA)


def test_rewards(spark):
    log = log_of(spark, [
        ("same", "easy", [(None, 0.9425), ("SET_VALUE", 0.9425)]),
        ("one", "easy", [(None, 0.9425), ("SET_VALUE", 0.9450)]),
        ("cross", "easy", [(None, 0.9), ("SET_VALUE", 0.94), ("SET_VALUE", 0.9475), ("SET_VALUE", 0.95)]),
        ("prot", "medium", [(None, 0.5), ("DROP_ROW", 0.5, True)]),
        ("early", "easy", [(None, 0.9425), ("DONE", 0.9425)]),
        ("right", "easy", [(None, 0.96), ("DONE", 0.96)]),
        ("low", "easy", [(None, 0.9), ("SET_VALUE", 0.1)]),
    ])
    last = {}
    for r in E.step_rewards(log).orderBy("episode_id", "step").collect():
        assert (r.reward is None) == (r.step == 0)
        last[r.episode_id] = (r.reward, r.done)
    assert last == {"same": (-0.005, False), "one": (-0.0025, False), "cross": (0.09, True), "prot": (-0.155, False),
                    "early": (-1.0, False), "right": (-0.005, True), "low": (-0.5, False)}


def test_done_gate(spark):
    log = log_of(spark, [("e", "easy", [(None, 0.9425), ("DONE", 0.9425), ("SET_VALUE", 0.96), ("DONE", 0.96)])])
    broken = spark.createDataFrame([("e", c, i) for i, c in enumerate("abcdefg")], "episode_id string, `column` string, ordinal int")
    rows = E.done_gate(log, broken).orderBy("step").collect()
    assert rows[0].error == "DONE rejected: score 0.9425 < required 0.95. Still broken: ['a', 'b', 'c', 'd', 'e']"
    assert rows[0].still_broken == list("abcdefg")
    assert (rows[0].accepted, rows[0].reward, rows[0].issues_remaining) == (False, -1.0, 29 - int(0.9425 * 29))
    assert (rows[1].accepted, rows[1].error, rows[1].done, rows[1].issues_remaining) == (True, None, True, 0)
    assert E.done_gate(log).orderBy("step").first().error.endswith("[]")


def test_termination_and_summary(spark):
    slow = [(None, 0.5)] + [("SET_VALUE", 0.5)] * 39 + [("DONE", 0.5), ("SET_VALUE", 0.5)]  # a refused DONE at step 40
    log = log_of(spark, [
        ("slow", "easy", slow),
        ("quick", "hard", [(None, 0.2), ("STANDARDIZE_COL", 0.7), ("DROP_ROW", 0.8), ("DROP_ROW", 0.9)]),
        ("open", "medium", [(None, 0.1), ("SET_VALUE", 0.2)]),
    ])
    ends = {r.episode_id: (r.end_step, r.solved) for r in E.termination(log).collect()}
    assert ends == {"slow": (41, False), "quick": (2, True)}
    summary = {r.episode_id: r for r in E.episode_summary(log, rewards=True).collect()}
    assert (summary["quick"].success, summary["quick"].steps, summary["quick"].score) == (True, 2, 0.8)
    assert summary["quick"].rewards == [0.495, pytest.approx(0.1937, abs=1e-4)]
    assert (summary["slow"].success, summary["slow"].steps, len(summary["slow"].rewards)) == (False, 41, 41)
    seen = {r.episode_id: r for r in E.episode_summary(log, "runner_steps", rewards=True).collect()}
    assert (seen["slow"].success, seen["slow"].steps, len(seen["slow"].rewards)) == (False, 25, 25)
    assert seen["slow"].total_reward == pytest.approx(-0.125)
    state = {r.episode_id: r for r in E.current_state(log).collect()}
    assert state["open"].steps_remaining == 79 and not state["open"].is_solved and state["quick"].is_solved
    assert E.cut_at_terminal(log).filter("episode_id = 'quick'").count() == 3
    position = E.step_position(log).filter("episode_id = 'open'").orderBy("step").collect()
    assert [(r.step_number, r.remaining) for r in position] == [(1, 80), (2, 79)]


def test_limits(spark):
    tasks = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "task_id string")
    rows = {r.task_id: (r.threshold, r.max_steps, r.runner_steps) for r in E.with_limits(tasks).collect()}
    assert rows == {"easy": (0.95, 40, 25), "medium": (0.85, 80, 50), "hard": (0.8, 150, 80)}


def test_recent(spark):
    log = log_of(spark, [("e", "easy", [(None, 0.1)] + [(c, 0.1) for c in "abcdefgh"])])
    rows = E.recent_actions(log).orderBy("step").collect()
    assert rows[0].recent == [] and rows[3].recent == ["a", "b"] and rows[8].recent == list("bcdefg")


def test_csv_keeps_padding_quotes_and_missing(spark, tmp_path):
    rows = [(0, "  a  ", "b"), (1, None, 'q"uo,te'), (2, "N/A", "nan")]
    df = spark.createDataFrame(rows, "row_id bigint, x string, y string")
    path = str(tmp_path / "csv")
    S.write_csv(df, path)
    back = S.read_raw(spark, path, S.ROW_INDEX, "csv", [S.ROW_INDEX, "x", "y"])
    assert sorted(tuple(r) for r in back.collect()) == rows
    line = open(next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")).readline()
    assert line.strip() == "row_index,x,y"
    multi = spark.createDataFrame([(0, "a\nb")], "row_id bigint, x string")
    S.write_csv(multi, path + "m")
    assert S.read_raw(spark, path + "m", S.ROW_INDEX, "csv", [S.ROW_INDEX, "x"], multi_line=True).first().x == "a\nb"
    with pytest.raises(ValueError):
        S.read_raw(spark, path, fmt="csv")


def test_parquet_raw_snapshot_preview(spark, tmp_path):
    df = spark.createDataFrame([(i, float("nan") if i == 1 else float(i)) for i in range(30)], "id bigint, v double")
    df.write.parquet(str(tmp_path / "t"))
    raw = S.read_raw(spark, str(tmp_path / "t"), "id")
    assert dict(raw.dtypes)["v"] == "string" and raw.filter(F.col("v").isNull()).count() == 1
    S.snapshot(raw, str(tmp_path / "s"), 3)
    assert S.read_snapshot(spark, str(tmp_path / "s"), 3).count() == 30
    assert [r.row_id for r in S.preview(raw).collect()] == list(range(20))


def test_stream_cleans_like_a_batch(spark, tmp_path):
    rows = [(i, f" n{i} ", "N/A" if i % 3 == 0 else f"{i}.5", f"0{i % 9 + 1}/15/2023") for i in range(20)]
    schema = "row_id bigint, name string, price string, order_date string"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    kinds = C.standardize_plan(batch, ["name", "order_date"])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    clean = stateless.fill_stream(stateless.standardize_stream(stream, kinds), {"price": 9.99})
    q = clean.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = C.standardize_cols(batch, list(kinds), kinds=kinds).collect()
    got = {r.row_id: r for r in spark.table("cleaned").collect()}
    assert len(got) == 20
    for r in want:
        assert (got[r.row_id].name, got[r.row_id].order_date) == (r.name, r.order_date)
        assert got[r.row_id].price == (9.99 if r.row_id % 3 == 0 else r.row_id + 0.5)
