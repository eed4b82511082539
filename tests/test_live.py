import statistics

import pytest

from scourframe.operators import clean as C
from scourframe.streaming.live import LiveFill

SCHEMA = "row_id bigint, price string, size string, kind string, note string"
KINDS = {"price": "mean", "size": "median", "kind": "mode"}
PARTS = [
    [(0, "1.5", "7", "a", None), (1, "N/A", None, None, "x"), (2, None, "3", "b", ""), (3, " 2.5", "4", "b", "y")],
    [(4, None, None, None, "z"), (5, "10", "word", "a", None), (5, "10", "word", "a", None), (6, "-0.25", "100", "a", "q" * 5000)],
    [(7, None, None, None, None), (8, "inf", "nan", "", "")],
]


def number(text):
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if abs(value) < float("inf") else None


def brute(parts):
    """Every part filled row by row with the statistics of the parts before it."""
    before, out = [], []
    for i, part in enumerate(parts, 1):
        prices = [number(r[1]) for r in before if number(r[1]) is not None]
        sizes = [number(r[2]) for r in before if number(r[2]) is not None]
        kinds = [r[3] for r in before if r[3] is not None]
        center = (
            round(sum(prices) / len(prices), 2) if prices else None, round(statistics.median(sizes), 2) if sizes else None,
            min(kinds, key=lambda k: (-kinds.count(k), k)) if kinds else None,
        )
        for r in part:
            cells = (number(r[1]), number(r[2]), r[3])
            out.append((r[0], *[c if x is None else x for x, c in zip(cells, center)], r[4], [n for n, x in zip(KINDS, cells) if x is None], i))
        before += part
    return sorted(out, key=repr)


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_increments_against_brute_force_and_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    live = LiveFill(spark, str(tmp_path / "out"), KINDS)
    assert live.version() == 0 and live.centers() == {}
    for i, part in enumerate(PARTS, 1):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        assert live.advance(stream_of(spark, folder)) == i
    assert live.advance(stream_of(spark, folder)) == len(PARTS)  # nothing came
    assert sorted(map(tuple, live.rows().select("row_id", *KINDS, "note", "missing", "increment").collect()), key=repr) == brute(PARTS)
    batch = spark.createDataFrame([r for p in PARTS for r in p], SCHEMA)
    assert live.centers() == {c: C.fill_center(batch, c, s) for c, s in KINDS.items()}
    assert LiveFill(spark, str(tmp_path / "out"), {"price": "mode"}).centers() == {}  # a profile of another strategy is not in force


def test_an_increment_cut_off_before_its_profile_is_repeated(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    live = LiveFill(spark, str(tmp_path / "out"), KINDS)
    spark.createDataFrame(PARTS[0], SCHEMA).write.parquet(folder)
    live.advance(stream_of(spark, folder))
    spark.createDataFrame(PARTS[1], SCHEMA).write.mode("append").parquet(folder)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(LiveFill, "_publish", lost)
        with pytest.raises(OSError):
            live.advance(stream_of(spark, folder))
    assert live.version() == 1
    spark.createDataFrame(PARTS[2], SCHEMA).write.mode("append").parquet(folder)
    again = LiveFill(spark, str(tmp_path / "out"), KINDS)
    assert again.advance(stream_of(spark, folder)) == 2  # both parts are one increment, filled alike
    assert sorted(map(tuple, again.rows().select("row_id", *KINDS, "note", "missing", "increment").collect()), key=repr) == brute([PARTS[0], PARTS[1] + PARTS[2]])


def test_empty_streams_and_clashing_names(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    live = LiveFill(spark, str(tmp_path / "out"), KINDS)
    assert live.advance(stream_of(spark, folder)) == 0
    assert live.centers() == {}
    with pytest.raises(ValueError, match="reserved"):
        live.advance(spark.readStream.schema(SCHEMA + ", missing string").parquet(folder))
    with pytest.raises(ValueError, match="unknown"):
        LiveFill(spark, str(tmp_path / "out"), {"price": "zero"})
