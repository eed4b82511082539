"""Hard negatives against plain integers, and residue products against exact ones."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from scourframe.llm import negatives
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, key int, twin int"


def brute(rows, anchor_of, label_of):
    """(anchor, positive, rank, negative, scores), rows told apart by id, label and components."""
    part = {}
    for i, v, label in rows:
        label = label_of(i, label) if i is not None and label is not None else None
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        part[i, label, whole] = None
    out = []
    for i, label, v in part:
        if not anchor_of(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in part if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_products_are_exact():
    draw = np.random.default_rng(3)
    for width, most in ((1, 5), (64, 300), (300, 4000), (64, 3_000_000)):
        a, b = draw.integers(-most, most + 1, (20, width)), draw.integers(-most, most + 1, (30, width))
        bound = int(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max())) + 1
        by = negatives.primes(width, bound)
        assert all((p // 2) ** 2 * min(width, 256) < negatives.EXACT for p in by) and len(set(by)) == len(by)
        result = negatives.products(negatives.Residues(a.astype(float), by).rows(0, 20), negatives.Residues(b.astype(float), by).rows(0, 30), by)
        assert (result == a @ b.T).all()


def test_ties_repeats_and_odd_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 3)], int(draw.integers(0, 3))) for i in range(120)]
    rows += [(0, rows[0][1], rows[0][2]), (0, [1.0, 1.0, 1.0], 1), (7, [1.0, 1.0, 2.0], None), (None, [1.0, 1.0, 1.0], 1), (500, None, 1), (501, [1.0, None, 2.0], 1)]
    rows += [(502, [float("nan"), 1.0, 1.0], 1), (503, [float("inf"), 1.0, 1.0], 1), (504, [], 1), (505, [0.0, 0.0, 0.0], 2), (550, [0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, "x", 3, 4) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute(rows, lambda i: i % 10 == 0, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x)
    assert got(negatives.mine(df, F.col("vec_id") % 10 == 0, label)) == want and len(want) > 50
    assert negatives.mine(df.filter("false"), F.col("vec_id") % 10 == 0, label).count() == 0
    assert negatives.mine(df.filter("vec_id = 10"), F.col("vec_id") % 10 == 0, label).count() == 0


def test_blocks_make_no_difference(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = got(negatives.mine(df, F.col("vec_id") % 9 == 0, F.col("label")))
    monkeypatch.setattr(negatives, "ROW_BLOCK", 70)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 20)
    assert got(negatives.mine(df, F.col("vec_id") % 9 == 0, F.col("label"))) == whole and whole


def test_op12_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(negatives.OP12_SQL)
    names = [c[0] for c in want.description]
    at = [names.index(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert got(negatives.op12_hard_negatives(spark, SF)) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
