"""Hard-negative mining with exact integer scores: products modulo small primes in float32, put together by the Chinese remainder theorem."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scourframe.llm import common, vectors

#: Rows of a block, anchors of a block, anchors scored at a time.
ROW_BLOCK, ANCHOR_BLOCK, TILE = 8192, 2048, 128
#: Every integer below it is exact in float32.
EXACT = 1 << 24
#: Scores stay below it, so that the product of the primes stays below 2^62.
LARGEST = 1 << 50


def primes(width: int, bound: int) -> list[int]:
    """Primes whose product exceeds 2 * bound + 1, the largest ones for which a product over `width` centred residues is exact in float32."""
    chosen, product = [], 1
    at = 2 * math.isqrt((EXACT - 1) // max(1, min(width, 256))) + 1
    while product <= 2 * bound + 1:
        while any(at % d == 0 for d in range(2, math.isqrt(at) + 1)):
            at -= 1
        chosen.append(at)
        product *= at
        at -= 1
    return chosen


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues of smallest absolute value."""
    rest = values % prime
    return np.where(rest > prime // 2, rest - prime, rest)


class Residues:
    """A matrix of integers as one float32 matrix of centred residues for each prime."""

    def __init__(self, values: np.ndarray, by: list[int]):
        self.by = by
        self.parts = [centred(values, p).astype(np.float32) for p in by]

    def rows(self, begin: int, end: int) -> list[np.ndarray]:
        return [part[begin:end] for part in self.parts]


def products(a: list[np.ndarray], b: list[np.ndarray], by: list[int]) -> np.ndarray:
    """All exact inner products of two residue matrices, as signed 64-bit integers.

    Columns are taken in slices for which float32 is exact. The residues are put together digit by digit in mixed radix; half of
    the range of the primes' product stands for negative numbers.
    """
    total, modulus = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for x, y, prime in zip(a, b, by):
        step = max(1, (EXACT - 1) // (prime // 2) ** 2)
        rest = np.zeros(total.shape, np.int64)
        for at in range(0, x.shape[1], step):
            rest += (x[:, at: at + step] @ y[:, at: at + step].T).astype(np.int64)
        digit = (rest - total) % prime * pow(modulus, -1, prime) % prime
        total += digit * modulus
        modulus *= prime
    return np.where(total > modulus // 2, total - modulus, total)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest allowed scores of every row, ties to the smaller column."""
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, low)
    if masked.shape[1] > k:
        edge = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
    else:
        edge = np.full(len(masked), low)
    at, column = np.nonzero((masked >= edge[:, None]) & allowed)
    order = np.lexsort((column, -masked[at, column], at))
    at, column = at[order], column[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], column[place < k]


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """Rows that take part: `id`, `label`, `v` (integers), `twin` (tells different rows of one id apart), exact repeats folded."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    part = rows.filter(F.coalesce(F.col(id_col).isNotNull() & label.isNotNull() & ~bad & (F.size(v) > 0), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return part.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v")).withColumn(
        "twin", F.xxhash64("label", "v")).dropDuplicates(["id", "twin"])


def mine(rows: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For every anchor and each of its `positives` best rows of the same label, the `negatives` best rows of other labels within the window
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. A component x counts as
    floor(scale * x); a score is the exact integer inner product; ties go to the smaller id.

    `anchors` is a condition and `label` an expression over the columns of `rows`. Rows with a null id, label or vector, an empty vector or
    a null or non-finite component take no part; vectors of zeros do. Exact repeats count once; different rows of one id are rows
    (and anchors) of their own, but no row is a positive or negative of an anchor of the same id. An anchor without a row of its label, and a
    positive without a row in its window, give no rows, as does an empty table. Vectors of several widths, and scores of 2^50 or
    more, are errors. Other columns are not read.

    Rows are dealt by a hash of their id to blocks, anchors likewise, and each block of anchors meets each block of rows in one task,
    twice: first for the best positives of a block, folded over all blocks, then for the best negatives in the windows that
    these open. What leaves a task is a few rows an anchor; no label is gathered anywhere, so a hot one costs like any other.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_anchor", F.coalesce(anchors, F.lit(False)))
    table = prepared(marked, id_col, vector_col, label, scale)
    own = prepared(marked.filter("_anchor"), id_col, vector_col, label, scale)
    table, own = common.settled(table, "vectors"), common.settled(own, "anchors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, norm, narrow, wide = table.agg(F.count("*"), F.max(square), F.min(F.size("v")), F.max(F.size("v"))).first()
    n_anchors = own.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    if narrow != wide:
        raise ValueError(f"vectors have {narrow} to {wide} components")
    if norm >= LARGEST:
        raise ValueError("scores of 2^50 or more")
    by = primes(wide, int(norm) + 1)
    row_blocks, anchor_blocks = math.ceil(n / ROW_BLOCK), math.ceil(n_anchors / ANCHOR_BLOCK)

    def met(side: DataFrame, blocks: int, others: int, flipped: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "twin"), F.lit(blocks))
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        placed = side.withColumn("_block", block).withColumn("_other", other)
        row, anchor = ("_other", "_block") if flipped else ("_block", "_other")
        return placed.withColumn("key", F.col(anchor).cast("long") * row_blocks + F.col(row)).drop("_block", "_other")

    right = met(table, row_blocks, anchor_blocks, False).select("key", "id", "label", "v")

    def scored(left, right_table, select):
        ids, labels = right_table.column("id").to_numpy(), right_table.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels = ids[order], labels[order]
        held = Residues(vectors.matrix(right_table.column("v"), wide)[order], by).rows(0, len(ids))
        a_ids, a_labels = left.column("id").to_numpy(), left.column("label").to_numpy()
        asked = Residues(vectors.matrix(left.column("v"), wide), by)
        for at in range(0, len(a_ids), TILE):
            score = products(asked.rows(at, at + TILE), held, by)
            other = a_ids[at: at + TILE, None] != ids[None, :]
            same = a_labels[at: at + TILE, None] == labels[None, :]
            yield from select(at, score, other & same, other & ~same, ids)

    def grid(left: DataFrame, names: list[str], select, to: str) -> DataFrame:
        """`select` for each pair of blocks; `names` are further columns of the anchors."""
        asked = met(left, anchor_blocks, row_blocks, True).select("key", "id", "twin", "label", "v", *names)
        target = pa.schema([(part.split()[0], pa.int64()) for part in to.split(", ")])

        def work(key, left_table, right_table):
            if not left_table.num_rows or not right_table.num_rows:
                return pa.Table.from_batches([], target)
            found = list(scored(left_table, right_table, lambda *args: select(left_table, *args)))
            if not found:
                return pa.Table.from_batches([], target)
            return pa.table([np.concatenate(c) for c in zip(*found)], schema=target)

        return asked.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(work, to)

    def first_positives(left, at, score, same, different, ids):
        row, column = best(score, same, positives)
        if len(row):
            yield left.column("id").to_numpy()[at + row], left.column("twin").to_numpy()[at + row], ids[column], score[row, column]

    def first_negatives(left, at, score, same, different, ids):
        bounds = left.column("bounds")
        for i in range(len(score)):
            usable = np.flatnonzero(different[i])
            order = usable[np.argsort(-score[i, usable], kind="stable")]
            falling = -score[i, order]
            for p in bounds[at + i].as_py():
                # whole numbers only: the smallest and the largest score of the window
                lowest, highest = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
                begin = int(np.searchsorted(falling, -highest))
                chosen = order[begin: begin + negatives]
                chosen = chosen[score[i, chosen] >= lowest]
                if len(chosen):
                    k = len(chosen)
                    yield (np.repeat(left.column("id")[at + i].as_py(), k), np.repeat(left.column("twin")[at + i].as_py(), k),
                           np.repeat(p["place"], k), ids[chosen], score[i, chosen])

    each = Window.partitionBy("id", "twin").orderBy(F.desc("score"), "other_id")
    found = grid(own, [], first_positives, "id long, twin long, other_id long, score long")
    found = found.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= positives)
    found = common.settled(found.select("id", "twin", F.col("place").cast("long").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = found.groupBy("id", "twin").agg(F.collect_list(F.struct("place", "positive_score")).alias("bounds"))
    within = Window.partitionBy("id", "twin", "place").orderBy(F.desc("score"), "other_id")
    taken = grid(own.join(bounds, ["id", "twin"]), ["bounds"], first_negatives, "id long, twin long, place long, other_id long, score long")
    taken = taken.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= negatives)
    return taken.join(found, ["id", "twin", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract: anchors are ids divisible by 50; ids divisible by 7 take the following label."""
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), windowed AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
   AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windowed WHERE rank <= 3
"""
