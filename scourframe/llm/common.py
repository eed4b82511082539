"""Shared parts of the training-data operators: written tables, gapless numbering, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

import scourframe
from scourframe.session import shared_dir

#: Folds of the labelled rows: crc32 of the id's text, modulo 3; this remainder is held out from learning.
FOLDS, HELD_OUT = 3, 1
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bits of a row of a bitmap of hashed keys; of the whole map a key, and at most, which is 16 MB.
MAP_ROW, BITS_A_KEY, MOST_BITS = 1 << 15, 16, 1 << 27


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, wherever it was imported from; and let whole texts reach them
    in batches of at most BATCH_ROWS rows, so that a worker holds little of a table at once."""
    context = spark.sparkContext
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    if getattr(context, "_scourframe_shipped", False):
        return
    root = Path(scourframe.__file__).parent
    archive = f"{tempfile.mkdtemp(prefix='scourframe-code-')}/scourframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._scourframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the folder that all executors share and read it back: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table written by `settled` that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that nothing is learned from; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values only, so that a repeated task draws the same rows."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def narrowed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose `key` may be in `keys`: all that are, and some whose hash falls on the bit of another (one in 16 or fewer as long as
    the map is below its limit). Put before an exact join of wide rows, so that only rows that may match are shuffled; the map is broadcast, in rows."""
    if dict(df.dtypes)[key] != dict(keys.dtypes)[key]:
        return df
    bits = min(MOST_BITS, max(MAP_ROW, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    row, bit = F.shiftright(place, MAP_ROW.bit_length() - 1), place.bitwiseAND(F.lit(MAP_ROW - 1))
    maps = keys.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return df.join(F.broadcast(maps), row == F.col("_row")).filter(may).drop("_row", "_bits")


def numbered(df: DataFrame, key: str, order: list[str], to: str) -> DataFrame:
    """Number the rows of every `key` from 0 without gaps, in column `to`.

    Rows are written with the number of the task that made them; they are counted for each task and key, and a row's number
    is the count of the tasks before plus its rank among the rows of its own task. A key with a third of all rows is thus
    dealt over as many groups as there were tasks. Null keys are numbered like any key.
    """
    placed = settled(df.withColumn("_task", F.spark_partition_id()), f"numbered-{key}")
    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        placed.groupBy(key, "_task").count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(F.col(key).alias("_key"), F.col("_task").alias("_of"), "_before")
    )
    within = Window.partitionBy("_task", key).orderBy(*order)
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1)
    joined = ranked.join(counts, (F.col("_task") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(to, F.col("_before") + F.col("_rank")).drop("_task", "_of", "_key", "_before", "_rank")


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Smallest reachable vertex of every vertex of `edges`: columns `node`, `component`.

    Alternating large-star and small-star steps. Each step is an aggregate of minima, folded before it is shuffled, and a
    join back that Spark may split where one vertex has many edges; tables are written between steps.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    current, last = settled(pairs, "links"), None
    for _ in range(most):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()  # taken while the links are written
        following = settled(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
        state = seen.get
        dropped(current)
        current = following
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


class Numbers(dict):
    """Numbers of strings, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def crc32_of(array) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(array.astype("<u4").tobytes())


def blocks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of at most `most` characters, or one text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, texts[at:]


def runs(batches: Iterator, key: int = 0) -> Iterator:
    """Tables of consecutive rows of equal `key`, of batches that are sorted by it; a run may reach over several batches."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        begin = 0
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for cut in cuts.tolist():
            held.append(batch.slice(begin, cut - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def rooted(linked, names) -> list[tuple[int, int]]:
    """For a square matrix of links between sorted names: each linked row with the smallest name it reaches, unless it is that."""
    import numpy as np

    n = len(names)
    root = np.arange(n)
    while n:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(int(names[i]), int(names[root[i]])) for i in np.flatnonzero(root != np.arange(n))]
