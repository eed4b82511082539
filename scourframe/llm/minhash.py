"""Near-duplicate documents by b-bit MinHash: band candidates, bit-counted estimates, exact confirmation."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common

#: Minima of a signature, rows of a band, low bits kept of each minimum.
MINIMA, ROWS, BITS = 128, 4, 4
#: Rows of a block by their bits, and by their texts; blocks are compared with each other in one task.
BLOCK, TEXTS = 1024, 256
LOW = int("1" * 16, 16)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    odd = draw.integers(1 << 63, size=MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw.integers(1 << 63, size=256, dtype=np.uint64), odd, draw.integers(1 << 63, size=MINIMA, dtype=np.uint64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as the longest text needs them."""

    base = 0x9E3779B97F4A7C15 | 1
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, cls.base, np.uint64)
            back = np.full(size, pow(cls.base, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            cls.up, cls.down = np.cumprod(steps), np.cumprod(back)
        return cls.up[:n], cls.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of all words as one run, if they are fewer; none without words."""
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    edges = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(begins):
        return np.zeros(0, np.uint64)
    up, down = Powers.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(constants()[0][data] * up[: len(data)])])
    words = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    size = min(size, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        runs = mixed(runs * np.uint64(0xD6E8FEB86659FD93) + words[j: len(words) - size + 1 + j])
    return np.unique(runs)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands of minima, and the low bits of the minima packed into 64-bit words."""
    _, odd, add = constants()
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at: at + 2048, None] * odd + add).min(axis=0))
    least = mixed(least)
    bands = np.arange(1, MINIMA // ROWS + 1, dtype=np.uint64)
    for j in range(ROWS):
        bands = mixed(bands * np.uint64(0xD6E8FEB86659FD93) + least[j::ROWS])
    each = 64 // BITS
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))
    return bands.view(np.int64), np.bitwise_or.reduce(low, axis=1).view(np.int64)


def alike(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed signatures: equal places, less those that are equal by chance."""
    def differing(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(LOW)))

    different = sum((differing(i) for i in range(1, MINIMA * BITS // 64)), differing(0))
    chance = 1 / (1 << BITS)
    return ((1 - different / F.lit(float(MINIMA))) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(similarity: float) -> float:
    """Five standard deviations of the estimate below the similarity that counts."""
    chance = 1 / (1 << BITS)
    p = similarity + (1 - similarity) * chance
    return (p - 5 * (p * (1 - p) / MINIMA) ** 0.5 - chance) / (1 - chance)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, `n_shingles`, `set_key` (a digest of the set), `bands`, `bits`."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def sketch(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), size)
                bands, bits = signature(hashes) if len(hashes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                rows.append((len(hashes), hashlib.md5(hashes.tobytes()).hexdigest(), bands, bits))
            n, keys, bands, bits = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc", "n_shingles", "set_key", "bands", "bits"])

    return docs.select(id_col, text_col).mapInArrow(sketch, f"doc {kind}, n_shingles long, set_key string, bands array<long>, bits array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def compare(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column(1), batch.column(2), batch.column(3)):
                if own is None or b != last:
                    last, own = b, shingles(text_b.as_py(), size)
                other = shingles(text_a.as_py(), size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(compare, pairs.select("a", "b").schema)


def numbered_bits(rows: list) -> np.ndarray:
    return np.array(rows, np.int64).reshape(len(rows), -1).view(np.uint64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`alike` of every row of one matrix of packed bits with every row of another."""
    different = np.zeros((len(a), len(b)), np.int64)
    for word in range(a.shape[1]):
        x = a[:, word, None] ^ b[None, :, word]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        different += np.bitwise_count(x & np.uint64(LOW))
    chance = 1 / (1 << BITS)
    return (1 - different / MINIMA - chance) / (1 - chance)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of hashes: products of slices of their incidence matrix."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    hashes, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    to = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    of, at = of[keep], to[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    result = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(to[-1]) + 1 if len(to) else 0, 4096):
        a, b = np.searchsorted(at, [begin, begin + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[of[a:b], at[a:b] - begin] = 1
        result += part @ part.T
    return result


def blocked(members: DataFrame, group: str, size: int) -> DataFrame:
    """Rows (group, rep, component, ...) dealt to pairs of blocks of their group, column `key`: every two rows of a group that belong
    to different components meet in one pair of blocks, at least. A component that fills blocks of its own does not meet itself."""
    sizes = members.groupBy(group, "component").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > size).select(group, "component", F.ceil(F.col("n") / size).alias("own"))
    rest = sizes.filter(F.col("n") <= size).groupBy(group).agg(F.ceil(F.sum("n") / size).alias("mixed"))
    placed = members.join(large, [group, "component"], "left").join(rest, group, "left")
    alone = F.col("own").isNotNull()
    placed = placed.select(
        *members.columns, F.when(alone, F.col("component")).alias("pure"),
        F.when(alone, F.xxhash64("component", F.pmod(F.xxhash64("rep"), F.col("own")))).otherwise(F.pmod(F.xxhash64("component"), F.col("mixed"))).alias("block"))
    blocks = placed.select(group, "block", "pure").distinct()
    pairs = blocks.toDF(group, "block", "pure").join(blocks.toDF(group, "other", "pure_other"), group)
    pairs = pairs.filter(F.col("pure").isNull() | F.col("pure_other").isNull() | (F.col("pure") != F.col("pure_other")))
    met = pairs.select(group, "block", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    return placed.drop("pure").join(met, [group, "block"]).drop("block")


def spanning(rows: DataFrame, names: list[str], linked) -> DataFrame:
    """What `linked` (a matrix for the rows of a `key`) joins, as links (a, b) that span it: fewer than rows."""
    def work(batches):
        for table in common.runs(batches):
            table = table.sort_by("rep")
            reps = table.column("rep").to_numpy()
            found = common.rooted(linked(table), reps) if len(reps) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return rows.select("key", *names).repartition("key").sortWithinPartitions("key").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their word shingles of at least `percent` hundredths.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a set holds the distinct runs of `size` words.
    Returns id_col, `n_shingles`, `component_id` (smallest id reachable by links), `kept` (id_col = component_id), a row for each row of `docs`.

    Documents of equal sets form one class, which its smallest id stands for. Classes that share a band of minima are candidates;
    the packed low bits estimate their similarity, and what may reach the bound is confirmed on the full sets. First every
    candidate is compared with the first member of each of its buckets, which joins most of a large group at a comparison
    or a few a member. Then only buckets that still hold several components are compared in blocks of bounded size: by the bits
    first, which part them into families, and within a family on the full sets. Pairs never leave a task, only links that
    span what they join, and rows of one component are not compared again; so no link between components is passed over.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. A null id has a null component and is
    not kept. Ids are integers. Repeated rows share their component, and are all kept if their id is. An id is expected to have one text. An empty
    table gives no rows. Other columns are not read.
    """
    sketch = common.settled(sketches(docs, size, id_col, text_col), "sketches")
    usable = sketch.filter("n_shingles > 0 and doc is not null")
    classes = usable.groupBy("set_key").agg(F.min("doc").alias("rep"))
    # on both columns, so that a set held by very many documents is dealt over all tasks
    reps = usable.join(classes.withColumnRenamed("rep", "doc"), ["set_key", "doc"]).dropDuplicates(["set_key"]).select(F.col("doc").alias("rep"), "bands", "bits")
    reps = common.settled(reps, "classes")
    members = reps.select("rep", F.explode("bands").alias("code"))
    several = members.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code")
    members = common.settled(members.join(several, "code"), "buckets")
    candidates = members.select("rep").distinct()
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(candidates, "rep", "left_semi").dropDuplicates(["rep"])
    texts = common.settled(texts, "candidate-texts")
    bits = reps.join(candidates, "rep", "left_semi").select("rep", "bits")
    bits = common.settled(bits, "candidate-bits")
    bound = least_estimate(percent / 100)

    first = members.groupBy("code").agg(F.min("rep").alias("b"))
    pairs = members.join(first, "code").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    pairs = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    pairs = pairs.filter(alike(F.col("bits_a"), F.col("bits_b")) >= bound).select("a", "b")
    links = common.settled(confirmed(pairs, texts, size, percent), "confirmed")
    component = common.components(links)

    placed = members.join(component, members.rep == component.node, "left").select("rep", "code", F.coalesce("component", "rep").alias("component"))
    several = placed.groupBy("code").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("code")
    placed = common.settled(placed.join(several, "code").join(bits, "rep"), "open-buckets")

    def close(table: pa.Table) -> np.ndarray:
        own, of = numbered_bits(table.column("bits").to_pylist()), table.column("component").to_numpy()
        return (estimates(own, own) >= bound) & (of[:, None] != of[None, :])

    def equal(table: pa.Table) -> np.ndarray:
        sets = [shingles(text.as_py(), size) for text in table.column("text")]
        n, both = np.array([len(x) for x in sets]), shared(sets)
        return 100 * both >= percent * (n[:, None] + n[None, :] - both)

    near = common.settled(spanning(blocked(placed, "code", BLOCK), ["rep", "component", "bits"], close), "close")
    if not near.isEmpty():
        family = common.components(near)
        rows = placed.select("rep", "component").distinct().join(family.toDF("rep", "family"), "rep")
        rows = common.settled(rows, "families")
        found = common.settled(spanning(blocked(rows, "family", TEXTS).join(texts, "rep"), ["rep", "component", "text"], equal), "confirmed")
        if not found.isEmpty():
            component = common.components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    of_class = classes.join(component, classes.rep == component.node, "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    joined = sketch.select("doc", "n_shingles", "set_key").join(of_class, "set_key", "left")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc").isNotNull(), F.col("component"))).otherwise(F.col("doc"))
    result = joined.select(F.col("doc").alias(id_col), "n_shingles", own.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents, shingles of two words, similarity 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=2, percent=80)
