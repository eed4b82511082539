"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common

#: Groups of at least 1 / (GRAIN * shards) of all bytes are placed one by one; there can be no more than GRAIN * shards of them.
GRAIN = 64
#: Smaller groups travel in bundles, GRAIN * shards of them a level; a level holds half the bytes of the one before.
LEVELS = 12


def longest_first(items: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Items by falling size, ties by name, each to the least loaded shard (ties: the lowest number)."""
    loads = [(0, shard) for shard in range(n_shards)]
    to: dict[str, int] = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(loads)
        to[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return to


def shard_groups(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Deal documents over shards of nearly equal bytes; documents of equal text stay in one shard.

    Returns id_col, `size` (UTF-8 bytes of the text plus `overhead`), `text_crc32`, `group_key`, `shard`, `slot`.

    Groups go by falling size to the least loaded shard, through a heap. The heap runs over at most
    `GRAIN * n_shards * (1 + LEVELS)` items, whatever the input: groups above a fixed share of all bytes one by one, and
    bundles of smaller ones, whose sizes halve from level to level, so that the last placements are fine grains. Which bundle
    a group belongs to depends on its text alone. Sizes differ by more than a grain only where one group outweighs a shard.

    A null text counts as empty. Null ids and repeated rows are rows like any other. An empty table gives no rows. Columns
    besides id_col and text_col are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col), (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group_key"),
    )
    groups = common.settled(base.groupBy("group_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    n = GRAIN * n_shards
    large = (F.col("bytes") * n >= F.lit(total)) if total else F.lit(True)
    places = F.pmod(F.xxhash64("group_key"), F.lit(n))
    draw = F.xxhash64("group_key", F.lit(1))
    level = F.least(F.bit_count(draw.bitwiseAND(-draw) - 1), F.lit(LEVELS - 1))
    bundle = F.concat_ws(":", level.cast("string"), places.cast("string"))

    heads = [(row[0], row[1]) for row in groups.filter(large).select("group_key", "bytes").collect()]
    bundles = [(row[0], row[1]) for row in groups.filter(~large).groupBy(bundle.alias("b")).agg(F.sum("bytes")).collect()]
    to = longest_first(heads + bundles, n_shards)
    plan = spark.createDataFrame(list(to.items()), "item string, shard int")
    alone = spark.createDataFrame([(name,) for name, _ in heads], "alone string")

    marked = base.join(F.broadcast(alone), F.col("group_key") == F.col("alone"), "left")
    item = F.when(F.col("alone").isNotNull(), F.col("alone")).otherwise(bundle)
    dealt = marked.withColumn("item", item).join(F.broadcast(plan), "item").drop("item", "alone")
    return common.numbered(dealt, "shard", [id_col, "group_key"], "slot")


def op7_lpt_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents over shards 0 to 39, law `bytes`."""
    shards = shard_groups(common.table(spark, sf_dir, "documents"), 40)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
