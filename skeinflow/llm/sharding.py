"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Items a shard for the scheduler: groups of at least 1 / (SHARES * shards) of all
#: bytes are items of their own, at most so many; the others meet in SHARES * shards
#: bundles by hash.  So the driver holds at most 2 * SHARES * shards items at any size.
SHARES = 250
#: Rows that one task numbers at most, on average.
SLOT_ROWS = 20_000


def lpt(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """(size, name) -> shard: largest first, each to the least-loaded shard; ties by name and shard."""
    loads = [(0, shard) for shard in range(shards)]
    place = {}
    for size, name in sorted(items, key=lambda item: (-item[0], item[1])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        place[name] = shard
    return place


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """Put documents into shards of near equal bytes; equal texts stay together.

    -> doc_id, size, text_crc32, law, shard, slot, grown_shard.  ``size`` is
    the text's UTF-8 bytes plus 16.  The law is ``bytes``.  Groups of equal
    texts are the items of longest-processing-time scheduling: those that are
    large against a shard one by one, the others in bundles by hash of the
    text, so that the driver schedules a bounded number of items however many
    groups there are.  A group is never split, so one that is larger than a
    shard's part makes its shard larger.

    ``slot`` numbers a shard's rows from 0 without gaps, by a hash of the id,
    then the id.  A null text has no bytes, crc32 0, and is in the group of the
    empty text.  Repeated rows each get a slot; an empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(text, F.lit(1)).alias("k2"),
    )
    rows = materialize(rows, "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    bundles = SHARES * shards
    floor = max(1, -(-(total or 0) // bundles))
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("size"))
    groups = materialize(groups, "shard-groups")
    name = F.when(F.col("size") >= floor, F.concat_ws(":", "k1", "k2")).otherwise(F.pmod("k1", F.lit(bundles)).cast("string"))
    items = groups.groupBy(name.alias("item")).agg(F.sum("size").alias("size")).collect()  # 2 * SHARES * shards rows at most
    place = lpt([(row["size"], row["item"]) for row in items], shards)

    alone = [(int(a), int(b), s) for item, s in place.items() if ":" in item for a, b in [item.split(":")]]
    bundled = [(int(item), s) for item, s in place.items() if ":" not in item]
    alone_df = F.broadcast(spark.createDataFrame(alone, "k1 long, k2 long, alone int"))
    bundle_df = F.broadcast(spark.createDataFrame(bundled, "bundle long, bundled int"))
    placed = (
        rows.join(alone_df, ["k1", "k2"], "left")
        .withColumn("bundle", F.pmod("k1", F.lit(bundles)))
        .join(bundle_df, "bundle", "left")
        .withColumn("shard", F.coalesce("alone", "bundled"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-count // (shards * SLOT_ROWS))))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "part")
    )
    parts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("shard", "part", start.alias("start"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("inner", F.row_number().over(inner) - 1)
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("inner")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
