"""Sharding by a two-pass external shuffle, in built-in functions only.

Pass one scatters rows uniformly into buckets that fit in memory, by a seeded hash of the row's place in the input.
Pass two puts each bucket in a fixed order and applies a seeded Fisher-Yates shuffle to it. The shuffled buckets one
after the other are a random order of all rows; dealing it out in turn gives shards whose counts differ by one at
most (the ``rows`` law), each shard again in random order.

Defined cases: a null text has no bytes (its checksum is that of the empty text); repeated rows and ids, null ids and
a single frequent text are dealt like other rows, as the hash is of the place; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.session import fresh, materialize

SHARDS = 40
OVERHEAD = 16
BUCKET_BYTES = 16 << 20
#: Up to so many buckets (of 40 bytes at most each) their offsets are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Tasks of the scatter at most; beyond, a task takes several buckets, each still shuffled by itself.
MOST_TASKS = 100_000


def row_bytes(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + OVERHEAD).cast("long")


def held_bytes(rows: DataFrame) -> Column:
    """About what a row takes in memory: OVERHEAD, the bytes of its strings and binaries, of nested values as text, and 8 for each other."""
    sizes = [F.lit(OVERHEAD)]
    for field in rows.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return total.cast("long")


def salts(spark: SparkSession, parts: int) -> DataFrame:
    """For each of ``parts`` partitions (MOST_TASKS at most, 12 bytes each) the least number that Spark's hash sends there.

    Rows with these numbers as keys fill each partition with one bucket, and the grouping needs no further shuffle.
    """
    tried = 8
    while True:
        found = spark.range(parts * tried).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("_part"), F.col("id").cast("int").alias("_salt")).groupBy("_part").agg(F.min("_salt").alias("_salt"))
        if found.count() == parts:
            return found
        tried *= 2


def shuffled(rows: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = 17) -> DataFrame:
    """All columns of ``rows`` with two more last ones, ``bucket`` and ``at`` (place in the shuffled bucket); written.

    The number of buckets follows the bytes of all columns, so a bucket's list stays within memory; each bucket is a
    partition of its own.
    """
    bucket, at = fresh(rows, "bucket"), fresh(rows, "at")
    total = rows.agg(F.sum(held_bytes(rows))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    tasks = min(buckets, MOST_TASKS)
    held = F.struct(F.monotonically_increasing_id().alias("place"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    task = fresh(rows, "task")
    placed = rows.select(held.alias("held"))
    scattered = placed.withColumn(bucket, F.pmod(F.xxhash64(F.col("held.place"), F.lit(seed)), F.lit(buckets)))
    salted = scattered.join(F.broadcast(salts(rows.sparkSession, tasks)), (F.col(bucket) % tasks) == F.col("_part")).withColumn(task, F.col("_salt"))
    apart = salted.select(task, bucket, "held").repartition(tasks, task)
    # The list's order depends on how blocks arrive; sorted by place first, the shuffle starts from one order.
    lists = apart.groupBy(task, bucket).agg(F.array_sort(F.collect_list("held"), lambda a, b: F.signum(a["place"] - b["place"]).cast("int")).alias("list"))
    mixed = lists.select(bucket, F.posexplode(F.shuffle("list", seed)).alias(at, "held"))
    return materialize(mixed.select("held.row.*", F.col(bucket), F.col(at).cast("long").alias(at)), "shuffled")


def shard(rows: DataFrame, shards: int = SHARDS, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = 17) -> DataFrame:
    """``rows`` with last columns ``shard`` and ``slot`` (gapless from 0 in each shard).

    Only one row per bucket, its count, goes through the window that adds up offsets (6 million rows at 100 TB).
    """
    mixed = shuffled(rows, text, bucket_bytes, seed)
    bucket, at = mixed.columns[-2:]
    counts = mixed.groupBy(F.col(bucket).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col(at)
    few = counts.count() <= MOST_BROADCAST
    joined = mixed.join(F.broadcast(offsets) if few else offsets, F.col(bucket) == F.col("_bucket"))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), (position % shards).cast("int").alias(fresh(rows, "shard")), ((position - position % shards) / shards).cast("long").alias(fresh(rows, "slot")))


def write_shards(sharded: DataFrame, folder: str, file_bytes: int = 256 << 20, text: str = "text") -> None:
    """Write what ``shard`` returned as one folder of Parquet files per shard, the files and their rows in slot order.

    Ranges of (shard, slot) are the tasks, so a shard of any size is written by many tasks in files of about
    ``file_bytes``; a file holds rows of one shard only.
    """
    shard_name, slot = sharded.columns[-2:]
    files = max(1, -(-(sharded.agg(F.sum(row_bytes(text))).first()[0] or 0) // file_bytes))
    sharded.repartitionByRange(min(files, MOST_TASKS), shard_name, slot).sortWithinPartitions(shard_name, slot).write.partitionBy(shard_name).parquet(folder)
