"""Contiguous shards of balanced byte size, with DataFrame operations only.

Rows are put in one global order over range partitions. Each partition's total is known from a small
aggregate; the running sum of those totals, plus a running sum inside the partition, is the global prefix
sum of every row. The prefix is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyaccord.lineage import checkpointed


def utf8(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit("").cast("binary"))


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row in one of `shards` contiguous ranges of (id, crc32, size).

    size is the UTF-8 length plus 1 (null text: 1, crc32 of no bytes). A row goes to the shard in which the
    middle of its bytes falls, so shard sizes differ from the equal target by less than the largest row.
    slot counts the rows of a shard from 0. Null ids come first. Rows that agree in id, crc32 and size are
    interchangeable. An empty table gives an empty result; shards may be empty if there are few rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.length(utf8(text_col)) + 1).cast("long").alias("size"), F.crc32(utf8(text_col)).alias("text_crc32"))
    # The last key only lets a single repeated row spread over several ranges.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = checkpointed(narrow.withColumn("salt", F.monotonically_increasing_id()))
    order = ["id", "text_crc32", "size", "salt"]
    ranged = checkpointed(salted.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each range partition, whose number is a setting: a window over it and a broadcast are bounded.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"), F.sum("bytes").over(everything).alias("total"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"upto": F.sum("size").over(within), "nth": F.row_number().over(within)}).join(F.broadcast(bases), "part")
    middle = 2 * (F.col("base") + F.col("upto")) - F.col("size")
    shard = F.expr("CAST(least(__k - 1, (__m * __k) DIV (2 * total)) AS INT)")
    placed = placed.withColumns({"__m": middle, "__k": F.lit(shards).cast("long"), "at": F.col("row_base") + F.col("nth") - 1}).withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select("id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).cast("long").alias("slot"))
