"""Operator 10: contiguous shards of near equal bytes, in DataFrame functions only.

Rows are range-partitioned by id. Bytes and rows are summed per partition; a window over these totals
alone (one row per partition) gives each partition its global prefix, and a window within each partition
gives each row its own. The byte axis is cut into equal targets; a row goes to the shard in which its
middle byte lies, so shards are contiguous in id order and differ from the target by half a row at each end.

Defined results: size is the bytes of the text in UTF-8 (null: none) plus 1, so that each row weighs
something. Null ids come first. Rows of equal id are ordered by their text's hash; rows that repeat are
placed one after the other. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import scratch, text_of


def by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row's shard, 0 to shards - 1, and its place there, from 0."""
    t = text_of(F.col(f"`{text}`"))
    small = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("tie"),
        F.spark_partition_id().alias("salt"),  # rows equal in id and text are split by where they come from
    )
    # texts do not go through this shuffle; it is written once, so that all that follows sees the same partitions
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("salt")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch(small.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    prefix = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    ranked = (
        placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(prefix, "part")
        .withColumn("middle", F.col("bytes_before") + F.col("upto") - F.expr("size div 2") - 1)
        .withColumn("shard", F.least(F.expr(f"middle * {shards} div all_bytes"), F.lit(shards - 1)).cast("int"))
        .withColumn("rank", F.col("rows_before") + F.col("nth"))
    )
    starts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(starts), "shard").select(  # `shards` rows at most
        "id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot")
    )
