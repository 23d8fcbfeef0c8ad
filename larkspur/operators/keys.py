"""Primary keys over batches: the first row of a key wins, later ones are duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.paths import fresh


def first_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the smallest order (no map columns). Map-side minima, so that a hot key is one row per task."""
    rest = [c for c in batch.columns if c not in (key, order)]
    least = F.min(F.struct(order, *rest))
    return batch.groupBy(key).agg(least.alias("s")).select(*[F.col(key) if c == key else F.col("s")[c].alias(c) for c in batch.columns])


def accepted(batch: DataFrame, key: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows of a batch that an insert takes: first of their key, and of a key that the table lacks."""
    first = first_per_key(batch.filter(F.col(key).isNotNull()), key, order)
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def statuses(batch: DataFrame, key: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """(order, key, status): `ok`, or `duplicate` of an earlier row or of the table; a null key is `null key`."""
    firsts = batch.groupBy(key).agg(F.min(order).alias("first_"))
    if existing is not None:
        firsts = firsts.join(existing.select(key).distinct().withColumn("there_", F.lit(True)), key, "left")
    else:
        firsts = firsts.withColumn("there_", F.lit(None).cast("boolean"))
    joined = batch.select(order, key).join(firsts, key, "left")
    status = (
        F.when(F.col(key).isNull(), "null key")
        .when(F.col("there_").isNotNull() | (F.col(order) != F.col("first_")), "duplicate")
        .otherwise("ok")
    )
    return joined.select(order, key, status.alias("status"))


def index(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """df in key order, range-partitioned: written so, scans prune by the files' and row groups' key ranges."""
    return df.repartitionByRange(partitions, key).sortWithinPartitions(key)


def ranked(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """df with `rank`, each row's place in key order, from 1, without one task for all rows.

    Rows are range-partitioned, so that a key's distance from the others does not matter, and written;
    a window over the partitions' counts alone gives each its offset. Null keys come first; rows of equal
    key are ranked one after the other, in an order of their own.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, "ranked")
    salted = df.withColumn("salt_", F.spark_partition_id())  # rows of equal key can be split
    order = [F.col(key).asc_nulls_first(), F.col("salt_")]
    salted.repartitionByRange(partitions, *order).withColumn("part_", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    ranks = placed.withColumn("place_", place).join(F.broadcast(offsets), "part_")  # `partitions` rows
    return ranks.select(*df.columns, (F.col("before_") + F.col("place_")).cast("long").alias("rank"))


def without_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")
