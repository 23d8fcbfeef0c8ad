"""Row versions: current rows, rows as of a version, and each row's history.

A version log has a key, a version number, an operation (1 write, 2 delete) and payload columns. A row
written at version v is visible at snapshots s with xmin <= s < xmax; xmax is the version that replaced
or deleted it, or 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WRITE, DELETE = 1, 2


def as_of(log: DataFrame, key: str, version: str, op: str, at: int | None = None) -> DataFrame:
    """The visible row of each key at a version (None: now). Partial maxima per task: a hot key costs no more."""
    if at is not None and at < 0:
        raise ValueError("negative version")
    seen = log if at is None else log.filter(F.col(version) <= at)
    rest = [c for c in log.columns if c not in (key, version)]
    newest = seen.groupBy(key).agg(F.max_by(F.struct(version, *rest), version).alias("s"))
    rows = newest.select(*[F.col(key) if c == key else F.col("s")[c].alias(c) for c in log.columns])
    return rows.filter(F.col(op) == WRITE)


def history(log: DataFrame, key: str, version: str, bucket_versions: int = 1_000_000) -> DataFrame:
    """log with `xmin`, `xmax` (0: current) and `prev` (0: the first): each version with its neighbours.

    Versions of a key are looked at in buckets of `bucket_versions` version numbers, so that the versions
    of a hot key are spread; a bucket's ends come from a second window over the buckets' extremes.
    """
    rows = log.withColumn("b_", F.expr(f"`{version}` div {bucket_versions}"))
    ends = rows.groupBy(key, "b_").agg(F.min(version).alias("lo_"), F.max(version).alias("hi_"))
    over = Window.partitionBy(key).orderBy("b_")
    around = ends.select(key, "b_", F.lead("lo_").over(over).alias("next_"), F.lag("hi_").over(over).alias("last_"))
    inside = Window.partitionBy(key, "b_").orderBy(version)
    chained = rows.withColumn("up_", F.lead(version).over(inside)).withColumn("down_", F.lag(version).over(inside)).join(around, [key, "b_"])
    return chained.select(
        *[F.col(c) for c in log.columns],
        F.col(version).alias("xmin"),
        F.coalesce("up_", "next_", F.lit(0)).cast("long").alias("xmax"),
        F.coalesce("down_", "last_", F.lit(0)).cast("long").alias("prev"),
    )


def visible(chain: DataFrame, op: str, at: int) -> DataFrame:
    """Rows of a history that a snapshot sees."""
    return chain.filter((F.col("xmin") <= at) & ((F.col("xmax") == 0) | (F.col("xmax") > at)) & (F.col(op) == WRITE))
