"""A change log as a stream: the same fold as a batch replay, with the state in the streaming engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.replay import DELETE


def latest(changes: DataFrame, key: str, lsn: str, kind: str, payload: list[str]) -> DataFrame:
    """The last record of each key so far; for streams in complete or update mode, and for tables."""
    return changes.groupBy(key).agg(F.max_by(F.struct(kind, *payload), lsn).alias("s"))


def live(state: DataFrame, key: str, kind: str, payload: list[str]) -> DataFrame:
    return state.filter(F.col(f"s.{kind}") != DELETE).select(key, *[F.col(f"s.{c}").alias(c) for c in payload])


def drain(spark: SparkSession, changes: DataFrame, key: str, lsn: str, kind: str, payload: list[str], path: str) -> DataFrame:
    """Runs a stream of changes until its source is empty; every batch publishes the keys that it changed.

    The state is the streaming engine's; a batch's output folder is rewritten if the batch is run again.
    """
    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    query = (
        latest(changes, key, lsn, kind, payload).writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(publish).start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(f"{path}/state")
    newest = updates.groupBy(key).agg(F.max_by("s", "batch").alias("s"))
    return live(newest, key, kind, payload)
