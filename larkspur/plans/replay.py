"""Change logs: records in log order, folded into the state that they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.rows import row_hash
from larkspur.operators.keys import ranked
from larkspur.sources.paths import children

#: Record types.
INSERT, DELETE, INIT_PAGE, COMMIT, ABORT, CHECKPOINT, FULL_PAGE = range(1, 8)


def committed(log: DataFrame, xid: str = "xid", kind: str = "type") -> DataFrame:
    """Records of transactions that have a commit record, without those records."""
    done = log.filter(F.col(kind) == COMMIT).select(xid).distinct()
    return log.filter(F.col(kind).isin(INSERT, DELETE)).join(done, xid, "left_semi")


def intact(log: DataFrame, hash_col: str, expected, lsn: str = "lsn") -> DataFrame:
    """Records before the first whose stored hash is not the expected one. The cross join is with the one row that names it."""
    bad = log.filter(~F.col(hash_col).eqNullSafe(expected)).agg(F.min(lsn).alias("bad_"))
    return log.crossJoin(F.broadcast(bad)).filter(F.col("bad_").isNull() | (F.col(lsn) < F.col("bad_"))).drop("bad_")  # with one row


def replay(log: DataFrame, key: str, payload: list[str], snapshot: DataFrame | None = None, after: int | None = None, lsn: str = "lsn", kind: str = "type") -> DataFrame:
    """(key, payload): snapshot, which holds all up to `after`, with the later records applied; the last record of a key decides."""
    tail = log.filter(F.col(kind).isin(INSERT, DELETE))
    tail = tail if after is None else tail.filter(F.col(lsn) > after)
    rows = tail.select(key, lsn, kind, *payload)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select(key, F.lit(-1).cast("long").alias(lsn), F.lit(INSERT).alias(kind), *payload))
    last = rows.groupBy(key).agg(F.max_by(F.struct(kind, *payload), lsn).alias("s"))
    return last.filter(F.col(f"s.{kind}") != DELETE).select(key, *[F.col(f"s.{c}").alias(c) for c in payload])


def record_counts(log: DataFrame, kind: str = "type") -> DataFrame:
    return log.groupBy(kind).agg(F.count("*").alias("n"))


def append(spark: SparkSession, path: str, changes: DataFrame, key: str, order: str, payload: list[str], commit: bool = True) -> int:
    """Appends a transaction to the log under path and returns its number.

    changes has a key, an order, `type` (INSERT or DELETE) and the payload. Records get log positions (`lsn`)
    in that order, behind those of earlier transactions, a hash (`check`) and, behind them, a COMMIT or ABORT.
    The transaction is one folder, seen as a whole once it is written; one writer at a time.
    """
    xid = len(children(spark, path))
    last = read_log(spark, path).agg(F.max("lsn")).first()[0] if xid else None
    base = 0 if last is None else last + 1
    rows = ranked(changes.select(key, order, "type", *payload), order, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select((F.col("rank") - 1 + base).alias("lsn"), key, F.col("type").cast("int").alias("type"), *payload)
    kinds = dict(rows.dtypes)
    end = rows.agg(F.coalesce(F.max("lsn") + 1, F.lit(base)).alias("lsn")).select(
        F.col("lsn").cast("long"), F.lit(None).cast(kinds[key]).alias(key), F.lit(COMMIT if commit else ABORT).alias("type"), *[F.lit(None).cast(kinds[c]).alias(c) for c in payload]
    )
    records = rows.unionByName(end).withColumn("xid", F.lit(xid).cast("long"))
    records.withColumn("check", row_hash("lsn", "xid", "type", key, *payload)).write.mode("errorifexists").parquet(f"{path}/{xid:010d}")
    return xid


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of the log under path, of which there must be one at least."""
    return spark.read.parquet(*[f"{path}/{x}" for x in children(spark, path)])
