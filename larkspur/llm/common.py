"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.paths import fresh, remove

#: Most rows and bytes in one Arrow batch sent to Python, so that long texts cannot fill a worker.
ARROW_ROWS = 2000
ARROW_BYTES = 8 << 20
#: Most rows, of some 50 bytes each, that small() broadcasts.
BROADCAST_ROWS = 100_000


def ready_python(spark: SparkSession) -> None:
    """Ship the package to the executors' Python once a session, and bound Arrow batches in rows and in bytes."""
    context = spark.sparkContext
    if not getattr(context, "larkspur_shipped", False):
        package = Path(__file__).parents[1]
        folder = tempfile.mkdtemp(prefix="larkspur-")
        context.addPyFile(shutil.make_archive(f"{folder}/larkspur", "zip", package.parent, package.name))
        context.larkspur_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


#: Folders that scratch() made, for tidy(). On the driver.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(fresh(spark, name))
    return _made[-1]


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders_of(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of tables that scratch() returned."""
    for df in tables:
        for folder in folders_of(df):
            remove(df.sparkSession, folder)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that scratch() wrote within, but for those that were handed to the function it gives."""
    begun, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(x.rsplit("/", 1)[1] for x in folders_of(df))
        return df

    yield keep
    for path in _made[begun:]:
        if path.rsplit("/", 1)[1] not in kept:
            remove(spark, path)
    del _made[begun:]


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows: broadcast if it has BROADCAST_ROWS at most, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_of(col: str | Column = "text") -> Column:
    """The text, or the empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name close to the wanted one that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
