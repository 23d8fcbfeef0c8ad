"""Tables in Parquet folders under one root, with a catalog that outlives the session.

Every change of a table is one more folder of version rows: the key, the change's number (`v_`), what it
does (`op_`, 1 write, 2 delete) and the values, null for a delete. Folders of one table are its change log;
a scan shows the newest version of each key. Tables into which rows were only inserted need no such fold,
as inserts refuse the keys that are there. `compact` writes the rows of now as one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import codecs
from larkspur.operators import conditions, keys, versions
from larkspur.sources.catalog import Catalog
from larkspur.sources.paths import children, fresh, remove, size_of


class Tables:
    """A set of tables under one root; a second one over the same root has the same tables. One writer at a time for each table.

    row_bytes: most bytes that a packed row may have, or None.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, row_bytes: int | None = None):
        self.spark, self.root, self.row_bytes = spark, root or fresh(spark, "tables"), row_bytes
        self.catalog = Catalog(spark, f"{self.root}/catalog")

    def create(self, name: str, columns: list[tuple[str, str]], clustering: str = "heap") -> int:
        return self.catalog.define(name, columns, clustering)

    def _open(self, name: str) -> tuple[str, list[tuple[str, str]], str]:
        """(folder, columns, clustering)"""
        oid, columns, clustering = self.catalog.opened(name)
        return f"{self.root}/data/{oid}", columns, clustering

    @staticmethod
    def _folders(names: list[str]) -> list[str]:
        """Those that count: names are `number-kind`, and a compacted one replaces all before it."""
        last = max((k for k, x in enumerate(names) if x.endswith("-all")), default=0)
        return names[last:]

    def log(self, name: str) -> DataFrame:
        """The versions of a table's rows: its columns, `v_` and `op_`."""
        path, columns, _ = self._open(name)
        schema = ", ".join([*(f"`{c}` {codecs.SPARK_TYPES[k].simpleString()}" for c, k in columns), "v_ long", "op_ int"])
        found = self._folders(children(self.spark, path))
        return self.spark.read.schema(schema).parquet(*[f"{path}/{x}" for x in found]) if found else self.spark.createDataFrame([], schema)

    def scan(self, name: str, *where: tuple[str, str, str | int | None]) -> DataFrame:
        """All columns of the rows that meet the conditions; filters on the key, and of tables without changes all filters, reach the Parquet scan."""
        path, columns, _ = self._open(name)
        log, names = self.log(name), [c for c, _ in columns]
        if all(x.endswith(("-insert", "-all")) for x in self._folders(children(self.spark, path))):
            return conditions.where(log.select(*names), *where)
        on_key = [c for c in where if c[0].lower() == names[0].lower()]
        newest = versions.as_of(conditions.where(log, *on_key), names[0], "v_", "op_")
        return conditions.where(newest.select(*names), *where)

    def encode(self, name: str, texts: DataFrame, order: str) -> DataFrame:
        """A batch of texts, by position, as the table's values beside their order (`seq_`).

        An invalid text, or a row that is too long when packed, fails the query.
        """
        _, columns, _ = self._open(name)
        given = [c for c in texts.columns if c != order]
        if len(given) != len(columns):
            raise ValueError(f"{len(columns)} values are needed, not {len(given)}")
        typed = [codecs.checked(k, F.col(f"`{s}`").cast("string")).alias(c) for s, (c, k) in zip(given, columns)]
        batch = texts.select(F.col(order).alias("seq_"), *typed)
        if self.row_bytes is None:
            return batch
        key = columns[0][0]
        fits = F.when(self._bytes(columns) <= self.row_bytes, F.col(f"`{key}`")).otherwise(F.raise_error(F.lit("a row is too long")).cast("long"))
        return batch.withColumn(key, fits)

    @staticmethod
    def _bytes(columns: list[tuple[str, str]]):
        return sum((codecs.encoded_bytes(k, F.col(f"`{c}`")) for c, k in columns), F.lit(0))

    def _write(self, name: str, rows: DataFrame, kind: str, op: int) -> None:
        """One more folder; kind is its name's end. The write's commit makes it seen as a whole."""
        path, columns, clustering = self._open(name)
        number = max((int(x.split("-")[0]) for x in children(self.spark, path)), default=0) + 1
        out = rows.select(*[c for c, _ in columns]).withColumn("v_", F.lit(number).cast("long")).withColumn("op_", F.lit(op))
        if clustering == "btree":
            out = keys.index(out, columns[0][0], int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        out.write.mode("errorifexists").parquet(f"{path}/{number:08d}-{kind}")

    def insert(self, name: str, texts: DataFrame, order: str) -> DataFrame:
        """Inserts a batch in the order of a column (not stored) and returns (order, key, status) for its rows.

        Of rows with one key the first wins; keys that the table has are refused.
        """
        _, columns, _ = self._open(name)
        key = columns[0][0]
        batch, existing = self.encode(name, texts, order), self.scan(name)  # the folders of before
        told = keys.statuses(batch, key, "seq_", existing)
        self._write(name, keys.accepted(batch, key, "seq_", existing).drop("seq_"), "insert" if self._plain(name) else "write", versions.WRITE)
        return told.withColumnRenamed("seq_", order)

    def _plain(self, name: str) -> bool:
        """No row was changed or deleted since the last compaction."""
        path, _, _ = self._open(name)
        return all(x.endswith(("-insert", "-all")) for x in self._folders(children(self.spark, path)))

    def update(self, name: str, texts: DataFrame, order: str) -> DataFrame:
        """New values for keys that the table has; returns (order, key, status): `ok`, `duplicate` of an earlier row, or `missing`."""
        _, columns, _ = self._open(name)
        key = columns[0][0]
        batch, existing = self.encode(name, texts, order), self.scan(name).select(key)
        told = keys.statuses(batch, key, "seq_").join(existing.withColumn("there_", F.lit(True)), key, "left")
        status = F.when((F.col("status") != "null key") & F.col("there_").isNull(), "missing").otherwise(F.col("status"))
        first = keys.accepted(batch, key, "seq_").drop("seq_")
        self._write(name, first.join(existing, key, "left_semi"), "write", versions.WRITE)
        return told.select(F.col("seq_").alias(order), key, status.alias("status"))

    def delete(self, name: str, *where: tuple[str, str, str | int | None]) -> None:
        """Deletes the rows that meet the conditions; their keys can be written again."""
        _, columns, _ = self._open(name)
        key = columns[0][0]
        gone = self.scan(name, *where).select(key, *[F.lit(None).cast(codecs.SPARK_TYPES[k]).alias(c) for c, k in columns[1:]])
        self._write(name, gone, "delete", versions.DELETE)

    def compact(self, name: str) -> None:
        """The rows of now as one folder; the folders before it go once it is written. History before it is lost."""
        path, columns, _ = self._open(name)
        before = children(self.spark, path)
        self._write(name, self.scan(name), "all", versions.WRITE)
        for x in before:
            remove(self.spark, f"{path}/{x}")

    def as_of(self, name: str, version: int) -> DataFrame:
        """The rows as the first `version` changes left them (of those since the last compaction)."""
        _, columns, _ = self._open(name)
        names = [c for c, _ in columns]
        return versions.as_of(self.log(name), names[0], "v_", "op_", version).select(*names)

    def storage(self, name: str) -> DataFrame:
        """One row: folders (changes stored apart), files that the scan reads, bytes of the files, and rows."""
        path, _, _ = self._open(name)
        folders, files, size = len(self._folders(children(self.spark, path))), len(self.log(name).inputFiles()), size_of(self.spark, path)
        rows = self.scan(name).agg(F.count("*").alias("n_rows"))
        return rows.select(F.lit(folders).alias("n_folders"), F.lit(files).alias("n_files"), F.lit(size).cast("long").alias("n_bytes"), "n_rows")
