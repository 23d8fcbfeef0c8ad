"""The catalog as tables: types, objects, columns and tables, and what a table looks like.

Definitions are kept in Parquet under the catalog's root, one small folder for each definition, so that any
session can open them. A folder's name is the number of the definition; the writer that creates it first
has it, and another one that tries fails and can try again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from larkspur.sources.paths import children, fresh

#: Fixed values: (oid, name, type_val, len) of the scalar types, in their order; len 0 is of variable length.
TYPES = [
    (25, "int8", 0, 1), (26, "int16", 1, 2), (27, "int32", 2, 4), (12, "int64", 3, 8), (28, "float", 4, 4),
    (29, "decimal", 5, 8), (15, "bool", 6, 1), (13, "varchar", 7, 0), (24, "char", 8, 0),
]
#: Oids of the system tables.
SYSTEM_TABLES = [(100, "types"), (110, "objects"), (111, "columns"), (112, "tables")]
#: Namespaces, the oid of the type table, and the oid before the first user object.
SYS, PUBLIC, TABLE_OID, LAST_SYSTEM_OID = 0, 1, 21, 4000
CLUSTERED = {"heap": 0, "btree": 1}

TYPES_DDL = "oid long, name string, type_val int, len int"
OBJECTS_DDL = "oid long, namespace_oid long, type_oid long, rel_id long, name string"
COLUMNS_DDL = "oid long, rel_id long, pos int, name string, type_val int, len int, notnull boolean"
TABLES_DDL = "oid long, namespace_oid long, name string, clustered_type int"


class CatalogError(ValueError):
    """A definition that the catalog refuses."""


def kind_of_spark(kind: DataType) -> str:
    """The scalar type that holds a Spark type's values as they are."""
    names = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "boolean": "bool"}
    return names.get(kind.typeName()) or ("decimal" if kind.typeName() in ("decimal", "double", "float") else "varchar")


class Catalog:
    """Definitions of tables under a root, told as DataFrames. The driver reads a row for each column, when it opens them."""

    def __init__(self, spark: SparkSession, root: str | None = None, most_columns: int | None = None):
        self.spark, self.most_columns = spark, most_columns
        self.root = root or fresh(spark, "catalog")

    def _definitions(self) -> DataFrame:
        """A row for each column of each user table."""
        ddl = "table_oid long, table_name string, clustered_type int, oid long, pos int, name string, type_val int, len int"
        found = children(self.spark, f"{self.root}/definitions")
        if not found:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.root}/definitions/{x}" for x in found])

    def define(self, name: str, columns: list[tuple[str, str]], clustering: str = "heap") -> int:
        """Adds a table and returns its oid. The first column is the key and must be int64; names ignore case."""
        kinds = {n: (val, size) for _, n, val, size in TYPES}
        lowered = [c.lower() for c, _ in columns]
        known = self._definitions()
        if name.lower() in {n for _, n in SYSTEM_TABLES} or not known.filter(F.lower("table_name") == name.lower()).isEmpty():
            raise CatalogError(f"table exists: {name}")
        if not columns or (self.most_columns and len(columns) > self.most_columns):
            raise CatalogError(f"1 to {self.most_columns} columns" if columns else "no columns")
        if len(set(lowered)) < len(lowered):
            raise CatalogError("a column name repeats")
        if unknown := [k for _, k in columns if k.lower() not in kinds]:
            raise CatalogError(f"unknown type: {unknown[0]}")
        if columns[0][1].lower() != "int64":
            raise CatalogError("the first column is the key and must be int64")
        if clustering.lower() not in CLUSTERED:
            raise CatalogError(f"unknown clustering: {clustering}")
        oid = self.last_oid() + 1
        rows = [(oid, name, CLUSTERED[clustering.lower()], oid + 1 + pos, pos, c, *kinds[k.lower()]) for pos, (c, k) in enumerate(columns)]
        number = len(children(self.spark, f"{self.root}/definitions"))
        made = self.spark.createDataFrame(rows, known.schema).coalesce(1)
        made.write.mode("errorifexists").parquet(f"{self.root}/definitions/{number:08d}")
        return oid

    def last_oid(self) -> int:
        return self._definitions().agg(F.max("oid")).first()[0] or LAST_SYSTEM_OID

    def opened(self, name: str) -> tuple[int, list[tuple[str, str]], str]:
        """(oid, (column, type) in order, clustering) of a user table by its name, in any case."""
        rows = self._definitions().filter(F.lower("table_name") == name.lower()).orderBy("pos").collect()  # its columns
        if not rows:
            raise LookupError(f"no such table: {name}")
        names = {val: n for _, n, val, _ in TYPES}
        clustering = next(k for k, v in CLUSTERED.items() if v == rows[0]["clustered_type"])
        return rows[0]["table_oid"], [(r["name"], names[r["type_val"]]) for r in rows], clustering

    def name_of(self, oid: int) -> str:
        """The name of a table by its oid."""
        found = self.tables().filter(F.col("oid") == oid).first()
        if found is None:
            raise LookupError(f"no such oid: {oid}")
        return found["name"]

    def types(self) -> DataFrame:
        return self.spark.createDataFrame(TYPES, TYPES_DDL)

    def tables(self) -> DataFrame:
        own = self._definitions().select(F.col("table_oid").alias("oid"), F.lit(PUBLIC).cast("long").alias("namespace_oid"), F.col("table_name").alias("name"), "clustered_type").distinct()
        return self.spark.createDataFrame([(oid, SYS, name, CLUSTERED["heap"]) for oid, name in SYSTEM_TABLES], TABLES_DDL).unionByName(own)

    def objects(self) -> DataFrame:
        return self.tables().select("oid", "namespace_oid", F.lit(TABLE_OID).cast("long").alias("type_oid"), F.lit(0).cast("long").alias("rel_id"), "name")

    def columns(self) -> DataFrame:
        return self._definitions().select("oid", F.col("table_oid").alias("rel_id"), "pos", "name", "type_val", "len", F.lit(True).alias("notnull"))

    def describe(self) -> DataFrame:
        """One row for each column of each user table."""
        kinds = self.types().select("type_val", F.col("name").alias("type_name"))
        return self._definitions().join(F.broadcast(kinds), "type_val").select(  # the nine types
            "table_name", "pos", F.col("name").alias("column_name"), "type_name", "len", "clustered_type"
        )

    def meta(self) -> DataFrame:
        """One row: the last oid given, and how many objects, tables and columns there are."""
        told = self._definitions().agg(
            F.coalesce(F.max("oid"), F.lit(LAST_SYSTEM_OID)).cast("long").alias("last_oid"), F.count_distinct("table_oid").alias("n"), F.count("*").alias("n_columns")
        )
        tables = F.col("n") + len(SYSTEM_TABLES)
        return told.select("last_oid", tables.alias("n_objects"), tables.alias("n_tables"), "n_columns")
