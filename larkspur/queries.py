"""The library's queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import codecs, rows
from larkspur.operators import conditions, keys, versions
from larkspur.plans import replay
from larkspur.sources.catalog import Catalog, kind_of_spark
from larkspur.sources.paths import fresh
from larkspur.sources.tables import Tables
from larkspur.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans and conditions


@query("SELECT * FROM orders")
def scan_all(spark, d):
    return conditions.where(table(spark, d, "orders"))


@query("SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderstatus = 'F'")
def scan_filter(spark, d):
    return conditions.where(table(spark, d, "orders"), ("o_orderkey", ">=", 100), ("o_orderstatus", "=", "F"))


def _one_condition(op: str) -> None:
    names = {"=": "eq", "!=": "neq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
    query(f"SELECT * FROM orders WHERE o_orderkey {op} 100", f"filter_{names[op]}")(
        lambda spark, d: conditions.where(table(spark, d, "orders"), ("o_orderkey", op, 100))
    )


for _op in conditions.OPS:
    _one_condition(_op)


@query("SELECT * FROM customer WHERE c_nationkey >= 5 AND c_acctbal > 100 AND c_mktsegment != 'BUILDING'")
def filter_and_chain(spark, d):
    return conditions.where(table(spark, d, "customer"), ("c_nationkey", ">=", 5), ("c_acctbal", ">", 100), ("C_MKTSEGMENT", "!=", "BUILDING"))


@query("SELECT * FROM orders WHERE o_orderstatus = NULL")
def filter_eq_null(spark, d):
    return conditions.where(table(spark, d, "orders"), ("o_orderstatus", "=", None))


@query("SELECT count(*) AS n_rows FROM orders")
def scan_footer(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"))


@query("SELECT s_suppkey, concat('s_suppkey=', s_suppkey, ', s_name=', s_name) AS row_text FROM supplier")
def scan_row_text(spark, d):
    df = table(spark, d, "supplier")
    shown = {"s_suppkey": codecs.render("int64", F.col("s_suppkey")), "s_name": codecs.render("varchar", F.col("s_name"))}
    return df.select("s_suppkey", rows.row_text(shown).alias("row_text"))


# --- codecs


#: Texts of a number n by o_orderkey % 6: as it is, with a plus, with a letter, after a blank, with many digits more, none, with a line end.
_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN concat(n, '') WHEN 1 THEN concat('+', n) WHEN 2 THEN concat(n, 'x') WHEN 3 THEN concat(' ', n)
           WHEN 4 THEN concat(n, '99999999999999') WHEN 5 THEN '' ELSE concat(n, chr(10)) END"""


def _integers(kind: str, low: int, high: int) -> None:
    query(
        f"""SELECT o_orderkey, fits, CASE WHEN fits THEN CAST(m AS BIGINT) ELSE 0 END AS value FROM
            (SELECT *, coalesce(m BETWEEN {low} AND {high}, false) AS fits FROM
             (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN n WHEN 1 THEN CASE WHEN n >= 0 THEN n END
                                 WHEN 4 THEN n * 100000000000000::HUGEINT + CASE WHEN n < 0 THEN -99999999999999 ELSE 99999999999999 END END AS m
              FROM (SELECT o_orderkey, CAST(o_orderkey * 37 - 9000 AS HUGEINT) AS n FROM orders)))""",
        f"codec_{kind}",
    )(
        lambda spark, d: table(spark, d, "orders")
        .withColumn("n", F.col("o_orderkey") * 37 - 9000)
        .withColumn("text", F.expr(_TEXT))
        .select("o_orderkey", codecs.valid(kind, F.col("text")).alias("fits"), F.coalesce(codecs.encode(kind, F.col("text")).cast("long"), F.lit(0)).alias("value"))
    )


_integers("int8", -128, 127)
_integers("int16", -32768, 32767)
_integers("int32", -(2**31), 2**31 - 1)
_integers("int64", -(2**63) + 1, 2**63 - 1)


@query("""SELECT l_orderkey, l_linenumber, CAST(-(CAST(round(l_extendedprice * 100) AS BIGINT) * 125 // 10) AS BIGINT) AS value, count(*) AS n
          FROM lineitem GROUP BY ALL""")
def codec_decimal(spark, d):
    # an eighth of a price has five digits; the last is cut off, not rounded
    eighth = (F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)") * F.lit(125).cast("decimal(3,0)")).cast("string")
    text = F.concat(F.lit("-"), F.col("whole"), F.lit("."), F.col("rest"))
    df = table(spark, d, "lineitem").withColumn("eighth", F.lpad(eighth, 12, "0"))
    df = df.withColumn("whole", F.expr("left(eighth, 7)")).withColumn("rest", F.expr("right(eighth, 5)"))
    value = (codecs.encode("decimal", text) * 10000).cast("long")
    return df.groupBy("l_orderkey", "l_linenumber", value.alias("value")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, m IS NOT NULL AS fits, coalesce(m, 0) AS value FROM
          (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN n * 10 + 5 WHEN 1 THEN CASE WHEN n < 10 THEN (n * 100000000000000 + 99999999999999) * 10 END
                              WHEN 2 THEN n * 10 END AS m FROM (SELECT o_orderkey, o_orderkey // 9 AS n FROM orders))""")
def codec_decimal_text(spark, d):
    # half a unit; over fifteen digits, but for the first; a point alone; a letter; a line end
    df = table(spark, d, "orders").withColumn("n", F.expr("o_orderkey div 9"))
    text = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN concat(n, '.50009') WHEN 1 THEN concat(n, '99999999999999') WHEN 2 THEN concat(n, '.')
                     WHEN 3 THEN concat(n, 'e1') ELSE concat(n, chr(10)) END""")
    value = (codecs.encode("decimal", text).cast("decimal(24,4)") * 10).cast("long")
    return df.select("o_orderkey", codecs.valid("decimal", text).alias("fits"), F.coalesce(value, F.lit(0)).alias("value"))


@query("SELECT o_orderkey, o_orderstatus IN ('1', 'true') OR o_orderkey % 2 = 1 AS value FROM orders")
def codec_bool(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 1, F.when(F.col("o_orderkey") % 4 == 1, "1").otherwise("true")).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", codecs.encode("bool", text).alias("value"))


@query("SELECT o_orderkey, lower(printf('%08X', o_orderkey * 7919)) AS value FROM orders")
def codec_float(spark, d):
    # a long's 16 digits are two floats; of the first, the zeros before the number go
    text = F.lpad(F.hex(F.col("o_orderkey") * 7919), 16, "0")
    first, last = (codecs.render("float", codecs.encode("float", F.substring(text, k, 8))) for k in (1, 9))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.ltrim(first, F.lit("0")), last).alias("value"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, '') AS value, octet_length(encode(coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, ''))) + 2 AS n_bytes FROM part")
def codec_text(spark, d):
    value = codecs.encode("varchar", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", value.alias("value"), codecs.encoded_bytes("varchar", value).cast("long").alias("n_bytes"))


# --- catalog


@query("""SELECT CAST(oid AS BIGINT) AS oid, name, type_val, len FROM (VALUES (25,'int8',0,1),(26,'int16',1,2),(27,'int32',2,4),(12,'int64',3,8),(28,'float',4,4),
          (29,'decimal',5,8),(15,'bool',6,1),(13,'varchar',7,0),(24,'char',8,0)) t(oid, name, type_val, len)""")
def catalog_types(spark, d):
    return Catalog(spark).types()


_CATALOG_TABLES = {"supplier": "heap", "customer": "btree", "orders": "heap"}
#: The columns of the tables, as the database tells them, with the oids that definitions one after the other give.
_CATALOG = "(WITH c AS (" + " UNION ALL ".join(
    f"SELECT {k} AS nth, '{name}' AS table_name, {int(clustering == 'btree')} AS clustered_type, row_number() OVER () - 1 AS pos, column_name, column_type FROM (DESCRIBE {name})"
    for k, (name, clustering) in enumerate(_CATALOG_TABLES.items())
) + """), n AS (SELECT nth, count(*) + 1 AS n FROM c GROUP BY nth)
    SELECT table_name, clustered_type, CAST(pos AS INTEGER) AS pos, column_name,
           CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'decimal' ELSE 'varchar' END AS type_name,
           4001 + coalesce((SELECT CAST(sum(n) AS BIGINT) FROM n WHERE n.nth < c.nth), 0) AS table_oid FROM c)"""


def _catalog(spark: SparkSession, d: str) -> Catalog:
    """Defined from the tables' own schemas, and opened again."""
    made = Catalog(spark)
    for name, clustering in _CATALOG_TABLES.items():
        made.define(name, [(f.name, kind_of_spark(f.dataType)) for f in table(spark, d, name).schema.fields], clustering)
    return Catalog(spark, made.root)


_SYSTEM = "(VALUES (100, 'types'), (110, 'objects'), (111, 'columns'), (112, 'tables')) s(oid, name)"


@query(f"""SELECT CAST(oid AS BIGINT) AS oid, 0::BIGINT AS namespace_oid, 21::BIGINT AS type_oid, 0::BIGINT AS rel_id, name FROM {_SYSTEM}
           UNION ALL SELECT DISTINCT table_oid, 1::BIGINT, 21::BIGINT, 0::BIGINT, table_name FROM {_CATALOG}""")
def catalog_objects(spark, d):
    return _catalog(spark, d).objects()


@query(f"""SELECT CAST(oid AS BIGINT) AS oid, 0::BIGINT AS namespace_oid, name, 0 AS clustered_type FROM {_SYSTEM}
           UNION ALL SELECT DISTINCT table_oid, 1::BIGINT, table_name, clustered_type FROM {_CATALOG}""")
def catalog_tables(spark, d):
    return _catalog(spark, d).tables()


@query(f"""SELECT table_name, pos, column_name, type_name, CASE type_name WHEN 'varchar' THEN 0 WHEN 'int32' THEN 4 ELSE 8 END AS len, clustered_type FROM {_CATALOG}""")
def catalog_describe(spark, d):
    return _catalog(spark, d).describe()


@query(f"""SELECT CAST(max(table_oid + pos + 1) AS BIGINT) AS last_oid, count(DISTINCT table_oid) + 4 AS n_objects, count(DISTINCT table_oid) + 4 AS n_tables, count(*) AS n_columns FROM {_CATALOG}""")
def show_meta(spark, d):
    return _catalog(spark, d).meta()


# --- inserts


def _supplier(spark: SparkSession, d: str, clustering: str) -> Tables:
    made = Tables(spark)
    made.create("supplier", [("s_suppkey", "int64"), ("s_name", "varchar"), ("s_nationkey", "int32"), ("s_acctbal", "decimal")], clustering)
    df = table(spark, d, "supplier")
    texts = df.select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("decimal(18,2)").alias("s_acctbal"), F.col("s_suppkey").alias("nth"))
    made.insert("supplier", texts, "nth")
    made.insert("supplier", texts.filter("s_suppkey % 2 = 0"), "nth")  # each refused
    return made


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def create_insert_scan(spark, d):
    return _supplier(spark, d, "heap").scan("SUPPLIER").withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey >= 3 AND s_acctbal > 0")
def create_insert_clustered(spark, d):
    return _supplier(spark, d, "btree").scan("supplier", ("s_suppkey", ">=", 3), ("s_acctbal", ">", "0")).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query("SELECT count(*) AS n_rows, 2 AS n_folders FROM supplier")
def show_storage(spark, d):
    return _supplier(spark, d, "heap").storage("supplier").select("n_rows", "n_folders")


def _changed(spark: SparkSession, d: str, clustering: str) -> Tables:
    """Suppliers, of whom some got another balance, some were deleted, and some of these inserted again."""
    made = _supplier(spark, d, clustering)
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.lit("1.5").alias("s_acctbal"), F.col("s_suppkey").alias("nth"))
    made.update("supplier", df.filter("s_suppkey % 3 = 0"), "nth")
    made.delete("supplier", ("s_nationkey", "<", 12))
    made.insert("supplier", df.filter("s_suppkey % 5 = 0").withColumn("s_name", F.lit("again")), "nth")
    return Tables(spark, made.root)  # opened anew


_CHANGED = """SELECT s_suppkey, CASE WHEN again THEN 'again' ELSE s_name END AS s_name, s_nationkey, CASE WHEN again OR s_suppkey % 3 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal
              FROM (SELECT *, s_nationkey < 12 AND s_suppkey % 5 = 0 AS again FROM supplier) WHERE s_nationkey >= 12 OR again"""


@query(_CHANGED)
def update_delete_scan(spark, d):
    return _changed(spark, d, "heap").scan("supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query(f"SELECT * FROM ({_CHANGED}) WHERE s_suppkey >= 20 AND s_name != 'again'")
def update_delete_filter(spark, d):
    return _changed(spark, d, "btree").scan("supplier", ("s_suppkey", ">=", 20), ("s_name", "!=", "again")).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query(_CHANGED)
def compacted_scan(spark, d):
    made = _changed(spark, d, "btree")
    made.compact("supplier")
    return made.scan("supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
def table_as_of(spark, d):
    # two inserts and the update; the deletion came later
    return _changed(spark, d, "heap").as_of("supplier", 3).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query(f"SELECT s_suppkey AS k, s_name FROM ({_CHANGED})")
def table_log_replay(spark, d):
    log = _changed(spark, d, "heap").log("supplier").withColumnRenamed("s_suppkey", "k")
    return replay.replay(log, "k", ["s_name"], lsn="v_", kind="op_")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def insert_first_wins(spark, d):
    return keys.accepted(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id")


@query("""SELECT event_id, user_id, CASE WHEN user_id < 5 OR event_id <> min(event_id) OVER (PARTITION BY user_id) THEN 'duplicate' ELSE 'ok' END AS status FROM events""")
def insert_statuses(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    return keys.statuses(events, "user_id", "event_id", events.filter("user_id < 5"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 AND user_id >= 5")
def insert_new_keys(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    return keys.accepted(events, "user_id", "event_id", events.filter("user_id < 5"))


# --- ordered tables and indexes


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders")
def ordered_scan(spark, d):
    return keys.ranked(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 64)


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "index")
    keys.index(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 8).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 300")
def index_range(spark, d):
    return conditions.where(_indexed(spark, d), ("o_orderkey", ">=", 200), ("o_orderkey", "<", 300))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777")
def index_point(spark, d):
    return conditions.where(_indexed(spark, d), ("o_orderkey", "=", 777))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id * 3 FROM events WHERE event_id IS NOT NULL)")
def index_delete_keys(spark, d):
    gone = table(spark, d, "events").select((F.col("event_id") * 3).alias("o_orderkey"))
    return keys.without_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


# --- versions

_LOG_SQL = "(SELECT user_id, event_id + 1 AS v, CASE WHEN event_type = 'purchase' OR event_id % 7 = 3 THEN 2 ELSE 1 END AS op, value FROM events)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    op = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 7 == 3), versions.DELETE).otherwise(versions.WRITE)
    return table(spark, d, "events").select("user_id", (F.col("event_id") + 1).alias("v"), op.alias("op"), "value")


@query(f"SELECT user_id, v, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS n FROM {_LOG_SQL}) WHERE n = 1 AND op = 1")
def current_rows(spark, d):
    return versions.as_of(_versions(spark, d), "user_id", "v", "op")


@query(f"SELECT user_id, v, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS n FROM {_LOG_SQL} WHERE v <= 500) WHERE n = 1 AND op = 1")
def snapshot_as_of(spark, d):
    return versions.as_of(_versions(spark, d), "user_id", "v", "op", 500)


_CHAIN = f"(SELECT *, v AS xmin, coalesce(lead(v) OVER w, 0) AS xmax, coalesce(lag(v) OVER w, 0) AS prev FROM {_LOG_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY v))"


@query(f"SELECT * FROM {_CHAIN}")
def version_history(spark, d):
    return versions.history(_versions(spark, d), "user_id", "v", 100)


@query(f"SELECT * FROM {_CHAIN} WHERE xmin <= 700 AND (xmax = 0 OR xmax > 700) AND op = 1")
def snapshot_visible(spark, d):
    return versions.visible(versions.history(_versions(spark, d), "user_id", "v", 100), "op", 700)


# --- change logs

_CHANGES = "(SELECT event_id AS lsn, event_id // 10 AS xid, user_id AS k, CASE WHEN event_id % 10 = 9 THEN CASE WHEN event_id % 30 = 29 THEN 5 ELSE 4 END WHEN event_id % 11 = 5 THEN 2 ELSE 1 END AS type, value FROM events)"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    end = F.when(e % 30 == 29, replay.ABORT).otherwise(replay.COMMIT)
    kind = F.when(e % 10 == 9, end).when(e % 11 == 5, replay.DELETE).otherwise(replay.INSERT)
    return table(spark, d, "events").select(
        e.alias("lsn"), F.expr("event_id div 10").alias("xid"), F.col("user_id").alias("k"), kind.alias("type"), "value"
    )


_FOLD = "SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS n FROM {log} WHERE type IN (1, 2)) WHERE n = 1 AND type = 1"


@query(_FOLD.format(log=_CHANGES))
def log_replay(spark, d):
    return replay.replay(_changes(spark, d), "k", ["value"])


@query(_FOLD.format(log=f"(SELECT * FROM {_CHANGES} WHERE xid IN (SELECT xid FROM {_CHANGES} WHERE type = 4))"))
def log_replay_committed(spark, d):
    return replay.replay(replay.committed(_changes(spark, d)), "k", ["value"])


@query(_FOLD.format(log=_CHANGES))
def log_replay_from_checkpoint(spark, d):
    log = _changes(spark, d)
    path = fresh(spark, "snapshot")
    replay.replay(log.filter("lsn <= 400"), "k", ["value"]).write.parquet(path)
    # a key deleted after the checkpoint is in the snapshot, and goes
    return replay.replay(log, "k", ["value"], spark.read.parquet(path), 400)


@query(_FOLD.format(log=f"(SELECT * FROM {_CHANGES} WHERE lsn < 900)"))
def log_replay_intact(spark, d):
    log = _changes(spark, d)
    expected = rows.row_hash("lsn", "k", "type", "value")
    stored = log.withColumn("h", F.when(F.col("lsn") == 900, F.lit(0).cast("long")).otherwise(expected))
    return replay.replay(replay.intact(stored, "h", expected), "k", ["value"])


@query(f"SELECT type, count(*) AS n FROM {_CHANGES} GROUP BY type")
def log_record_counts(spark, d):
    return replay.record_counts(_changes(spark, d))


@query(_FOLD.format(log=_CHANGES))
def log_stream(spark, d):
    path = fresh(spark, "stream")
    _changes(spark, d).filter("type IN (1, 2)").write.parquet(f"{path}/log")
    source = spark.readStream.schema("lsn long, xid long, k long, type int, value double").option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    return changes.drain(spark, source, "k", "lsn", "type", ["value"], path)


@query("""SELECT k, value FROM (SELECT user_id AS k, value, event_id % 11 = 5 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id DESC) AS n
                                FROM events WHERE event_id % 3 <> 1) WHERE n = 1 AND NOT gone""")
def log_append_replay(spark, d):
    # three transactions, of which the second is aborted
    path = fresh(spark, "log")
    kind = F.when(F.col("event_id") % 11 == 5, replay.DELETE).otherwise(replay.INSERT)
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), kind.alias("type"), "value")
    for k, rest in enumerate((2, 1, 0)):
        replay.append(spark, path, events.filter(F.col("event_id") % 3 == rest), "k", "event_id", ["value"], commit=k != 1)
    log = replay.read_log(spark, path)
    return replay.replay(replay.committed(replay.intact(log, "check", rows.row_hash("lsn", "xid", "type", "k", "value"))), "k", ["value"])
