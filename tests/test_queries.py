import duckdb
import pytest

from larkspur.queries import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], "sf0.001")


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_codec_float_keeps_every_digit(spark, tmp_path):
    # 542362 gives the last number of eight digits
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT unnest([NULL, 0, 1, 542362, 542363, 8677598, 8999999, 2221464910, 1164000000000000, -1, -542363, -1164000000000000]::BIGINT[]) AS o_orderkey)
                TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    ours = QUERIES["codec_float"](spark, str(tmp_path)).select("o_orderkey", "value").collect()
    expected = con.sql(SQL["codec_float"]).fetchall()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, expected))
