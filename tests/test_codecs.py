from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspur.functions import codecs

VECTORS = {
    "int8": [("127", "127"), ("-128", "-128"), ("128", None), ("", None), ("1x", None), ("+7", "7"), (" 4", None), ("12\n", None)],
    "int64": [("9223372036854775807", "9223372036854775807"), ("9223372036854775808", None)],
    "decimal": [
        ("1", "1.0000"), ("1.23456", "1.2345"), ("-1.23456", "-1.2345"), ("-0.5", "-0.5000"), (".5", "0.5000"), (".", "0.0000"),
        ("1.", "1.0000"), ("1e3", None), ("-", None), ("", None), ("+2.5", "2.5000"), (None, None), ("1.5\n", None), ("99999999999999999999", None), ("999999999999999.99999", "999999999999999.9999"),
    ],
    "bool": [("1", "true"), ("true", "true"), ("TRUE", "false"), ("yes", "false"), ("0", "false"), ("", "false"), (None, "false")],
    "float": [("3f800000", "3f800000"), ("3F800000", "3f800000"), ("3f8", None), ("zz800000", None), ("1.0", None), ("3f800000\n", None)],
    "varchar": [("abc", "abc"), ("", ""), (None, "")],
    "char": [("ab", "ab")],
}


@pytest.mark.parametrize("kind", VECTORS)
def test_vectors(spark, kind):
    df = spark.createDataFrame([(a, b) for a, b in VECTORS[kind]], "a string, b string")
    got = df.select("a", "b", codecs.render(kind, codecs.encode(kind, F.col("a"))).alias("c")).collect()
    assert [r["c"] for r in got] == [r["b"] for r in got]


def test_checked_fails(spark):
    with pytest.raises(Exception, match="not a value of int8"):
        spark.createDataFrame([("300",)], "a string").select(codecs.checked("int8", F.col("a"))).collect()


def test_decimal_type(spark):
    got = spark.createDataFrame([("2.00019",)], "a string").select(codecs.encode("decimal", F.col("a")).alias("v")).first()
    assert got["v"] == Decimal("2.0001")


@pytest.mark.parametrize("kind, text", [("decimal", "99999999999999999999"), ("float", "3f800000\n"), ("int64", "5\n"), ("int32", None)])
def test_checked_never_gives_null(spark, kind, text):
    with pytest.raises(Exception, match="not a value"):
        spark.createDataFrame([(text,)], "a string").select(codecs.checked(kind, F.col("a"))).collect()
