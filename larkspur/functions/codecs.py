"""Text codecs of the nine scalar types, as Column expressions.

`valid(kind, s)` tells whether a text is a value of the type, `encode` gives the value (null where the text
is not valid; use `checked` to raise instead) and `render` gives a value's text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float": T.BinaryType(),
    "decimal": T.DecimalType(19, 4),
    "bool": T.BooleanType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
}
INTEGERS = ("int8", "int16", "int32", "int64")
#: Types whose values have an order that conditions may use.
ORDERED = (*INTEGERS, "decimal", "bool", "varchar", "char")


def kind_of(name: str) -> str:
    """The type of a name in any case."""
    found = name.lower()
    if found not in SPARK_TYPES:
        raise ValueError(f"unknown type: {name}")
    return found


def valid(kind: str, s: Column) -> Column:
    """False for null, which only the types with a value for missing text accept: see `encode`."""
    if kind in INTEGERS:
        return F.coalesce(s.rlike(r"^[+-]?[0-9]+\z") & s.try_cast(SPARK_TYPES[kind]).isNotNull(), F.lit(False))
    if kind == "decimal":
        return F.coalesce(s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)\z") & _decimal(s).isNotNull(), F.lit(False))
    if kind == "float":
        return F.coalesce(s.rlike(r"^[0-9A-Fa-f]{8}\z"), F.lit(False))
    return F.lit(True)


def _decimal(s: Column) -> Column:
    """The number at the start of a text, cut past four digits; null if it has too many digits before the point."""
    cut = F.regexp_extract(s, r"^([+-]?[0-9]*(?:\.[0-9]{0,4})?)", 1)
    return F.when(cut.rlike("[0-9]"), cut).otherwise("0").try_cast(SPARK_TYPES["decimal"])


def encode(kind: str, s: Column) -> Column:
    """The value of a text. Decimals are cut, not rounded, past four digits; bool is true for `1` and `true`
    alone; null is false as bool and empty as text."""
    if kind in INTEGERS:
        return F.when(valid(kind, s), s.try_cast(SPARK_TYPES[kind]))
    if kind == "decimal":
        return F.when(valid(kind, s), _decimal(s))
    if kind == "float":
        return F.when(valid(kind, s), F.unhex(s))
    if kind == "bool":
        return F.coalesce(s.isin("1", "true"), F.lit(False))
    return F.coalesce(s, F.lit(""))


def checked(kind: str, s: Column) -> Column:
    """As encode, but the query fails on a text that is not valid."""
    told = F.concat(F.lit(f"not a value of {kind}: "), F.coalesce(s, F.lit("null")))
    return F.when(valid(kind, s), encode(kind, s)).otherwise(F.raise_error(told).cast(SPARK_TYPES[kind]))


def render(kind: str, value: Column) -> Column:
    if kind == "float":
        return F.lower(F.hex(value))
    return value.cast("string")


def encoded_bytes(kind: str, value: Column) -> Column:
    """Bytes of a value in a packed row."""
    if kind in ("varchar", "char"):
        return F.octet_length(value) + 2
    return F.lit({"int8": 1, "int16": 2, "int32": 4, "int64": 8, "float": 4, "decimal": 8, "bool": 1}[kind])
