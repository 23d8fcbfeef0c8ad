"""Conjunctions of comparisons between a column and a literal."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def condition(df: DataFrame, name: str, op: str, value: str | int | None) -> Column:
    """`name op value`; the literal is read as the column's type, so that the comparison reaches the scan."""
    if op not in OPS:
        raise ValueError(f"unknown operator: {op}")
    found = [f for f in df.schema.fields if f.name.lower() == name.lower()]
    if not found:
        raise ValueError(f"unknown column: {name}")
    kind = found[0].dataType
    if value is None:
        return OPS[op](F.col(found[0].name), F.lit(None).cast(kind))
    if kind.typeName() == "binary" and op not in ("=", "!="):
        raise ValueError(f"{name} has no order")
    literal = F.unhex(F.lit(value)) if kind.typeName() == "binary" else F.lit(value).cast(kind)
    return OPS[op](F.col(found[0].name), literal)


def where(df: DataFrame, *conditions: tuple[str, str, str | int | None]) -> DataFrame:
    """Rows that meet all conditions. A comparison with null meets none."""
    if not conditions:
        return df
    return df.filter(reduce(operator.and_, (condition(df, *c) for c in conditions)))
