"""Row text and row integrity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_text(rendered: dict[str, Column]) -> Column:
    """`col=value, col=value`."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit(""))) for name, c in rendered.items()])


def row_hash(*columns: Column) -> Column:
    """What a log record is checked by."""
    return F.xxhash64(*columns)
