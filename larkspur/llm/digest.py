"""Operator 9: document fingerprints as quartile bucket digests.

Byte triplets of a sliding window are hashed into 256 buckets and counted. A bucket's code, two bits,
tells between which quartiles of all buckets its count lies; one byte more holds the logarithm of the
length. Two digests differ by the sum of their code differences (6 instead of 3 for opposite quartiles)
and of their length difference, bounded by CAP; likeness is 1 for no difference and 0 from CAP on.

Defined results: a null text is the empty one, whose digest is all zero. Equal texts have equal digests.
`with_next` pairs each row with the next in descending id, null ids last, rows of equal id in the order
of their texts' hashes, and the last row with the first; one row alone is its own next.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, ready_python, scratch, text_of

BUCKETS = 256
CAP = 256
LENGTH_WEIGHT = 4
#: One random permutation of the byte values for each place in a triplet.
TABLES = [np.random.default_rng(k).permutation(256).astype(np.uint8) for k in range(3)]
#: Which bytes after the first of a window make triplets with it.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
STEPS = np.array([[abs(a - b) if abs(a - b) < 3 else 6 for b in range(4)] for a in range(4)], np.int32)


def digest(text: str) -> bytes:
    """65 bytes: the length, then 256 codes of two bits."""
    raw = np.frombuffer(text.encode(), np.uint8)
    a, b, c = (t[raw] for t in TABLES)
    counts = np.zeros(BUCKETS, np.int64)
    for i, j in TRIPLETS:
        if len(raw) > j:
            counts += np.bincount(a[: len(raw) - j] ^ b[i : len(raw) - j + i] ^ c[j:], minlength=BUCKETS)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > q[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
    return bytes([min(255, int(math.log(len(raw) + 1) / math.log(1.1)))]) + packed.tobytes()


def difference(x: bytes, y: bytes) -> int:
    """0 to CAP."""
    if x == y:
        return 0
    a, b = (np.frombuffer(z[1:], np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3 for z in (x, y))
    return min(CAP, int(STEPS[a, b].sum()) + LENGTH_WEIGHT * abs(x[0] - y[0]))


def likeness(x: bytes, y: bytes) -> float:
    return 1 - difference(x, y) / CAP


def edited(text: str, other: str) -> str:
    """text, its last third replaced by as many code points from the start of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


ROW = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
ROW_SQL = "kind string, part int, id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, own: bytes, other: str, theirs: bytes) -> dict:
    changed = edited(text, other)
    new = digest(changed)
    return {
        "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": own.hex(),
        "edited_fingerprint": new.hex(), "near_edited": likeness(own, new), "near_next": likeness(own, theirs),
    }


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its partition. The first row's text and the last row's go out too, to be paired over the border."""
    part, last, number, out = TaskContext.get().partitionId(), None, 0, []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = digest(text)
            if last is None:
                out.append({"kind": "first", "part": part, "id": key, "text": text})
            else:
                out.append({"kind": "row", "part": part, "id": last[0]} | _compared(*last[1:], text, own))
            last, number = (key, text, own), number + 1
        yield pa.RecordBatch.from_pylist(out, schema=ROW)
        out = []
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"kind": "last", "part": part, "id": last[0], "text": last[1]}], schema=ROW)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the digest of a text column, in hex, under the name `out` or one close to it."""
    ready_python(docs.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([digest(t).hex() for t in texts.to_pylist()])

    return docs.withColumn(free_name(docs, out), of(text_of(F.col(f"`{text}`"))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row; ids are integers.

    Texts go through one range shuffle; rows are paired as they stream through a partition, and the two
    texts at each partition's ends are paired by a join of as many rows as there are partitions.
    """
    spark = docs.sparkSession
    ready_python(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    src = src.withColumn("salt", F.spark_partition_id())  # rows equal in id and text are split by where they come from
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("salt")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = src.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt")
    table = scratch(ranged.mapInArrow(_pairs, ROW_SQL), "digests")
    first = table.filter("kind = 'first'").select(F.col("part").alias("at"), F.col("text").alias("other"))
    along = Window.orderBy("at")  # one row per partition
    follows = first.select("at").select(
        F.col("at").alias("part"),
        F.coalesce(F.lead("at").over(along), F.min("at").over(Window.partitionBy(F.lit(0)))).alias("at"),
    )

    @F.arrow_udf("struct<n_chars:long,edited_sha256:string,fingerprint:string,edited_fingerprint:string,near_edited:double,near_next:double>")
    def compared(texts: pa.Array, others: pa.Array) -> pa.Array:
        rows = [_compared(t, digest(t), o, digest(o)) for t, o in zip(texts.to_pylist(), others.to_pylist())]
        return pa.array(rows, pa.struct([ROW.field(x) for x in ROW.names[4:]]))

    ends = table.filter("kind = 'last'").select("part", "id", "text").join(follows, "part").join(first, "at")
    ends = ends.select("id", compared("text", "other").alias("c")).select("id", "c.*")
    return table.filter("kind = 'row'").select("id", *ROW.names[4:]).unionByName(ends)
