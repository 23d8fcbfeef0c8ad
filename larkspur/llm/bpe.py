"""Operator 1: byte-level BPE encoding by overlapping chunks, and decoding.

A text of more than `chunk_chars` code points is cut into chunks that overlap; every chunk is pre-tokenised
on its own, in parallel. A boundary depends on the text after it alone, so from the first boundary that two
neighbours agree on, in their overlap, the later chunk's boundaries are those of the whole text. Each chunk
then encodes its pieces between its own agreed boundary and the next chunk's. A shorter text is one chunk,
which agrees with itself, and needs no shuffle.

Chunks begin where a white-space run and characters on both sides of it lie within the overlap, so that
neighbours meet; a run of characters without white space is never cut, and the chunk that holds it is as
long. With a pattern whose matches run over white space neighbours may still agree nowhere; such a text is
taken as one chunk.

Defined results: a null text encodes as the empty text (no ids), null ids decode to the empty bytes. Rows
that repeat, null keys and columns of any name pass through; the result has one row per input row.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, ready_python, scratch, text_of

#: Of the shared cache of encoded pieces in a Python worker; it is emptied when full, which changes no result.
CACHE_PIECES = 120_000
#: A match that ends this close to a chunk's end may be longer, or another one, in the whole text.
MARGIN = 4


class Vocabulary:
    """Merge ranks and pre-token pattern; small (its file's size) and so shipped with the tasks."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks_file, self.pattern = ranks_file, pattern

    @classmethod
    def from_path(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)


#: White space between other characters: every pre-token ends before it or begins in it.
GAP = regex.compile(r"\S\s+\S")


@lru_cache(maxsize=4)
def _coder(ranks_file: bytes, pattern: str):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _Pieces(coder), _pattern(pattern)


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@lru_cache(maxsize=4)
def _bytes_of(ranks_file: bytes) -> pa.Array:
    """The bytes of each id, at its place; null where there is no such id."""
    known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks_file.splitlines())}
    return pa.array([known.get(k) for k in range(max(known) + 1)], pa.binary())


class _Pieces(dict):
    """piece -> its ids as packed 32-bit integers."""

    def __init__(self, coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = found = np.array(self.coder._encode_single_piece(piece), dtype="<i4").tobytes()
        return found


def starts(text: str, chunk_chars: int, overlap: int) -> list[int]:
    """Where the chunks of a text begin."""
    out = [0]
    while len(text) - out[-1] > chunk_chars:
        at = out[-1] + chunk_chars - overlap
        gap = GAP.search(text, at)
        if gap is None:
            break
        if gap.end() > at + overlap - MARGIN:  # a long run of characters, or of white space
            at = max(at, min(gap.start(), gap.end() - overlap + MARGIN))
        out.append(at)
    return out


def pieces_of(pattern: regex.Pattern, text: str, first: int = 0, last: int | None = None) -> list[str]:
    """The matches from boundary `first` on, up to boundary `last` (the text's end)."""
    if last is None and not pattern.groups:
        return pattern.findall(text, first)
    out = []
    for m in pattern.finditer(text, first):
        if last is not None and m.end() > last:
            break
        out.append(m.group())
    return out


def _id_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids",
           chunk_chars: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """docs with the column `out` (array<int>): the ids of the whole text, each match of the pattern encoded by itself."""
    if not 2 * MARGIN < overlap <= chunk_chars // 2:
        raise ValueError("overlap must be over 8 and at most half of chunk_chars")
    spark = docs.sparkSession
    ready_python(spark)
    shipped = spark.sparkContext.broadcast((vocabulary.ranks_file, vocabulary.pattern))

    @F.arrow_udf("array<struct<start:int,t:string,head:boolean,tail:boolean>>")
    def chunks(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            at = starts(t, chunk_chars, overlap)
            stops = [*(x + overlap for x in at[1:]), len(t)]
            rows.append([{"start": i, "t": t[i:j], "head": i > 0, "tail": j < len(t)} for i, j in zip(at, stops)])
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("t", pa.string()), ("head", pa.bool_()), ("tail", pa.bool_())])))

    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def pretokenise(texts: pa.Array, begin: pa.Array, head: pa.Array, tail: pa.Array) -> pa.Array:
        """Boundaries in the overlaps with the chunks before and after, in code points of the whole text."""
        pattern, rows = _pattern(shipped.value[1]), []  # workers that only pre-tokenise hold no ranks
        for t, at, has_head, has_tail in zip(*(x.to_pylist() for x in (texts, begin, head, tail))):
            ends = np.fromiter((m.end() for m in pattern.finditer(t)), np.int32)
            ends = ends[ends <= len(t) - MARGIN] if has_tail else ends
            rows.append({
                "head": np.concatenate([[0], ends[ends <= overlap]]) + at if has_head else [],
                "tail": ends[ends >= len(t) - overlap] + at if has_tail else [],
            })
        return pa.array(rows, pa.struct([(x, pa.list_(pa.int32())) for x in ("head", "tail")]))

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        """The ids of a chunk's pieces from boundary `first` to boundary `last` (null: the end)."""
        pieces, pattern = _coder(*shipped.value)
        chunk = zip(*(x.to_pylist() for x in (texts, first, last)))
        return _id_lists([b"".join(map(pieces.__getitem__, pieces_of(pattern, t, a, b))) for t, a, b in chunk])

    end, begin = F.lit(None).cast("int"), F.lit(0)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), text_of(F.col(f"`{text}`")).alias("t"))
    one = src.filter(F.length("t") <= chunk_chars).select("r", encoded("t", begin, end).alias("ids"))

    # numbered and written, so that a task that runs again gives chunks the same document
    many = src.filter(F.length("t") > chunk_chars).withColumn("key", F.monotonically_increasing_id())
    cut = many.select("key", F.posexplode(chunks("t")).alias("k", "c"), "r")
    cut = scratch(cut.select("key", "k", "c.*", F.when(F.col("k") == 0, F.col("r")).alias("r")), "chunks")  # the row once for each document
    bounds = cut.repartition("key", "k").select("key", "k", "start", pretokenise("t", "start", "head", "tail").alias("p"))
    along, doc = Window.partitionBy("key").orderBy("k"), Window.partitionBy("key")
    agreed = F.array_min(F.array_intersect(F.lag("p.tail").over(along), F.col("p.head")))
    stitched = (
        bounds.withColumn("from", F.when(F.col("k") == 0, 0).otherwise(agreed))
        .withColumn("to", F.lead("from").over(along))
        .withColumn("agree", F.min(F.col("from").isNotNull()).over(doc))
        .select("key", "k", "agree", (F.col("from") - F.col("start")).alias("from"), (F.col("to") - F.col("start")).alias("to"))
    )
    held = cut.select("key", "k", "t", "r").join(stitched, ["key", "k"])
    agree = F.col("agree")
    parts = held.select("key", "k", "r", "agree", encoded(F.when(agree, F.col("t")).otherwise(""), F.coalesce("from", begin), F.when(agree, F.col("to"))).alias("ids"))
    joined = parts.groupBy("key").agg(
        F.first("r", ignorenulls=True).alias("r"),
        F.first("agree").alias("agree"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"),
    )
    as_one = encoded(F.when(agree, "").otherwise(F.col(f"r.`{text}`")), begin, end)
    joined = joined.withColumn("ids", F.when(agree, F.col("ids")).otherwise(as_one))
    ids = one.unionByName(joined.select("r", "ids"))
    return ids.select(*[F.col("r")[c].alias(c) for c in docs.columns], F.col("ids").alias(free_name(docs, out)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with the column `out` (binary): the bytes of the ids, one after the other. An unknown id is an error."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary.ranks_file)
    ready_python(df.sparkSession)

    @F.arrow_udf("binary")
    def to_bytes(lists: pa.Array) -> pa.Array:
        ids = lists.flatten()
        tokens = _bytes_of(shipped.value).take(ids)
        if tokens.null_count:
            raise KeyError(f"unknown id: {ids.filter(tokens.is_null())[0].as_py()}")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), pa.scalar(b"", pa.binary()))

    return df.withColumn(free_name(df, out), to_bytes(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))))
