"""Operator 6: drop lines that other documents hold too.

Lines are exploded with their normalised key (white space stripped at both ends, A-Z lower-cased), keys
are hashed, and for each hash the smallest and largest document are kept as partial sums. A key that at
least `min_documents` documents hold loses its lines, but for those in the smallest document. Texts are
put together again from the lines that stay, by position.

Defined results: a null or empty text is one empty line, and keys of fewer than `min_chars` code points
are never dropped. Rows of equal id are one document; each gets its own result. Null ids are one
document, behind all others. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, scratch, text_of

#: Stands for a null id.
LAST = 2**63 - 1
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _cut(docs: DataFrame, id_col: str, text: str, min_chars: int, min_documents: int) -> DataFrame:
    """(r, kept, n_lines, n_dropped): r has docs' columns. A text goes through one shuffle, once, and through no sort."""
    def lines(t: Column) -> Column:
        return F.split(text_of(t), "\n")

    src = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("row1"),
        F.xxhash64(F.lit(1), F.col(f"`{text}`"), F.col(f"`{id_col}`")).alias("row2"),
    )
    keyed = (
        src.select("doc", "row1", "row2", F.posexplode(F.transform(lines(F.col(f"r.`{text}`")), line_key)).alias("at", "key"))
        .filter(F.length("key") >= min_chars)
        .select("doc", "row1", "row2", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    )
    if min_documents == 2:
        counts = keyed.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first != last")
    else:
        per_doc = keyed.groupBy("h", "g", "doc").agg(F.lit(1).alias("one"))
        counts = per_doc.groupBy("h", "g").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    # written, so that the join reads it directly and adaptive execution can split a hot key's rows
    shared = scratch(counts.select("h", "g", "first"), "shared")
    gone = keyed.join(shared, ["h", "g"]).filter("doc != first")
    places = gone.groupBy("row1", "row2").agg(F.collect_set("at").alias("gone"))  # of one document
    # positions are hashed, texts stream by: a sort would hold whole texts
    cut = src.join(places.hint("shuffle_hash"), ["row1", "row2"], "left").select("r", "gone", lines(F.col(f"r.`{text}`")).alias("lines"))
    places_left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    stays = F.transform(places_left, lambda i: F.get("lines", i))
    return cut.select(
        "r",
        F.array_join(stays, "\n").alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """docs, with integer ids, with `kept` (the text that stays), `n_lines` (before) and `n_dropped`.

    A key is told by a 128-bit hash. Explosion, counts and the join back carry hashes, ids and positions
    only; a key that very many documents hold is one partial sum per task, and a skewed join key after.
    """
    out = _cut(docs, id_col, text, min_chars, min_documents)
    return out.select(*[F.col("r")[c].alias(c) for c in docs.columns], *[F.col(c).alias(free_name(docs, c)) for c in ("kept", "n_lines", "n_dropped")])


def without_shared(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """docs with the same rows and columns, their texts without dropped lines (empty if all were).

    A null text stays null. A column n_chars, if there is one, follows the new text.
    """
    out, lost = _cut(docs, id_col, text, min_chars, min_documents), F.col("n_dropped") > 0
    new = {text: F.when(lost, F.col("kept")).otherwise(F.col("r")[text])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("kept")).otherwise(F.col("r")["n_chars"])
    kinds = dict(docs.dtypes)
    return out.select(*[(new[c].cast(kinds[c]) if c in new else F.col("r")[c]).alias(c) for c in docs.columns])
