"""Operator 7: best-fit packing into sequences of several permitted lengths.

Pieces (documents, cut where they exceed the longest sequence) are dealt at random into groups of about
GROUP_ROWS pieces, and each group is packed on its own: longest first, into the open bin with the least
room that still holds the piece. If none does, a bin opens. Its size is the one that costs least for each
word it will hold, when the pieces still to come fill it greedily; so a long sequence opens only where
they can fill it. A group that another plan packs at less cost (one preferred length throughout) takes
that plan. At the end every bin is downsized to the shortest sequence that holds its contents.

The cost of a sequence is its length, a fixed overhead, and a part that grows with the square of its
length, as attention does.

Only ids and lengths are shuffled. Group sizes do not depend on keys, so nothing can be hot; the loss
from packing groups apart is at most a few part-filled bins in each. Defined results: a null or empty
text has length 0 and takes a place in a bin. Every row is packed, rows that repeat each by themselves.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import ready_python, scratch, text_of

#: Permitted lengths of a sequence, its fixed cost on top of its length, and the length at which the squared part is as large as the length.
CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
SQUARE = 32_768
#: Pieces packed together, about.
GROUP_ROWS = 10_000
WHITE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Words of a text: its length for packing, unless another column is named."""
    return F.size(F.array_remove(F.split(F.translate(text_of(text), WHITE, " " * len(WHITE)), " "), ""))


def cost_of(capacity: int, overhead: float = OVERHEAD, square: float = SQUARE) -> float:
    return capacity + overhead + capacity * capacity / square


def filled(lengths: list[int], at: int, room: int) -> int:
    """Words that go into the room, taking the longest that fits of lengths[at:] (longest first) again and again."""
    taken = 0
    while room and (at := bisect_left(lengths, -room, at, key=lambda x: -x)) < len(lengths) and lengths[at]:
        taken, room, at = taken + lengths[at], room - lengths[at], at + 1
    return taken


def place(lengths: list[int], opens: Callable[[int, int], int]) -> tuple[list[int], list[int]]:
    """(bin of each piece, words of each bin) of lengths in descending order; opens(place, need) gives a new bin's size."""
    words: list[int] = []
    bins = []
    is_open: list[tuple[int, int]] = []  # (room, bin), sorted
    for k, need in enumerate(lengths):
        at = bisect_left(is_open, (need, -1))
        if at < len(is_open):
            room, b = is_open.pop(at)
        else:
            room, b = opens(k, need), len(words)
            words.append(0)
        bins.append(b)
        words[b] += need
        insort(is_open, (room - need, b))
    return bins, words


def best_fit(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float] = cost_of) -> tuple[list[int], list[int]]:
    """(bin of each piece, size of each bin). Every length is at most the largest capacity."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    down, capacities = [lengths[i] for i in order], tuple(sorted(capacities))

    def least(k: int, need: int) -> int:
        return min((c for c in capacities if c >= need), key=lambda c: (cost(c) / max(1, need + filled(down, k + 1, c - need)), c))

    plans = [place(down, least)] + [place(down, lambda k, need, c=c: max(c, next(x for x in capacities if x >= need))) for c in capacities]
    sizes = [[next(c for c in capacities if c >= n) for n in words] for _, words in plans]
    best = min(range(len(plans)), key=lambda p: (sum(map(cost, sizes[p])), p))
    bins = [0] * len(lengths)
    for i, b in zip(order, plans[best][0]):
        bins[i] = b
    return bins, sizes[best]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: Column | None = None,
         capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = cost_of) -> DataFrame:
    """(id, piece, start, length, bin, capacity, slot): one row per piece; slot is its place in its bin.

    Lengths are words unless `length` is given; null or negative lengths count as 0. The pieces are
    numbered and written first, so that a task that runs again deals them to the same groups.
    """
    ready_python(docs.sparkSession)
    most = max(capacities)
    total = F.greatest(F.coalesce(length if length is not None else n_words(F.col(f"`{text}`")), F.lit(0)), F.lit(0)).cast("int")
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), total.alias("total"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / most) - 1, F.lit(0)).cast("int"))
    pieces = whole.select("id", "total", F.explode(cuts).alias("piece")).select(
        "id", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("total") - F.col("piece") * most, F.lit(most)).alias("length")
    )
    numbered = scratch(pieces.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    n = max(1, -(-numbered.count() // GROUP_ROWS))
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("nth"), F.lit(n)))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("nth", "ascending")]))
        bins, sizes = best_fit(rows["length"].to_pylist(), capacities, cost)
        first = rows["group"][0].as_py() << 32
        used = [0] * len(sizes)
        slots = []
        for b in bins:
            slots.append(used[b])
            used[b] += 1
        return pa.table({
            **{c: rows[c] for c in ("id", "piece", "start", "length")},
            "bin": pa.array([first + b for b in bins], pa.int64()),
            "capacity": pa.array([sizes[b] for b in bins], pa.int32()),
            "slot": pa.array(slots, pa.int32()),
        })

    kind = dict(whole.dtypes)["id"]
    return dealt.groupBy("group").applyInArrow(packed, f"id {kind}, piece int, start int, length int, bin long, capacity int, slot int")
