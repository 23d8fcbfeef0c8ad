"""Operator 3: SimHash near-duplicates by bit-sliced comparison.

Fingerprints meet in blocks: rows that agree in a key. Within a block the fingerprints are stored as bit
planes (plane j holds bit j of 64 rows in each machine word), so that one XOR compares a bit of one row
with that of 64 others. Carry-save counters, themselves bit planes, add up the differences of all rows at
once; they start so that a count over the radius overflows, and a block is left as soon as all have.

Blocks of more than TILE rows are dealt out by hash into parts of about TILE rows, and each two parts are
compared in a task of their own: nothing is dropped, and no task holds more than about 2 * TILE rows of a
block, however hot its key. A block gives a spanning forest of its links, never all its pairs. Tiles carry
fingerprints only; shingle sets are fetched for what is left after the comparison.

Defined results: a null text has no words; its fingerprint is zero. Equal texts have equal fingerprints
and so are one node. Nulls in other columns, rows that repeat and columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import drop_scratch, free_name, ready_python, scratch, small, text_of
from larkspur.llm.components import components
from larkspur.llm.lines import WHITE

#: Rows of a part of a block.
TILE = 256
SEED = 42
#: Keys of a document in the first pass of near_dedup; what they miss the second pass finds.
KEYS = 6
#: Machine words of a SimHash print in that pass.
PRINT_WORDS = 2
#: About so many texts tell which shingles are common, and so many shingles are told at most.
SAMPLE_TEXTS = 10_000
COMMON = 100_000
#: Least and most bits of a parity print, as powers of two. Longer texts only have a weaker bound.
LEAST_CLASS, MOST_CLASS = 6, 13
#: Of the cache of word hashes in a Python worker; it is emptied when full, which changes no result.
CACHE_WORDS = 300_000
MASK64 = (1 << 64) - 1


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included; words are lower-cased (A-Z) and joined by one space."""
    words = text.encode().lower().split()
    if len(words) <= n:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(n)]))
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes (the finaliser of SplitMix64)."""
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & MASK64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> bytes:
    """Eight bytes: bit i is 1 if it is set in over half of the hashes."""
    if not len(h):
        return bytes(8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # sums of 255 bits fit in a byte
        counts += np.add.reduce(np.unpackbits(h[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit SimHash of a text column, as a long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        prints = b"".join(majority(shingle_hashes(t or "", shingle)) for t in texts.to_pylist())
        return pa.array(np.frombuffer(prints, ">i8").astype(np.int64))

    return of(text)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(rows, bytes) of fingerprints to (bits, words): plane j has bit j of every row, 64 rows a word."""
    bits = np.unpackbits(prints, axis=1)
    rows = -(-len(bits) // 64) * 64
    padded = np.zeros((rows, bits.shape[1]), np.uint8)
    padded[: len(bits)] = bits
    return np.ascontiguousarray(np.packbits(padded, axis=0).T).view(np.uint64)


def within(prints: np.ndarray, radius: int) -> np.ndarray:
    """(rows, rows) booleans: which rows differ from each other in `radius` bits at most, but for the diagonal."""
    n, planes = len(prints), planes_of(prints)
    full = np.uint64(MASK64)
    flips = np.where(np.unpackbits(prints, axis=1).T[:, :, None] == 1, full, np.uint64(0))  # bit, row, 1
    digits = max(1, (radius + 1).bit_length())
    start = (1 << digits) - (radius + 1)
    count = [np.full((n, planes.shape[1]), full if start >> k & 1 else np.uint64(0)) for k in range(digits)]
    done = np.ones((n, planes.shape[1] * 64), np.uint8)
    done[:, :n] = np.eye(n, dtype=np.uint8)
    over = np.packbits(done, axis=1).view(np.uint64)
    alive = np.arange(n)
    for j in range(0, len(planes), 2):  # two planes at once: a full adder on the lowest counter
        x, y = planes[j] ^ flips[j, alive], planes[j + 1] ^ flips[j + 1, alive]
        half = x ^ y
        carry = (x & y) | (half & count[0])
        count[0] ^= half
        for k in range(1, digits):
            carry, count[k] = carry & count[k], count[k] ^ carry
        over |= carry
        if j & 6 == 6:  # rows that are too far from all others are left
            near = (over != full).any(axis=1)
            if not near.any():
                return np.zeros((n, n), bool)
            if 2 * near.sum() < len(near):
                alive, over, count = alive[near], over[near], [c[near] for c in count]
    found = np.zeros((n, n), bool)
    found[alive] = np.unpackbits((~over).view(np.uint8), axis=1)[:, :n].astype(bool)
    return found


def forest(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component, given a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        best = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, rows) Jaccard similarity of sets of values; only values in two sets or more are looked at."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    value, where = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(where, minlength=len(value)) > 1
    place = np.cumsum(often) - 1
    row, col = row[often[where]], place[where[often[where]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(col, [at, at + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        both += m @ m.T
    either = sizes[:, None] + sizes[None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles, several small ones at once. Rows come sorted by tile, and a tile may run over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]
        lo = 0
        for cut in starts[:-1]:
            begins = cut > 0 or not held or held[-1].column(0)[-1].as_py() != tile[0]
            if begins and sum(b.num_rows for b in held) + cut - lo >= TILE:
                if cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                yield pa.Table.from_batches(held)
                held, lo = [], cut
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def tiles(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with a column `tile`: rows of a block, in parts of about TILE; each two parts of a block share a tile.

    Rows whose key nobody shares are left out: they have nothing to be compared with.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
    shared = rows.join(counts, keys).withColumn("parts", parts).withColumn("mine", mine)
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine"))
    )
    dealt = shared.withColumn("other", F.explode(others))
    tile = F.xxhash64(*keys, F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.withColumn("tile", tile).drop("n", "parts", "mine", "other", *keys)


def _links(dealt: DataFrame, node: str, radius: int) -> DataFrame:
    """(a, b) edges (longs) that connect all nodes of a tile within the radius; columns of dealt: tile, node, print (binary)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            tile, names = pack.column(0).to_numpy(), pack.column(1).to_numpy()
            near = within(np.frombuffer(b"".join(pack.column(2).to_pylist()), np.uint8).reshape(len(tile), -1), radius)
            near &= tile[:, None] == tile[None, :]
            if near.any():
                root = forest(near)
                tied = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[root[tied]])], ["a", "b"])

    return _by_tile(dealt.select("tile", node, "print")).mapInArrow(compare, "a long, b long")


def _by_tile(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("tile").sortWithinPartitions("tile")


def hamming_links(prints: DataFrame, radius: int = 2, col: str = "fingerprint") -> DataFrame:
    """(a, b): edges that connect all distinct 64-bit fingerprints (long) at `radius` or fewer differing bits.

    The bits are cut into radius + 2 blocks; of two such fingerprints at least two blocks are equal, so
    they share one of the keys made of two blocks.
    """
    ready_python(prints.sparkSession)
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    masks = []
    for pair in combinations(range(n), 2):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in pair)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    nodes = prints.select(F.col(col).alias("node")).filter("node IS NOT NULL").distinct()
    keyed = nodes.select("node", F.posexplode(F.array(*[F.col("node").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    dealt = tiles(keyed, ["block", "key"], "node").withColumn("print", F.unhex(F.lpad(F.hex("node"), 16, "0")))
    return _links(dealt, "node", radius)


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint long, component): the smallest id reachable over links of `radius` bits at most.

    Null ids are never a component's name, unless it has no other.
    """
    ready_python(docs.sparkSession)
    prints = scratch(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint(text_of(F.col(f"`{text}`")), shingle).alias("fingerprint")), "prints")
    roots = scratch(components(hamming_links(prints, radius)), "roots")
    named = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "id", "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )
    # written, so that the join reads it directly and adaptive execution can split a hot group's rows
    least = scratch(named.groupBy("root").agg(F.min("id").alias("component")), "least")
    return named.join(least, "root").select("id", "fingerprint", "component")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str, n: int, words: _WordHashes) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes, made of their words' hashes."""
    if len(words) > CACHE_WORDS:
        words.clear()
    parts = text.encode().lower().split()
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if not len(w):
        return w
    size = min(n, len(w))
    odd = mix(np.arange(n, dtype=np.uint64), 1) | np.uint64(1)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h += w[k : len(w) - size + 1 + k] * odd[k]
    return np.unique(mix(h, 0))


def prefix_size(n: int, similarity: float) -> int:
    """Two sets that are `similarity` alike share one of their first values, so many of n each, in any order of all values."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def most_differing(sizes: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """Of two sets of so many values in sum that are `similarity` alike: at most so many values are in one set only."""
    return np.floor(sizes * (1 - similarity) / (1 + similarity) + 1e-9).astype(int)


def class_of(n: int) -> int:
    """The power of two of the bits in the parity print of n values."""
    return min(MOST_CLASS, max(LEAST_CLASS, (n - 1).bit_length()))


def parity(h: np.ndarray, bits: int) -> bytes:
    """Bit i tells whether an odd number of the values falls there: prints differ in no more bits than sets do in values."""
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(prints: list[bytes], bits: int) -> np.ndarray:
    """(rows, bytes) of parity prints at a width that none is narrower than; halves of wider ones are added up."""
    rows = np.empty((len(prints), bits // 8), np.uint8)
    for k, x in enumerate(prints):
        # value v counts at v mod its width, so at v mod bits too
        rows[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, bits // 8), axis=0)
    return rows


def common_shingles(docs: DataFrame, text: Column, shingle: int) -> np.ndarray:
    """Hashes of shingles that stand in several texts of a sample, rarest first. They only order: any order is right."""

    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        words = _WordHashes()
        return pa.array([shingle_set(t, shingle, words).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    share = SAMPLE_TEXTS / max(1, docs.count())
    sample = docs.select(text.alias("text")).filter(F.rand(SEED) < share)
    counts = sample.select(F.explode(hashes("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()  # COMMON rows at most
    return np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)


def _similar(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b) edges that connect all nodes of a tile whose sets are `similarity` alike; columns of dealt: tile, nid, shingles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            tile, names, left, right = pack.column(0).to_numpy(), pack.column(1).to_numpy(), [], []
            sets = [np.frombuffer(x, np.uint64) for x in pack.column(2).to_pylist()]
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]
            for lo, hi in zip(cuts, cuts[1:]):
                root = forest(overlaps(sets[lo:hi]) >= similarity)
                tied = np.flatnonzero(root != np.arange(hi - lo))
                left.append(names[lo + tied])
                right.append(names[lo + root[tied]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return _by_tile(dealt.select("tile", "nid", "shingles")).mapInArrow(compare, "a long, b long")


def _pairs(tile: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of two rows of one tile whose prints differ in `radius` bits at most. Tiles that do not fill a machine word are compared directly."""
    cuts = np.array([0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)])
    sizes = np.diff(cuts)
    few = np.repeat(sizes < 64, sizes)
    words, left, right = prints.view(np.uint64), [], []
    for step in range(1, int(sizes[sizes < 64].max(initial=1))):
        i = np.flatnonzero((tile[step:] == tile[:-step]) & few[:-step])
        i = i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1) <= radius]
        left.append(i)
        right.append(i + step)
    for lo, hi in zip(cuts[:-1][sizes >= 64], cuts[1:][sizes >= 64]):
        i, j = np.nonzero(np.triu(within(prints[lo:hi], radius)))
        left.append(lo + i)
        right.append(lo + j)
    return np.concatenate([*left, np.zeros(0, int)]).astype(int), np.concatenate([*right, np.zeros(0, int)]).astype(int)


def _near_rows(dealt: DataFrame, similarity: float) -> DataFrame:
    """(tile, nid): rows that may be `similarity` alike with a row of another group in their tile; no such row is left out.

    Columns of dealt: tile, nid, gid, class (one for each tile), size, bits (a parity print of that width or wider).
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            tiles_, nids, gids, classes, sizes = (pack.column(k).to_numpy() for k in range(5))
            bits = pack.column(5).to_pylist()
            for c in np.unique(classes):
                at = np.flatnonzero(classes == c)
                gid, size = gids[at], sizes[at].astype(np.int64)
                prints = folded([bits[k] for k in at], 1 << int(c))
                i, j = _pairs(tiles_[at], prints, int(most_differing(2 * size.max(), similarity)))
                apart = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
                good = (gid[i] != gid[j]) & (apart <= most_differing(size[i] + size[j], similarity))
                good &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
                rows = at[np.unique(np.concatenate([i[good], j[good]]))]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(tiles_[rows]), pa.array(nids[rows])], ["tile", "nid"])

    columns = ["tile", "nid", "gid", "class", "size", "bits"]
    return dealt.select(*columns).repartition("tile").sortWithinPartitions("class", "tile").mapInArrow(compare, "tile long, nid long")


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(nid, shingles) of the wanted nids, from their texts (node, text), of which there may be copies."""

    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        words = _WordHashes()
        return pa.array([shingle_set(t, shingle, words).tobytes() for t in column.to_pylist()], pa.binary())

    named = scratch(nodes.select("nid", "node").join(wanted.select("nid").distinct(), "nid"), "wanted")
    one = texts.join(small(named), "node").groupBy("nid").agg(F.first("text").alias("text"))
    return one.select("nid", of("text").alias("shingles"))


def _first_links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) edges of most nodes that are `similarity` alike: those of near SimHash prints in a block of equal least hashes."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * PRINT_WORDS
    radius = math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))
    keyed = nodes.select("nid", F.posexplode("keys").alias("order", "key"))
    near = scratch(_links(tiles(keyed, ["order", "key"], "nid").join(nodes.select("nid", "print"), "nid"), "nid", radius).distinct(), "near")
    # a root and about TILE of the rows that are tied to it make a tile
    counts = near.groupBy("b").agg(F.count("*").alias("n"))
    star = near.join(counts, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / TILE))).alias("tile"))
    dealt = scratch(star.select("tile", F.col("a").alias("nid")).unionByName(star.select("tile", F.col("b").alias("nid")).distinct()), "dealt")
    edges = scratch(_similar(dealt.join(_sets(texts, nodes, dealt, shingle), "nid"), similarity), "first")
    drop_scratch(near, dealt)
    return edges


def _missed_links(nodes: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) edges among the groups of `roots`, with which all nodes that are `similarity` alike are connected.

    Two such nodes share a value of their prefixes, so rows of about equal size that agree in one are
    compared: by their parity prints first, and by their sets where those are near enough. Values that
    stand in one group only, and values that the same rows share as another one, have nothing to add.
    """
    # dealt by value once: for the extremes, and for the join with them
    keyed = nodes.select(F.expr("nid * 64 + code").alias("row"), F.explode("prefix").alias("key")).repartition("key")
    several = keyed.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low != high").select("key")
    shared = scratch(keyed.join(several, "key").select("key", F.expr("row div 64").alias("nid"), F.expr("row % 64").alias("code")), "shared")
    gid = F.when(F.col("root").isNull(), F.col("nid")).otherwise(-F.abs(F.xxhash64("root")) - 1)  # below all nids
    gids = nodes.select("nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("nid", gid.alias("gid"))
    # a row meets rows of its class, and those of the class below if one of them can be large enough
    own = F.expr("code div 2").cast("int")
    classes = F.when(F.col("code") % 2 == 1, F.array(own, own - 1)).otherwise(F.array(own))
    rows = scratch(shared.join(gids, "nid").select("key", "nid", "gid", F.explode(classes).alias("class")), "classes")
    blocks = rows.groupBy("key", "class").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "nid")).alias("y"),
        F.min("gid").alias("low"), F.max("gid").alias("high"),
    )
    blocks = blocks.filter("low != high").groupBy("n", "x", "y", "class").agg(F.min("key").alias("key")).select("key", "class")
    dealt = tiles(rows.join(blocks, ["key", "class"]).withColumn("width", F.col("class")), ["key", "class"], "nid").withColumnRenamed("width", "class")
    near = scratch(_near_rows(dealt.join(nodes.select("nid", "size", "bits"), "nid"), similarity), "near")
    edges = scratch(_similar(near.join(_sets(texts, nodes, near, shingle), "nid"), similarity), "missed")
    drop_scratch(shared, rows, near)
    return edges


def near_links(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): a row for each different text, with `node` (see node_of) and `nid`, and (node: nid, root) of all that have a link.

    Two texts are linked if the Jaccard similarity of their sets of word shingles, told by 64-bit hashes, is
    `similarity` or more. A first pass ties most copies: blocks are the smallest values of KEYS hash orders
    of the shingles; in a block, 128-bit SimHash prints are compared bit-sliced within the radius that
    `similarity` implies plus four deviations, and the shingle sets of what is left decide. A second pass
    finds every link that is missing among these groups, by the shingles' prefixes in one order (common
    shingles last), which no pair of that similarity escapes; parity prints, compared bit-sliced as well,
    exclude most pairs for certain, and the sets decide on the rest.
    """
    ready_python(docs.sparkSession)
    whole = text_of(F.col(f"`{text}`"))
    common = common_shingles(docs, whole, shingle)
    order = np.argsort(common)
    common, places = common[order], order + 1

    kind = pa.struct([
        ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("print", pa.binary()), ("size", pa.int32()), ("code", pa.int32()), ("bits", pa.binary()),
    ])

    @F.arrow_udf("struct<keys:array<long>,prefix:array<long>,print:binary,size:int,code:int,bits:binary>")
    def sketch(texts: pa.Array) -> pa.Array:
        rows, words = [], _WordHashes()
        for t in texts.to_pylist():
            h = shingle_set(t, shingle, words)
            late = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                late = np.where(common[at] == h, places[at], 0)
            first = np.argsort(late, kind="stable")[: prefix_size(len(h), similarity)] if len(h) else []
            c = class_of(len(h))
            below = c > LEAST_CLASS and similarity * len(h) <= (1 << c - 1) + 1e-6
            rows.append({
                "keys": [int(mix(h, k).min().view(np.int64)) for k in range(1, KEYS + 1)] if len(h) else [],
                "prefix": h[first].view(np.int64) if len(h) else [],
                "print": b"".join(majority(mix(h, 100 + k)) for k in range(PRINT_WORDS)),
                "size": len(h), "code": 2 * c + below, "bits": parity(h, 1 << c),
            })
        return pa.array(rows, kind)

    texts = docs.select(node_of(whole).alias("node"), whole.alias("text"))
    one = texts.select("node", sketch("text").alias("s")).groupBy("node").agg(F.first("s").alias("s"))
    nodes = scratch(one.select(F.monotonically_increasing_id().alias("nid"), "node", "s.*"), "nodes")
    first = _first_links(nodes, texts, shingle, similarity)
    roots = scratch(components(first), "roots")
    missed = _missed_links(nodes, texts, roots, shingle, similarity)
    if not missed.isEmpty():
        tied = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = scratch(components(tied.unionByName(missed)), "roots")
    drop_scratch(first, missed)
    return nodes, roots


def node_of(text: Column) -> Column:
    """Equal for equal texts; all texts without words are one."""
    return F.md5(F.when(F.btrim(text, F.lit(WHITE)) == "", "").otherwise(text))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group one row stays, that with the smallest id (null ids come last).

    Groups are the connected components of near_links(). Equal texts are one node from the start. Of rows
    equal in id and text one stays. Texts without words are copies of each other.
    """
    nodes, roots = near_links(docs, text, shingle, similarity)
    node = node_of(text_of(F.col(f"`{text}`")))
    ids = scratch(docs.select(F.col(f"`{id_col}`").alias("id"), node.alias("node")), "ids")
    least = ids.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("s"))
    named = least.join(nodes.select("node", "nid"), "node").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    first = named.groupBy(F.coalesce("root", "nid").alias("root")).agg(F.min(F.struct("s.none", "s.id", "node")).alias("s"))
    stays = first.select(F.col("s.node").alias("node"), F.col("s.id").alias("id"), F.lit(True).alias("stays"))
    gone = ids.distinct().join(stays, (ids["node"] == stays["node"]) & ids["id"].eqNullSafe(stays["id"]), "left_anti")
    gone = small(scratch(gone.select(F.col("node").alias("near_node"), F.col("id").alias("near_id")), "gone"))
    own = free_name(docs, "near_text")
    out = docs.withColumn(own, node)
    out = out.join(gone, (out[own] == gone["near_node"]) & out[id_col].eqNullSafe(gone["near_id"]), "left_anti")
    if not ids.groupBy("id", "node").count().filter("count > 1").isEmpty():  # repeated rows
        out = out.dropDuplicates([id_col, own])
    return out.drop(own)
