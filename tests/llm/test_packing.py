import random
from collections import defaultdict

from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import packing
from larkspur.llm.queries import op7_packing
from tests.llm.fixtures import TEXTS, documents, empty


SMALL = (10, 20, 40)


def cost(c):
    return c + 2 + c * c / 100


def price(sizes):
    return sum(map(cost, sizes))


def least_price(lengths):
    """Of all ways to put the pieces into bins, by brute force."""
    best = float("inf")

    def put(k, held):
        nonlocal best
        if k == len(lengths):
            best = min(best, price(next(c for c in SMALL if c >= n) for n in held))
            return
        for b in range(len(held)):
            if held[b] + lengths[k] <= SMALL[-1]:
                put(k + 1, [*held[:b], held[b] + lengths[k], *held[b + 1 :]])
        put(k + 1, [*held, lengths[k]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80))
def test_bins_hold_their_pieces(lengths):
    bins, sizes = packing.best_fit(lengths, SMALL, cost)
    held = defaultdict(int)
    for b, n in zip(bins, lengths):
        held[b] += n
    assert len(bins) == len(lengths) and set(bins) == set(range(len(sizes)))
    for b, n in held.items():
        assert n <= sizes[b] and all(c < n or c >= sizes[b] for c in SMALL)  # downsized
    # never dearer than bins of the longest length alone, downsized or not
    assert price(sizes) <= price(packing.best_fit(lengths, SMALL[-1:], cost)[1]) + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=7))
def test_small_lists_against_the_optimum(lengths):
    _, sizes = packing.best_fit(lengths, SMALL, cost)
    assert least_price(lengths) - 1e-9 <= price(sizes) <= 1.35 * least_price(lengths) + 1e-9


def test_the_pieces_still_to_come_choose_the_size():
    """Long pieces that nothing fills up open short bins; pieces that fill a long one open it."""
    even = lambda c: c + 16
    assert packing.best_fit([700, 600, 600], (512, 1024, 2048), even)[1] == [1024, 2048] or packing.best_fit([700, 600, 600], (512, 1024, 2048), even)[1] == [2048]
    assert packing.best_fit([600] * 3, (1024, 2048), even)[1] == [2048]
    assert sorted(packing.best_fit([600] * 4, (1024, 2048), even)[1]) == [1024, 2048]


def test_mixed_lengths_open_several_sizes_at_less_cost():
    rng = random.Random(3)
    lengths = [min(4096, max(1, int(rng.lognormvariate(5.6, 1.2)))) for _ in range(5000)]
    _, sizes = packing.best_fit(lengths, packing.CAPACITIES)
    used = {c: sizes.count(c) for c in packing.CAPACITIES}
    assert sum(n > 20 for n in used.values()) >= 3
    total = sum(map(packing.cost_of, sizes))
    for c in packing.CAPACITIES:
        one = packing.place(sorted(lengths, reverse=True), lambda k, need, c=c: max(c, next(x for x in packing.CAPACITIES if x >= need)))[1]
        alone = sum(packing.cost_of(next(x for x in packing.CAPACITIES if x >= n)) for n in one)
        assert total <= alone if c < 4096 else total < 0.97 * alone
    assert sum(lengths) / sum(sizes) > 0.95


def check(rows, lengths):
    held, seen, slots = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        held[r["bin"], r["capacity"]] += r["length"]
        seen[r["doc_id"]] += r["length"]
        slots[r["bin"]].append(r["slot"])
    assert len(held) == len({b for b, _ in held})
    assert all(n <= c for (_, c), n in held.items())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert dict(seen) == lengths
    return sum(held.values()) / max(1, sum(c for _, c in held))


def test_every_word_is_packed_once(spark):
    docs = {r["doc_id"]: len((r["text"] or "").split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert check(op7_packing(spark, "/root/testdata/sf0.01").collect(), docs) > 0.97


def test_odd_documents(spark):
    rows = packing.pack(documents(spark), capacities=(16, 64)).withColumnRenamed("id", "doc_id").collect()
    lengths = defaultdict(int)
    for d, t in TEXTS:
        lengths[d] += len((t or "").translate(str.maketrans("\x1c  ", "...")).split())
    check(rows, dict(lengths))
    assert {r["doc_id"] for r in rows} == {d for d, _ in TEXTS}
    assert packing.pack(empty(spark)).count() == 0


def test_large_ids_beside_null_ids_stay_exact(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    df = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
    assert {r["id"] for r in packing.pack(df).collect()} == set(ids)


def test_groups_go_by_pieces(spark, monkeypatch):
    """Few documents of very many pieces still make many groups, and equal rows are spread over them."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    df = spark.createDataFrame([(1, 40_000), (1, 40_000), (None, 16_000)], "doc_id long, n int")
    rows = packing.pack(df, text="n", length=F.col("n"), capacities=(64, 128)).collect()
    assert len(rows) == 751 == len({(r["bin"], r["slot"]) for r in rows}) and len({r["bin"] >> 32 for r in rows}) >= 12
    assert sum(r["length"] for r in rows) == 96_000
