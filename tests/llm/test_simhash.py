import random

import numpy as np
import xxhash

from larkspur.llm import simhash
from larkspur.llm.components import components
from larkspur.llm.queries import op3_simhash
from tests.llm.fixtures import TEXTS, documents, empty


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def print_of(text, n=3):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_within_counts_bits():
    rng = np.random.default_rng(3)
    for width in (8, 32):
        for n in (1, 2, 65, 130):
            p = rng.integers(0, 256, (n, width), dtype=np.uint8)
            for i in range(1, n):
                if rng.random() < 0.6:
                    p[i] = p[i - 1]
                    p[i, rng.integers(width)] ^= 1 << rng.integers(8)
            d = np.unpackbits(p[:, None] ^ p[None], axis=2).sum(axis=2)
            for radius in (0, 1, 2, 5, 60):
                want = d <= radius
                np.fill_diagonal(want, False)
                assert (simhash.within(p, radius) == want).all()


def test_overlaps():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 50))), np.uint32) for _ in range(20)]
    got = simhash.overlaps(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert abs(got[i, j] - len(set(a) & set(b)) / len(set(a) | set(b))) < 1e-6


def test_groups_against_all_pairs(spark):
    rows = op3_simhash(spark, "/root/testdata/sf0.001").collect()
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    prints = [print_of(t) for _, t in docs]
    label = classes(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    want = {d: (f"{p:016x}", docs[x][0]) for (d, _), p, x in zip(docs, prints, label)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


def test_hot_block_keeps_every_link(spark):
    """Over a thousand fingerprints in one block, in a chain and far apart in turn."""
    rng = random.Random(1)
    chain, x = [], 0x1234567800000000
    for _ in range(700):
        chain.append(x)
        for b in rng.sample(range(32), 2):
            x ^= 1 << b
    lone = [0x1234567800000000 | rng.getrandbits(32) for _ in range(600)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in chain + lone})
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r["node"]: r["root"] for r in components(simhash.hamming_links(df)).collect()}
    arr = np.array(values, np.int64).view(np.uint64)
    label = np.arange(len(arr))
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2
    while True:
        new = np.where(near, label[None, :], len(arr)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [found.get(v, v) for v in values] == [values[k] for k in label]


def test_odd_documents(spark):
    out = simhash.groups(documents(spark)).collect()
    assert len(out) == len(TEXTS)
    by_print = {}
    for r in out:
        by_print.setdefault(r["fingerprint"], set()).add(r["component"])
    assert all(len(c) == 1 for c in by_print.values())
    assert {r["component"] for r in out if r["fingerprint"] == 0} == {3}
    assert simhash.groups(empty(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def varied(rng, words, changes):
    words = list(words)
    for k in rng.sample(range(len(words)), changes):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(2)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))]
        texts += [" ".join(base)] + [varied(rng, base, rng.randrange(0, max(2, len(base) // 25))) for _ in range(rng.randrange(6))]
        texts.append(" ".join(base[:30] + [f"x{rng.randrange(9999)}" for _ in range(60)]))  # shares a passage only
    texts += ["", None, "two words", "two words", "Two  WORDS"]
    order = rng.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(i, texts[i], "x") for i in order], "doc_id long, text string, root string")

    def linked(i, j):
        a, b = set(shingles(texts[i], 5)), set(shingles(texts[j], 5))
        return (not a and not b) or len(a & b) >= 0.8 * len(a | b)

    want = sorted(set(classes(len(texts), linked)))
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_near_dedup_of_odd_documents(spark):
    out = simhash.near_dedup(documents(spark)).collect()
    ids = [r["doc_id"] for r in out]
    assert ids.count(7) == 0 and ids.count(1) == 1 and ids.count(3) == 1 and 4 not in ids and 8 not in ids
    assert None in ids
    assert simhash.near_dedup(empty(spark)).count() == 0
    twice = spark.createDataFrame([(5, "same text of the same id")] * 3, "doc_id long, text string")
    assert simhash.near_dedup(twice).count() == 1


def test_near_dedup_finds_short_copies(spark):
    """Similarity is exactly 0.8: the SimHash radius or the min-hash keys miss some of these pairs."""
    rng = random.Random(6)
    rows = []
    for k in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9 if k % 2 else 19)]
        end = words[:8] if k % 2 else words[:16]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(end))]
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 1200, 2))


def test_parity_prints_exclude_no_similar_pair():
    rng = np.random.default_rng(9)
    for n in (1, 5, 60, 64, 65, 130, 500, 9000):
        for m in {n, n + 1, int(n / 0.8)}:
            both = -(-4 * (n + m) // 9)  # the least that are 0.8 alike
            if both <= min(n, m):
                pool = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
                a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
                assert both / len(pool) >= 0.8 and len(b) == m
                own, other = simhash.class_of(n), simhash.class_of(m)
                least = min(own, other)
                prints = simhash.folded([simhash.parity(a, 1 << own), simhash.parity(b, 1 << other)], 1 << least)
                differ = int(np.bitwise_count(prints[0] ^ prints[1]).sum())
                assert differ <= n + m - 2 * both <= simhash.most_differing(n + m, 0.8)
                assert abs(own - other) <= 1


def test_links_across_blocks_of_many_rows(spark):
    """A passage of 700 texts fills their prefixes; some of them are near copies of each other."""
    rng = random.Random(12)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(30)]
    rows, want = [], []
    for k in range(350):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([10, 60]))]
        end = own[:-1] + ["other"] if k % 3 == 0 else [f"v{rng.randrange(10**6)}" for _ in own]
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + end))]
    sets = [set(shingles(t, 5)) for _, t in rows]
    want = sorted(set(classes(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))))
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == want and 350 < len(want) < 700


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 60):
        for m in range(n, 76):
            for both in range(1, n + 1):
                if both / (n + m - both) >= 0.8:
                    # at worst all values that they do not share come first
                    assert n - both < simhash.prefix_size(n, 0.8) and m - both < simhash.prefix_size(m, 0.8)
