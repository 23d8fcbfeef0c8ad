import zlib

from larkspur.llm import sharding
from larkspur.llm.queries import SQL, op10_shards
from tests.llm.fixtures import TEXTS, documents, empty
from tests.oracle import same


def test_query_against_brute_force(spark):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in op10_shards(spark, "/root/testdata/sf0.01").collect()}
    total, before, slots = sum(len(t) + 1 for _, t in docs), 0, {}
    for d, t in docs:
        size = len(t) + 1
        shard = min(7, (before + size - size // 2 - 1) * 8 // total)
        before += size
        r = rows[d]
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) == (size, zlib.crc32(t), "bytes", shard, slots.get(shard, 0), None)
        slots[shard] = slots.get(shard, 0) + 1


def test_odd_documents(spark):
    out = sharding.by_bytes(documents(spark), 3).collect()
    assert len(out) == len(TEXTS)
    for k in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 1 for _, t in TEXTS)
    assert sharding.by_bytes(empty(spark)).count() == 0


def test_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b" * 1000)], "doc_id long, text string")
    assert {r["id"]: r["slot"] for r in sharding.by_bytes(df).collect()} == {1: 0, 2: 0}


def test_query_gives_the_rows_of_its_sql(spark):
    same(spark, op10_shards, SQL["op10_shards"], "sf0.001")
