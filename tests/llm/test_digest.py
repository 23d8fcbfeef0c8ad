import hashlib

from larkspur.llm import digest
from larkspur.llm.queries import op9_digests
from tests.llm.fixtures import TEXTS, documents, empty


def check(rows, docs):
    """docs in the order of pairing."""
    want = []
    for k, (d, t) in enumerate(docs):
        u = docs[(k + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = digest.digest(t), digest.digest(e), digest.digest(u)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), digest.likeness(a, b), digest.likeness(a, c)))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = [(r["doc_id"], *(r[x] for x in names)) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = op9_digests(spark, "/root/testdata/sf0.001").collect()
    check(rows, sorted(docs, reverse=True))
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.85 * len(rows)


def test_few_rows_and_many_partitions(spark):
    for n in (1, 2, 3):
        docs = [(k, f"text number {k} " * (k + 1)) for k in range(n)]
        out = digest.with_next(spark.createDataFrame(docs, "doc_id long, text string")).withColumnRenamed("id", "doc_id").collect()
        check(out, sorted(docs, reverse=True))


def test_odd_documents(spark):
    out = digest.with_next(documents(spark, clash=False)).collect()
    assert len(out) == len(TEXTS)
    assert {r["fingerprint"] for r in out if r["n_chars"] == 0} == {"00" * 65}
    assert digest.with_next(empty(spark)).count() == 0
    assert digest.fingerprints(documents(spark), out="own").select("own").distinct().count() < len(TEXTS)
    kept = digest.fingerprints(documents(spark))
    assert {r["fingerprint"] for r in kept.collect()} == {"fingerprint"} and "fingerprint_" in kept.columns


def test_rows_equal_in_id_and_text_are_split(spark):
    rows = [(5, "the same text of the same id")] * 4000 + [(k, f"text {k}") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    check(digest.with_next(df).withColumnRenamed("id", "doc_id").collect(), sorted(rows, reverse=True))


def test_difference_is_bounded_and_symmetric():
    a, b = digest.digest("one text of some length " * 9), digest.digest("ZZZ 123 " * 400)
    assert digest.difference(a, a) == 0 and 0 < digest.difference(a, b) == digest.difference(b, a) <= digest.CAP
