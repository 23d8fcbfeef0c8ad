import re
from collections import Counter

from larkspur.llm import quality
from larkspur.llm.queries import SQL, op2_quality
from tests.llm.fixtures import TEXTS, documents, empty
from tests.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    spoken = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(spoken) - len(set(spoken)), "n_repeat_words": len(covered),
    }


def failed(b):
    return b["n_words"] < 20 or 100 * b["n_repeat_words"] > 30 * b["n_words"]


def test_measurements(spark):
    rows = quality.apply_policy(quality.ledger(documents(spark)), "v1").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute(r["r"]["text"])
        assert {k: r["m"][k] for k in want} == want
        assert r["kept"] == (not failed(want))


def test_query_on_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op2_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == failed(want) and not (r["base_failed"] and r["kept"])


def test_good_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    rows = op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert all(r["kept"] for r in good)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 0.05 * sum(r["quality"] == 0 for r in rows)


def test_ablation_counts_what_policies_would_keep(spark):
    rows = quality.ledger(documents(spark)).cache()
    masks = [r["failed"] for r in rows.collect()]
    for r in quality.ablation(rows).collect():
        mask = quality.mask_of(r["policy"]) & ~quality.BIT.get(r["without"], 0)
        assert r["n_kept"] == sum(m & mask == 0 for m in masks)
    assert quality.ablation(quality.ledger(empty(spark))).filter("n_kept > 0").count() == 0


def test_keep_returns_rows_as_they_were(spark):
    df = documents(spark)
    kept = quality.keep(df, "v1")
    assert kept.schema.names == df.schema.names
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in TEXTS if not failed(brute(t)))
    assert quality.keep(empty(spark)).count() == 0


def test_query_gives_the_rows_of_its_sql(spark):
    same(spark, op2_quality, SQL["op2_quality"], "sf0.001")


def test_ablation_query(spark):
    from larkspur.llm.queries import quality_ablation

    same(spark, quality_ablation, SQL["quality_ablation"], "sf0.001")
