import random
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import toxicity
from larkspur.llm.queries import op8_toxicity
from tests.llm.fixtures import TEXTS, documents, empty


def corpus(spark, n=900):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        words = [f"wo{chr(97 + rng.randrange(26))}rd{rng.randrange(300)}" for _ in range(rng.randrange(15, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "you st0oopid", "i.d.i.o.t", f"grumbl{rng.randrange(40)}", "LOSER!!"]))
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.drop("toxic"), df.drop("text"), rows


def test_held_out_rows_are_told_apart(spark):
    docs, labels, rows = corpus(spark)
    model = toxicity.fit(docs, toxicity.training_rows(labels))
    scored = {r["id"]: r["score"] for r in toxicity.score(docs, model).selectExpr("r.doc_id AS id", "score").collect()}
    held = [(scored[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(scored) == len(rows) and all(0 <= s <= 1 for s in scored.values())
    assert sum((s >= 0.7) == bool(y) for s, y in held) >= 0.95 * len(held)
    assert sum(s >= 0.7 for s, y in held if not y) <= 0.02 * len(held)


def test_obfuscation_is_undone():
    assert toxicity.plain(toxicity.normal("\"St00pid!\"")) == "stoopid"
    assert toxicity.plain("i.d.i.o.t") == "idiot" and toxicity.plain("looooser") == "looser" and toxicity.plain("worthless") == "worthless"
    codes = toxicity._Codes({})
    assert toxicity.features_of("you are an 1d10t", codes)[1] > 0 and toxicity.features_of("a fine day", codes)[1] == 0


def test_odd_documents(spark):
    docs, labels, _ = corpus(spark, 400)
    model = toxicity.fit(docs, labels.unionByName(labels.limit(3)))
    out = toxicity.score(documents(spark), model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty(spark), model).count() == 0
    one_class = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, one_class).collect()} == {0.0}
    kept = toxicity.keep(documents(spark), labels.limit(0))
    assert kept.columns == documents(spark).columns and kept.count() == len(TEXTS)


def test_query(spark):
    rows = op8_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r["doc_id"]) == 0 and r["held_out"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    toxic = [r for r in rows if labels.get(r["doc_id"]) == 1 and r["held_out"]]
    # 18 documents, with about as many again to learn from: 14 of them are told
    assert len(toxic) > 5 and sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    ranked = sum(1.0 if a["score"] > b["score"] else 0.5 * (a["score"] == b["score"]) for a in toxic for b in clean)
    print("ranking", ranked / len(toxic) / len(clean))
    assert ranked >= 0.9 * len(toxic) * len(clean)


@pytest.mark.parametrize("few,elsewhere,most", [("fits", 1, 900), ("NOT fits", 1, 900), ("fits", 0, 900), ("place > 400000", 1, 300)])
def test_few_rows_of_a_class_train(spark, monkeypatch, few, elsewhere, most):
    """All rows of a class are in the part that fits, or in that which calibrates, or outside of what is drawn."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", most)
    docs, labels, rows = corpus(spark)
    told = labels.withColumn("fits", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(100)) < toxicity.FIT_PERCENT)
    told = told.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    model = toxicity.fit(docs, told.filter(f"toxic != {elsewhere} OR ({few})").select("doc_id", "toxic"))
    assert model.trees is not None
    scored = {r["id"]: r["score"] for r in toxicity.score(docs, model).selectExpr("r.doc_id AS id", "score").collect()}
    mean = [sum(scored[k] for k, _, y in rows if y == c) / sum(y == c for _, _, y in rows) for c in (0, 1)]
    assert mean[1] > mean[0] + 0.5
