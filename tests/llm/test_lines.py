import random
from collections import defaultdict

import pytest

from larkspur.llm import lines
from larkspur.llm.queries import SQL, op6_lines
from tests.llm.fixtures import TEXTS, documents, empty
from tests.oracle import same

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, min_chars=10, min_documents=2):
    holders = defaultdict(set)
    cut = [(lines.LAST if d is None else d, (t or "").split("\n")) for d, t in rows]

    def key(x):
        return x.strip(lines.WHITE).translate(LOWER)

    for d, ls in cut:
        for x in ls:
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    out = []
    for d, ls in cut:
        stay = [x for x in ls if len(holders[key(x)]) < min_documents or min(holders[key(x)]) == d]
        out.append((d, "\n".join(stay), len(ls), len(ls) - len(stay)))
    return sorted(out)


@pytest.mark.parametrize("least", [2, 3])
def test_against_brute_force(spark, least):
    rng = random.Random(6)
    pool = [f"Line number {k} of the pool" for k in range(12)] + ["short", "", " \t", "ÄÖÜ line äöü"]
    rows = TEXTS + [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup(df, min_documents=least).collect()
    assert sorted((lines.LAST if r["doc_id"] is None else r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in got) == brute(rows, 10, least)


def test_query(spark):
    same(spark, op6_lines, SQL["op6_lines"], "sf0.001")


def test_odd_documents(spark):
    df = documents(spark)
    out = lines.without_shared(df)
    assert out.columns == df.columns and out.count() == len(TEXTS)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[4] == (None, None) and texts[3] == ("", 0)
    assert texts[2] == ("another text here\nend two", len("another text here\nend two"))
    assert lines.dedup(empty(spark)).count() == 0


def test_a_text_is_shuffled_once(spark):
    """Left of the last join the plan has the row, which holds the text, and two hashes; nothing of it is sorted."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = lines.without_shared(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter") :].split("\n")[1]
    assert left.count("text#") == 3  # in the row, and in its two hashes
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in physical and out.count() == docs.count()
