import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import conditions, keys, versions
from larkspur.plans import replay
from larkspur.sources.catalog import Catalog, CatalogError
from larkspur.sources.tables import Tables


@pytest.mark.parametrize(
    "columns, kind, told",
    [
        ([("id", "int32"), ("v", "varchar")], "heap", "must be int64"),
        ([("id", "int64"), ("v", "text")], "heap", "unknown type"),
        ([("id", "int64"), ("ID", "int8")], "heap", "repeats"),
        ([("id", "int64")], "hash", "unknown clustering"),
        ([("id", "int64"), *((f"c{k}", "int8") for k in range(32))], "heap", "1 to 32"),
        ([], "heap", "no columns"),
    ],
)
def test_refused_definitions(spark, columns, kind, told):
    with pytest.raises(CatalogError, match=told):
        Catalog(spark, most_columns=32).define("t", columns, kind)


def test_table_names_ignore_case(spark):
    catalog = Catalog(spark)
    catalog.define("T", [("id", "INT64")])
    with pytest.raises(CatalogError, match="exists"):
        catalog.define("t", [("id", "int64")])


def test_every_type_goes_in_and_out(spark):
    made = Tables(spark)
    kinds = [("id", "int64"), ("a", "int8"), ("b", "int16"), ("c", "int32"), ("f", "float"), ("d", "decimal"), ("ok", "bool"), ("v", "varchar"), ("ch", "char")]
    made.create("t_all", kinds, "btree")
    texts = spark.createDataFrame(
        [(1, "7", "1", "-2", "3", "3F800000", "1.23456", "true", "x", "ab"), (2, "7", "1", "1", "1", "00000000", "1", "1", "y", ""), (3, "-1", "0", "0", "0", "00000000", ".", "no", None, "z")],
        "nth int, id string, a string, b string, c string, f string, d string, ok string, v string, ch string",
    )
    assert sorted(tuple(r) for r in made.insert("t_all", texts, "nth").collect()) == [(1, 7, "ok"), (2, 7, "duplicate"), (3, -1, "ok")]
    got = {r["id"]: r for r in made.scan("t_all").collect()}
    assert set(got) == {7, -1} and str(got[7]["d"]) == "1.2345" and got[-1]["v"] == "" and bytes(got[7]["f"]) == bytes.fromhex("3f800000")
    assert made.scan("t_all", ("f", "=", "3f800000")).count() == 1
    with pytest.raises(ValueError):
        made.scan("t_all", ("f", "<", "3f800000"))
    with pytest.raises(ValueError):
        made.insert("t_all", texts.drop("ch"), "nth")
    with pytest.raises(LookupError):
        made.scan("none")


def test_long_rows_are_refused_if_asked(spark):
    made = Tables(spark, row_bytes=256)
    made.create("t", [("id", "int64"), ("v", "varchar")])
    made.insert("t", spark.createDataFrame([(1, "1", "x" * 246)], "n int, id string, v string"), "n")
    with pytest.raises(Exception, match="too long"):
        made.insert("t", spark.createDataFrame([(1, "2", "x" * 247)], "n int, id string, v string"), "n")
    assert made.scan("t").count() == 1
    free = Tables(spark)
    free.create("t", [("id", "int64"), ("v", "varchar")])
    free.insert("t", spark.createDataFrame([(1, "1", "x" * 5000)], "n int, id string, v string"), "n")
    assert free.scan("t").count() == 1


def test_changes_survive_the_object(spark):
    made = Tables(spark)
    oid = made.create("T", [("id", "int64"), ("v", "varchar"), ("n", "int8")], "btree")

    def rows(*values):
        return spark.createDataFrame([(k, *x) for k, x in enumerate(values)], "nth int, id string, v string, n string")

    made.insert("t", rows(("1", "a", "1"), ("2", "b", "2"), ("3", "c", "3")), "nth")
    told = made.update("t", rows(("2", "B", "9"), ("7", "x", "0"), ("2", "late", "0")), "nth").collect()
    assert sorted((r["nth"], r["status"]) for r in told) == [(0, "ok"), (1, "missing"), (2, "duplicate")]
    made.delete("t", ("v", "=", "c"))
    again = Tables(spark, made.root)
    assert again.catalog.name_of(oid) == "T" and again.catalog.opened("t")[2] == "btree"
    assert sorted(tuple(r) for r in again.scan("t").collect()) == [(1, "a", 1), (2, "B", 9)]
    assert sorted(r["id"] for r in again.as_of("t", 1).collect()) == [1, 2, 3]
    assert {r["status"] for r in again.insert("t", rows(("3", "new", "5"), ("1", "no", "0")), "nth").collect()} == {"ok", "duplicate"}
    want = [(1, "a", 1), (2, "B", 9), (3, "new", 5)]
    assert sorted(tuple(r) for r in again.scan("t").collect()) == want
    assert [r["id"] for r in again.scan("t", ("v", "=", "b")).collect()] == []  # an old value of a row meets nothing
    again.compact("t")
    assert sorted(tuple(r) for r in made.scan("t").collect()) == want
    assert made.storage("t").first()["n_folders"] == 1
    made.insert("t", rows(("8", "z", "1")), "nth")
    assert made.scan("t").count() == 4
    with pytest.raises(CatalogError, match="exists"):
        again.create("t", [("id", "int64")])
    assert made.create("u", [("id", "int64")]) == oid + 4 == again.catalog.opened("U")[0]


def test_conditions_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = conditions.where(spark.read.parquet(str(tmp_path / "t")), ("id", ">=", 10), ("v", "!=", 40))
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "Not(EqualTo(v,40))" in plan
    assert df.count() == 89
    with pytest.raises(ValueError):
        conditions.where(df, ("nope", "=", 1))
    with pytest.raises(ValueError):
        conditions.where(df, ("id", "<>", 1))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=1, max_size=60), st.integers(1, 60))
def test_versions_against_a_dict(spark, writes, at):
    log = [(k, v + 1, 1 if live else 2, v * 10) for v, (k, live) in enumerate(writes)]
    df = spark.createDataFrame(log, "k int, v long, op int, x int")
    state = {}
    for k, v, op, x in log:
        if v <= at:
            state.pop(k, None)
            if op == 1:
                state[k] = x
    assert {r["k"]: r["x"] for r in versions.as_of(df, "k", "v", "op", at).collect()} == state
    chain = versions.history(df, "k", "v", 7)
    assert {r["k"]: r["x"] for r in versions.visible(chain, "op", at).collect()} == state


def test_replay_is_snapshot_and_tail(spark):
    rng = random.Random(5)
    log = [(i, rng.randrange(9), rng.choice([1, 1, 2]), i) for i in range(200)]
    df = spark.createDataFrame(log, "lsn long, k int, type int, x int")
    full = sorted(map(tuple, replay.replay(df, "k", ["x"]).collect()))
    for at in (0, 57, 199):
        shot = replay.replay(df.filter(F.col("lsn") <= at), "k", ["x"])
        assert sorted(map(tuple, replay.replay(df, "k", ["x"], shot, at).collect())) == full


def test_ranks(spark):
    df = spark.createDataFrame([(k * k - 50,) for k in range(40)], "k long")
    assert sorted((r["rank"], r["k"]) for r in keys.ranked(df, "k", 7).collect()) == [(k + 1, k * k - 50) for k in range(40)]
    assert keys.ranked(df.limit(0), "k", 7).count() == 0
    # one key far from all others, repeated keys, null keys
    odd = [*range(20_000), 2**62, *[5] * 50, *[None] * 9]
    got = keys.ranked(spark.createDataFrame([(k,) for k in odd], "k long").repartition(6), "k", 16)
    ordered = [r["k"] for r in got.orderBy("rank").collect()]
    assert ordered == sorted(odd, key=lambda k: (k is not None, k or 0))
    assert sorted(r["rank"] for r in got.select("rank").collect()) == list(range(1, len(odd) + 1))
    parts = got.groupBy(F.expr("rank div 2000")).count()
    assert parts.count() == 11
