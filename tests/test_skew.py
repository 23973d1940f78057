import pytest
from pyspark.sql import functions as F

from placelens.operators import skew


@pytest.fixture
def tables(spark):
    """A key with most of the rows, rare ones, one without a match, and nulls."""
    keys = ["hot"] * 60 + ["warm"] * 20 + ["a", "b", "c", "lost", None, None]
    fact = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    dim = spark.createDataFrame([("hot", 1, "x"), ("warm", 2, None), ("a", 3, "y"), ("b", None, "z"), ("c", 5, "u"), ("none", 6, "v")], "k string, n int, s string")
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("given", [True, False])
def test_join_equals_plain_join(tables, no_broadcast, how, given):
    fact, dim = tables
    counts = fact.groupBy("k").agg(F.count("*").alias("_rows")) if given else None
    joined = skew.skew_safe_join(fact, dim, "k", F.col("id"), how, counts)
    plain = fact.join(dim, "k", how)
    key = lambda r: r["id"]
    assert joined.columns == plain.columns
    assert sorted(joined.collect(), key=key) == sorted(plain.collect(), key=key)


@pytest.mark.parametrize("small", [True, False])
def test_look_up_equals_plain_join(tables, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    fact, dim = tables
    got, plain = skew.look_up(fact, dim, "k"), fact.join(dim, "k")
    key = lambda r: r["id"]
    assert got.columns == plain.columns
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key)


def test_hot_rows_spread(tables, no_broadcast, spark):
    fact, dim = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.skew_safe_join(fact, dim, "k", F.col("id"))
        parts = joined.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1


def test_size_check(spark, monkeypatch):
    df = spark.range(5).withColumn("t", F.repeat(F.lit("x"), 100))
    assert skew.is_small(df)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 200)
    assert not skew.is_small(df)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 4)
    assert not skew.is_small(df)


def test_lists_are_whole_and_ordered(spark):
    rows = [("big", i, f"t{i}") for i in range(100)] + [("small", 7, "s7"), ("small", 3, "s3"), ("small", 900, None)]
    df = spark.createDataFrame(rows, "k string, o long, t string").repartition(7)
    lists = skew.assemble_lists(df, "k", "o", F.col("t"), 8).collect()
    got = {}
    for r in sorted(lists, key=lambda r: (r["k"], r["Segmen"])):
        got.setdefault(r["k"], []).extend(r["values"])
    assert got == {"big": [f"t{i}" for i in range(100)], "small": ["s3", "s7", None]}
    big = [r for r in lists if r["k"] == "big"]
    assert len(big) == 13 and max(len(r["values"]) for r in big) <= 8
    assert sorted(r["Segmen"] for r in lists if r["k"] == "small") == [0, 112]


@pytest.mark.parametrize("bucket", [3, 1000])
def test_dense_index(spark, bucket):
    ids = [5, 1, 10**17, 10**17 + 1, 44, 3, 2, 90, 91, 92, 1000, 7]
    df = spark.createDataFrame([(g, i) for i in ids for g in ("x", "y")], "g string, id long").repartition(5)
    rows = skew.dense_index(df, ["g", "id"], "n", 11, bucket).collect()
    expected = [(g, i, 11 + at) for at, (g, i) in enumerate(sorted((g, i) for g in "xy" for i in ids))]
    assert sorted(map(tuple, rows)) == expected


def test_dense_index_keeps_a_missing_order(spark):
    df = spark.createDataFrame([(None,), (4,), (2,), (9,)], "id long")
    assert sorted(r["n"] for r in skew.dense_index(df, ["id"], "n", 1, 1).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("given", [0, 60])
def test_dense_index_of_missing_orders_is_the_same_at_every_size(spark, given):
    rows = [(i if i < given else None, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("_tie", skew.row_digest(["id", "t"])).repartition(5)
    number = lambda bucket: {r.t: r.n for r in skew.dense_index(df, ["id"], "n", 1, bucket, ("_tie",)).collect()}
    assert number(10) == number(1000) and sorted(number(10).values()) == list(range(1, 201))
    ranges = df.groupBy(skew._digest_range("_tie", 20)).count().collect()
    assert len(ranges) == 20 and max(r["count"] for r in ranges) < 40
    assert sorted(r.n for r in skew.dense_index(df, ["id"], "n", 1, 10).collect()) == list(range(1, 201))


def test_dense_index_of_nothing(spark):
    assert skew.dense_index(spark.range(0), ["id"], "n").count() == 0


def test_first_copies(spark):
    rows = [("a", "t", 5), ("a", "t", 2), ("a", None, 7), ("a", None, 3), (None, "t", 9), ("a", "u", 1), ("a", "u", None)]
    df = spark.createDataFrame(rows, "p string, t string, o long")
    places = ["_none", "_order", "_tie"]
    got = skew.first_copies(skew.with_places(df, ["p", "t"], "o"), places).collect()
    assert sorted(r["_order"] for r in got) == [1, 2, 3, 9]


def test_dense_index_keeps_missing_groups(spark):
    df = spark.createDataFrame([("b", 1), (None, 5), (None, 2), ("a", 9)], "g string, id long")
    rows = skew.dense_index(df, ["g", "id"], "n").collect()
    assert sorted((r["n"], r["g"], r["id"]) for r in rows) == [(1, None, 2), (2, None, 5), (3, "a", 9), (4, "b", 1)]


def test_latest_value(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, 9, None), (3, 1, "z"), (3, 0, "y")]
    df = spark.createDataFrame(rows, "id long, seq int, status string")
    got = {r["id"]: r["status"] for r in skew.latest_value(df, "id", "status", "seq").collect()}
    assert got == {1: "c", 2: None, 3: "z"}
