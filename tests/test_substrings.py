from random import Random

import pytest
from pyspark.sql import functions as F

from placelens.operators import substrings
from placelens.operators.lookup import _regex, find_places_like

TEXTS = ["", "ab", "abc", "Kali Kuning", "kali", "a%b_c", "back\\slash\\%", "\U0001F3D4 Merapi \U0001F3D4\U0001F3D4x", "aaaa", "a.b*c(d"]


def expected(patterns, names):
    """Plain search: per number of a pattern the lowest key of a name that holds it."""
    low = lambda text: text.encode().lower().decode()
    rows = {}
    for number, pattern in patterns:
        keys = [k for k, n in names if pattern is not None and n is not None and _regex(low(pattern)).search(low(n))]
        if keys:
            rows[number] = min(keys)
    return rows


@pytest.mark.parametrize(("share", "most"), [(1, 1), (4, 3), (1000, 1), (4, 1000)])
def test_like_equals_plain_search(spark, monkeypatch, share, most, no_broadcast):
    """Every text in one scan, by runs, and both; many, few and no patterns are left to the scan."""
    monkeypatch.setattr(substrings, "SCAN_SHARE", share)
    random = Random(7)
    names = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(99, None)]
    names += [(100 + i, "".join(random.choices("abkK%_ ", k=9))) for i in range(60)]
    patterns = TEXTS + [None, "%", "_", "ka%ning", "KALI", "zzz", "slash\\", "\\%", "a_b", "b*c", "\U0001F3D4_", "\U0001F3D4\U0001F3D4x", "li%li"]
    patterns = list(enumerate(patterns * 2))
    lookups = spark.createDataFrame(patterns, "q long, asked string")
    places = spark.createDataFrame(names, "id long, nama string")
    rows = find_places_like(lookups, places, "asked", "nama", "id", "q", max_queries=most).collect()
    assert {r["q"]: r["id"] for r in rows} == expected(patterns, names)
    assert len(rows) == len({r["q"] for r in rows})


def test_runs(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("\U0001F3D4xyz",)], "t string")
    rows = [r[0] for r in df.select(substrings.runs(F.col("t"))).collect()]
    assert rows == [["abc", "bca", "cab"], [], [], [], ["\U0001F3D4xy", "xyz"]]


def test_runs_of_a_long_text(spark):
    """A text of a million characters takes time in proportion."""
    df = spark.range(1).select(F.expr("repeat('abcdefghij', 100000)").alias("t"))
    assert df.select(F.size(substrings.runs(F.col("t")))).first()[0] == 10


def test_patterns_meet_few_texts(spark):
    """Only texts with the rarest run are checked; runs of no text and runs of most texts are not."""
    texts = spark.createDataFrame([(f"tempat {i:05d}", i) for i in range(1000)], "name string, id long")
    patterns = spark.createDataFrame([("00123",), ("tempat",), ("t 00077",), ("xyz",), ("7",)], "p string")
    rare = {r["p"]: r["_texts"] for r in substrings.rarest_runs(patterns, "p", texts, "name").collect()}
    assert rare == {"00123": 1, "tempat": 1000, "t 00077": 11, "xyz": 0, "7": None}
    found, left = substrings.first_holding(patterns, "p", texts, "name", "id")
    assert {r["p"]: r["id"] for r in found.collect()} == {"00123": 123, "t 00077": 77}
    assert sorted(r["p"] for r in left.collect()) == ["7", "tempat"]


def test_empty_tables(spark):
    lookups = spark.createDataFrame([], "q long, asked string")
    places = spark.createDataFrame([], "id long, nama string")
    assert find_places_like(lookups, places, "asked", "nama", "id", "q", max_queries=1).collect() == []
    lookups = spark.createDataFrame([(1, "abc"), (2, "x")], "q long, asked string")
    assert find_places_like(lookups, places, "asked", "nama", "id", "q", max_queries=1).collect() == []
