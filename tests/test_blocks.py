import numpy as np
import pytest

from placelens.operators.blocks import BestScores
from placelens.operators.lookup import find_places, find_places_like
from placelens.operators.phrases import PhraseFinder
from placelens.operators.vector_search import vector_topk

SMALL = {"max_queries": 3}


def tables(spark, n=60, q=7, d=5):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(n, d)).round(1)
    items[10] = 0
    items[20:30] = items[5]
    asked = rng.normal(size=(q, d))
    asked[2] = 0
    as_rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return (
        items.astype(np.float32).astype(float),
        asked.astype(np.float32).astype(float),
        spark.createDataFrame(as_rows(items), "id long, embedding array<float>").repartition(5),
        spark.createDataFrame(as_rows(asked), "query_id long, embedding array<float>"),
    )


def brute_force(items, asked, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    scores = unit(asked) @ unit(items).T
    expected = {}
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-round(row[i], 9), i))[:k]
        expected[q] = [(i, pytest.approx(row[i], abs=1e-9)) for i in order]
    return expected


@pytest.mark.parametrize("blocks", [{}, SMALL, {"max_bytes": 50}])
@pytest.mark.parametrize("k", [1, 8, 100])
def test_vector_topk_equals_brute_force(spark, blocks, k):
    items, asked, item_table, query_table = tables(spark)
    rows = vector_topk(query_table, item_table, k, **blocks).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["posisi"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity_score"]))
    assert got == brute_force(items, asked, k)


def test_no_queries_no_items(spark):
    _, _, items, queries = tables(spark)
    assert vector_topk(queries.limit(0), items, 3).count() == 0
    assert vector_topk(queries, items.limit(0), 3).count() == 0
    assert vector_topk(queries, items.limit(0), 3, **SMALL).count() == 0


def test_best_scores_keeps_state_small():
    best = BestScores(2, 3)
    for start in range(0, 1000, 100):
        best.offer(np.zeros((2, 100)), np.arange(start, start + 100)[::-1].copy())
    assert len(best.kept) == 6
    assert sorted(best.kept["id"]) == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize("few", [0, 1000])
def test_phrases(monkeypatch, few):
    monkeypatch.setattr(PhraseFinder, "FEW", few)
    finder = PhraseFinder(["ab", "", "abc", "x", "ab"])
    hits = finder.hits(["zabcz", "x", None, ""])
    assert hits.T.tolist() == [[1, 1, 1, 0, 1], [0, 1, 0, 1, 0], [0, 0, 0, 0, 0], [0, 1, 0, 0, 0]]


@pytest.mark.parametrize("blocks", [{}, {"max_queries": 2}])
def test_like(spark, blocks):
    places = spark.createDataFrame([(3, "Bukit Sikunir"), (1, "Camp 100%"), (2, "camp 1005"), (9, None)], "id long, nama string")
    asked = ["CAMP", "kit", "100%", "1_0%5", "xyz", "", "100"]
    lookups = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "q long, asked string")
    rows = find_places_like(lookups, places, "asked", "nama", "id", "q", **blocks).collect()
    assert {asked[r["q"]]: r["id"] for r in rows} == {"CAMP": 1, "kit": 3, "100%": 1, "1_0%5": 2, "": 1, "100": 1}


@pytest.mark.parametrize("small", [True, False])
def test_find_places(spark, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    places = spark.createDataFrame([(3, "Bukit"), (1, "bukit"), (2, "Kali")], "id long, nama string")
    lookups = spark.createDataFrame([("BUKIT",), ("kali",), ("x",), (None,)], "asked string")
    rows = {r["asked"]: (r["id"], r["nama"], r["found"]) for r in find_places(lookups, places, "asked", "nama", "id").collect()}
    assert rows == {"BUKIT": (1, "bukit", True), "kali": (2, "Kali", True), "x": (None, None, False), None: (None, None, False)}
