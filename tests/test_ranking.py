import math

import pytest

from placelens.functions import fixed_values as fixed
from placelens.operators.evaluate import evaluate, mean_metrics
from placelens.operators.rerank import filter_location, format_results, rerank, result_cards, split_queries
from pyspark.sql import functions as F

SCHEMA = (
    "query_id long, posisi int, nama_tempat string, similarity_score double, rating_rata double, "
    "jumlah_review long, harga_minimum double, facilities string"
)


def run(spark, query, rows, k=10, **options):
    candidates = spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], SCHEMA)
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    ranked = rerank(queries, candidates, k, **options).orderBy("rank").collect()
    return [(r["nama_tempat"], r["final_score"], r["price_score"]) for r in ranked]


MOCK = [
    ("A", 0.85, 4.5, 120, 50000.0, "Toilet | Mushola"),
    ("B", 0.80, 4.8, 300, 20000.0, "Toilet | Mushola | Wifi | Kolam Renang"),
]


def test_cheap_wins_over_complete(spark):
    got = run(spark, "camping keluarga dengan fasilitas lengkap dan murah", MOCK)
    assert [g[0] for g in got] == ["B", "A"]
    assert got[0][1] == 0.8875
    assert got[1][1] == pytest.approx(0.64375, abs=1e-4)


def test_intents(spark):
    rows = [("a", 0.5, 3.0, 5, None, None), ("b", 0.5, 3.0, 5, 0.0, "x"), ("c", 0.5, 3.0, 5, 10.0, '["x","y","z"]')]
    scores = lambda query: {n: s for n, _, s in run(spark, query, rows)}
    assert scores("gratis") == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert scores("murah") == {"a": 0.5, "b": 1.0, "c": 0.0}
    assert scores("lengkap") == {"a": 0.0, "b": pytest.approx(1 / 3), "c": 1.0}
    assert scores("sejuk") == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_equal_signals(spark):
    same = [("a", 0.5, 3.0, 5, 7.0, "x"), ("b", 0.5, 3.0, 5, 7.0, "y")]
    assert [s for _, _, s in run(spark, "murah", same)] == [1.0, 1.0]
    assert [s for _, _, s in run(spark, "lengkap", same)] == [1.0, 1.0]
    assert [n for n, _, _ in run(spark, "x", same)] == ["a", "b"]
    assert run(spark, "x", same)[0][1] == round(0.25 + 0.125 + 0.15 + 0.1, 4)
    unrated = [("a", 1.7, None, None, None, None), ("b", -0.4, 0.0, None, None, None), ("c", 0.2, float("nan"), 0, None, None)]
    assert [(n, f) for n, f, _ in run(spark, "murah", unrated)] == [("a", 0.675), ("c", 0.275), ("b", 0.175)]


def test_weights_and_k(spark):
    only_price = {"similarity": 0, "rating": 0, "popularity": 0, "price": 1}
    assert run(spark, "murah", MOCK, k=1, weights=only_price) == [("B", 1.0, 1.0)]


def test_blank_queries_are_refused(spark):
    queries = spark.createDataFrame([(1, "a"), (2, ""), (3, "  "), (4, None)], "query_id long, query string")
    usable, refused = split_queries(queries)
    assert [r[0] for r in usable.collect()] == [1]
    assert [r[0] for r in refused.orderBy("query_id").collect()] == [2, 3, 4]


def test_location(spark):
    df = spark.createDataFrame([("Sleman, DIY", "sleman"), ("Bantul", "sleman"), (None, "x"), (None, "Semua Lokasi"), ("a", None)], "lokasi string, f string")
    assert filter_location(df, F.col("f")).count() == 3
    assert filter_location(df, F.lit("bantul")).count() == 1


def test_formatted_results_and_cards(spark):
    rows = [('[{"item":"Tiket","harga":5000,"kategori":"biaya wajib"}]', "A | B", 5000.0, 4.56, "nan"), ("[oops", None, None, None, "http://p")]
    df = spark.createDataFrame(rows, "price_items string, facilities string, harga_minimum double, rating_rata double, photo_url string")
    a, b = result_cards(format_results(df)).collect()
    assert a["price_items"][0]["item"] == "Tiket" and a["price_items_text"] is None
    assert (b["price_items"], b["price_items_text"]) == (None, "[oops")
    assert (a["facilities"], b["facilities"]) == (["A", "B"], [])
    assert (a["harga_teks"], a["fasilitas_teks"], a["rating_teks"], a["foto"]) == ("Rp 5.000", "A | B", "4.6", fixed.NO_PHOTO)
    assert (b["harga_teks"], b["fasilitas_teks"], b["rating_teks"], b["foto"]) == (fixed.NO_PRICE, fixed.NO_FACILITIES, "0.0", "http://p")


def test_metrics(spark):
    truth = {1: ["a", "b", "c"], 2: ["z"], 4: ["q"] + [f"m{i}" for i in range(20)]}
    results = {1: ["x", "a", "y", "b", "v", "c"], 2: ["a", "b"], 3: ["a"], 4: ["q", "m1"]}
    long = lambda d, numbered: [(q, n, *([i + 1] if numbered else [])) for q, names in d.items() for i, n in enumerate(names)]
    got = evaluate(
        spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "query_id long"),
        spark.createDataFrame(long(results, True), "query_id long, nama string, rank int"),
        spark.createDataFrame(long(truth, False), "query_id long, nama string"),
        "nama",
    )
    rows = {r["query_id"]: r for r in got.collect()}
    gain = lambda *ranks: sum(1 / math.log2(r + 1) for r in ranks)
    assert rows[1]["recall_at_5"] == pytest.approx(2 / 3) and rows[1]["recall_at_10"] == 1.0
    assert rows[1]["mrr"] == 0.5
    assert rows[1]["ndcg_at_10"] == pytest.approx(gain(2, 4, 6) / gain(1, 2, 3))
    assert [rows[2][c] for c in ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")] == [0, 0, 0, 0]
    assert [rows[i]["ndcg_at_10"] for i in (3, 5)] == [0, 0] and rows[5]["n_relevant"] == 0
    assert rows[4]["ndcg_at_10"] == pytest.approx(gain(1, 2) / gain(*range(1, 11)))
    means = mean_metrics(got, {"mrr": 0.3, "recall_at_5": 0.9}).first()
    assert means["n_queries"] == 5 and means["mrr"] == pytest.approx(0.3)
    assert (means["mrr_passed"], means["recall_at_5_passed"]) == (True, False)
