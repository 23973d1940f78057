"""The kept vector index against brute force, its pruning, and block scans without a shuffle of items."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.operators import blocks, vector_index
from placelens.operators.encode import HashingEncoder, encode, encode_places, profile_pieces
from placelens.operators.vector_index import VectorIndex
from placelens.operators.vector_search import cosine_scorer, vector_topk
from test_blocks import brute_force


def by_query(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["posisi"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity_score"]))
    return got


def as_table(spark, rows, key):
    listed = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(listed, f"{key} long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8)) * 4
    items = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.2).astype(np.float32).astype(float)
    items[17] = 0
    items[100:400] = items[100]  # a third of all rows are copies
    asked = np.vstack([centres[:5] + 0.1, items[100:101], np.zeros((1, 8))]).astype(np.float32).astype(float)
    return items, asked


@pytest.mark.parametrize("k", [1, 10, 350, 2000])
@pytest.mark.parametrize("max_queries", [1024, 2])
def test_index_equals_brute_force(spark, clustered, tmp_path, monkeypatch, k, max_queries):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 100)
    items, asked = clustered
    VectorIndex.build(as_table(spark, items, "id"), str(tmp_path / "index"), cells=20, sample=200)
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.items.count() == len(items) and index.count.sum() == len(items)
    expected = brute_force(items, asked, k)
    for _ in range(2 if k == 10 else 1):
        again = VectorIndex(spark, str(tmp_path / "index"))
        assert by_query(again.topk(as_table(spark, asked, "query_id"), k, max_queries=max_queries)) == expected


def test_cells_out_of_reach_are_not_read(spark, clustered, tmp_path, monkeypatch):
    items, asked = clustered
    index = VectorIndex.build(as_table(spark, items, "id"), str(tmp_path / "index"), cells=12)
    read, whole = [], index.items_of

    def noted(cells):
        read.extend(r[0] for r in whole(cells).select(F.input_file_name()).distinct().collect())
        plan = whole(cells)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in plan
        return whole(cells)

    monkeypatch.setattr(index, "items_of", noted)
    got = by_query(index.topk(as_table(spark, asked[:2], "query_id"), 10))
    assert got == brute_force(items, asked[:2], 10)
    assert 0 < len(set(read)) <= len(index.items.inputFiles()) // 2


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    index = VectorIndex.build(none, str(tmp_path / "index"))
    found = index.topk(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), 3)
    assert found.count() == 0 and found.columns == ["query_id", "id", "similarity_score", "posisi"]


def test_many_queries_without_a_shuffle_of_items(spark):
    rng = np.random.default_rng(2)
    items, asked = (rng.normal(size=(n, 6)).astype(np.float32).astype(float) for n in (200, 5000))
    table, queries = as_table(spark, items, "id"), as_table(spark, asked, "query_id")
    made = list(blocks.query_blocks(queries, "query_id", 8 * F.size("embedding"), 1024, 60_000))
    assert sum(b.num_rows for b in made) == 5000
    assert all(b.num_rows <= 1024 and b.column("embedding").combine_chunks().flatten().nbytes * 2 <= 60_000 for b in made)
    stored = spark.read.parquet(_written(table))
    plan = blocks.scan_items(made[0], stored, cosine_scorer("embedding"), 3, "query_id", "id")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert by_query(vector_topk(queries, table, 3)) == brute_force(items, asked, 3)


def _written(table):
    from placelens.session import run_folder

    path = run_folder(table.sparkSession)
    table.write.parquet(path)
    return path


def test_queries_of_one_id_stay_together(spark):
    queries = spark.range(50).select(F.lit(7).cast("long").alias("query_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    made = list(blocks.query_blocks(queries, "query_id", F.lit(1), 10, 1000))
    assert [b.num_rows for b in made] == [50]


def test_profiles_are_cleaned_and_cut(spark):
    rows = [("a", "See https://x.org/y @me #tag fine   lake!!"), ("a", " ".join(f"w{i}" for i in range(600))), ("b", None), ("c", "@only #tags")]
    reviews = spark.createDataFrame(rows, "nama string, teks string")
    pieces = profile_pieces(reviews, "nama", "teks").collect()
    assert sorted((p.nama, p.words) for p in pieces) == [("a", 3), ("a", 88), ("a", 256), ("a", 256), ("b", 1), ("c", 1)]
    assert "see fine lake!" in {p.teks for p in pieces}
    small = lambda: HashingEncoder(16)
    got = {r.nama: np.array(r.embedding) for r in encode_places(reviews, "nama", "teks", small).collect()}
    bare = "see fine lake! " + rows[1][1]
    whole = spark.createDataFrame([("a", bare)], "nama string, teks string")
    expected = np.array(encode(whole, "teks", small).first().embedding)
    unit = lambda v: v / np.linalg.norm(v)
    assert np.allclose(unit(got["a"]), unit(expected)) and not got["b"].any() and not got["c"].any()


def test_pieces_of_other_encoders_count_by_their_words(spark):
    class Flags:
        def __call__(self, texts):
            return np.array([[1.0, 0.0] if "x" in t else [0.0, 1.0] for t in texts])

    reviews = spark.createDataFrame([("a", "x x x"), ("a", "y")], "nama string, teks string")
    row = encode_places(reviews, "nama", "teks", Flags, additive=False).first()
    assert row.embedding == [0.75, 0.25]
