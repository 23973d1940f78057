"""The kept keyword index against the scan of all texts, its bounds, and what it reads."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from placelens.operators import keyword_index
from placelens.operators.blocks import score_blocks
from placelens.operators.keyword_index import KeywordIndex, indexed_search
from placelens.operators.tfidf import build_tfidf, sparse_scorer, tfidf_search, tfidf_vectors
from placelens.session import materialise

WORDS = [f"w{i}" for i in range(300)]
WEIGHTS = [1 / (i + 1) for i in range(300)]


@pytest.fixture(scope="module")
def reviews(spark):
    """Few words in most texts, a third of all texts alike, odd ones among them."""
    rng = random.Random(4)
    rows = [(i, " ".join(["common", *rng.choices(WORDS, WEIGHTS, k=rng.randrange(1, 30))])) for i in range(400)]
    rows += [(400 + i, "common w250 w3 w1") for i in range(200)]
    rows += [(600, None), (601, ""), (602, "- !"), (603, "w299 " * 500), (604, "Common W250")]
    rows = [(i, f"place {i % 70}", "kota", t) for i, t in rows] + [(None, "none", None, "w250 w251 unnamed")]
    return spark.createDataFrame(rows, "id long, nama string, lokasi string, teks_mentah string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 8))) + " common" * (i % 2)) for i in range(25)]
    rows += [(100, "common"), (101, "unheard of"), (102, ""), (103, None), (104, "w250 w3 w1 common"), (105, "unnamed w299")]
    rows += [(None, "w250 common"), (106, " ".join(WORDS))]
    return spark.createDataFrame(rows, "query_id long, query string")


@pytest.fixture(scope="module")
def named(reviews):
    """The scan of all texts holds ids as numbers, where a missing one has no place."""
    return reviews.filter("id IS NOT NULL")


@pytest.fixture(scope="module")
def folder_of_index(named, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keywords") / "index")
    KeywordIndex.build(named, folder, buckets=16)
    return folder


@pytest.fixture(scope="module")
def by_scan(queries, named):
    """All scores, by the scan of every text."""
    index = build_tfidf(named)
    asked = tfidf_vectors(queries, index.vocabulary, "query_id", "query")
    return rows_of(score_blocks(asked, index.vectors, sparse_scorer, 5000, "query_id", "id", F.size("terms")))


def rows_of(found):
    return sorted((r.query_id or -1, r.posisi, -1 if r.id is None else r.id, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize(("k", "share"), [(1, 0), (40, 0), (40, 3), (5000, 50)])
def test_index_equals_scan(monkeypatch, spark, queries, folder_of_index, by_scan, k, share):
    """By postings alone, and with the queries of many postings scanned."""
    monkeypatch.setattr(keyword_index, "SCAN_SHARE", share)
    monkeypatch.setattr(keyword_index, "BLOCK_ROWS", 500 if k == 40 else 200_000)
    assert rows_of(KeywordIndex(spark, folder_of_index).topk(queries, k)) == [r for r in by_scan if r[1] <= k]


def test_several_files_and_a_missing_id(monkeypatch, spark, reviews, queries, tmp_path):
    monkeypatch.setattr(keyword_index, "FILE_ROWS", 200)
    index = KeywordIndex.build(reviews, str(tmp_path / "index"), buckets=3)
    assert len(index.postings.inputFiles()) > 6
    found = rows_of(index.topk(queries, 7))
    assert -1 not in {r[2] for r in found} and index.texts == KeywordIndex.build(reviews, str(tmp_path / "again")).texts
    assert rows_of(KeywordIndex(spark, index.folder).topk(queries, 7)) == found


def test_bands_and_lists_out_of_reach_are_skipped(monkeypatch, spark, folder_of_index):
    index = KeywordIndex(spark, folder_of_index)
    asked = spark.createDataFrame([(1, "w280 w270 common")], "query_id long, query string")
    monkeypatch.setattr(keyword_index, "SCAN_SHARE", 5)
    wanted, read, sums, of = [], [], index._sums, index.postings_of

    def noted(rows):
        wanted.append({(r.term, r.band) for r in rows.collect()})
        return sums(rows)

    def noted_files(buckets):
        read.append(of(buckets).select(F.input_file_name()).distinct().count())
        assert re.search(r"PartitionFilters: \[.*bucket#\d+ (= |IN)", of(buckets)._jdf.queryExecution().executedPlan().toString())
        return of(buckets)

    monkeypatch.setattr(index, "_sums", noted)
    monkeypatch.setattr(index, "postings_of", noted_files)
    assert index.topk(asked, 1).count() == 1
    # The word of every text gives no candidates; only files of the three words' buckets are read.
    assert {term for term, _ in wanted[1]} <= {"w280", "w270"}
    assert max(read) <= 3 * 4 < len(index.postings.inputFiles())


def test_search_through_the_index(spark, named, queries, folder_of_index):
    index = KeywordIndex(spark, folder_of_index)
    key = lambda r: (r.query_id or -1, r["rank"])
    got = sorted(indexed_search(queries, named, index, 3).collect(), key=key)
    assert got == sorted(tfidf_search(queries, named, 3).collect(), key=key) and len(got) > 40


def test_postings_move_as_lists_and_are_stored_once(monkeypatch, spark, named, folder_of_index, tmp_path):
    stored = []
    monkeypatch.setattr(keyword_index, "materialise", lambda df: stored.append(df.columns) or materialise(df))
    index = KeywordIndex.build(named, str(tmp_path / "index"), buckets=16)
    assert stored and not any("item" in columns or "term" in columns for columns in stored)
    lists = index.vectors.mapInArrow(keyword_index._term_lists, keyword_index._list_schema(index.vectors))
    assert lists.count() < index.postings.count() / 2
    once = index.postings.groupBy("term", "item").count()
    assert once.filter("count > 1").count() == 0 and once.count() == index.vectors.select(F.explode("terms")).count()
    # The sums of the bands are those of the stored postings, of which the vocabulary counts the texts.
    bands = index.terms.select("term", "df", F.inline("bands"))
    assert bands.groupBy("term").agg(F.sum("n").alias("n"), F.first("df").alias("df")).filter("n != df").count() == 0


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None), (2, "!")], "id long, teks_mentah string")
    index = KeywordIndex.build(none, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word")], "query_id long, query string")
    assert index.texts == 1 and index.topk(asked, 3).count() == 0


def test_columns_named_like_its_own(spark, tmp_path):
    rows = spark.createDataFrame([("a", "lake"), ("b", "lake hill")], "term string, item string")
    index = KeywordIndex.build(rows, str(tmp_path / "index"), item_id="term", text="item")
    asked = spark.createDataFrame([(1, "hill")], "score long, bands string")
    found = index.topk(asked, 3, query_id="score", text="bands")
    assert [(r[0], r[1]) for r in found.collect()] == [(1, "b")]
