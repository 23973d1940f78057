"""Keyword search: TF-IDF with smoothed idf and cosine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.functions.text import term_counts, tokens
from placelens.operators.blocks import best_rows, by_score, score_blocks
from placelens.operators.skew import look_up, most_frequent, skew_safe_join
from placelens.session import materialise

MIN_SCORE = 0.01
# Terms with their idf that every worker holds, in bytes.
HOT_BYTES = 8 << 20


@dataclass
class TfidfIndex:
    """Number of texts, vocabulary (term, df, idf) and one unit vector (terms, weights) per text."""

    texts: int
    vocabulary: DataFrame
    vectors: DataFrame


def search_table(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """Reviews (tempat_id, teks_mentah) with the columns of their place (id, nama, lokasi, ...), as the searches take them.

    Reviews of an unknown place are left out, as are places without reviews;
    places with very many reviews do not gather in one task.
    """
    named = places.withColumnRenamed("id", "tempat_id")
    spread = F.xxhash64("teks_mentah")
    return skew_safe_join(reviews, named, "tempat_id", spread)


def usable_reviews(reviews: DataFrame, text: str) -> DataFrame:
    return reviews.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def document_frequency(texts: DataFrame, text: str) -> DataFrame:
    """(term, df): each text counts once per term, so counts combine before the shuffle."""
    terms = texts.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_vectors(texts: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, weights): tf * idf of the known terms of a text, at length one. Texts of one key are one text.

    The most frequent terms, of bounded size, are sent to all tasks and weighed where the text lies. Only the
    other ones, few of the words of a text, are shuffled to meet their idf, and join their whole text by its key.
    """
    size = F.octet_length("term") + 16
    hot = most_frequent(vocabulary, "df", size, HOT_BYTES)
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary.filter(hot).select("term", "idf").toArrow())
    counted = texts.select(key, F.inline(term_counts(F.col(text))))
    rare = counted.join(F.broadcast(vocabulary.filter(hot).select("term")), "term", "left_anti")
    rare = rare.join(vocabulary.filter(~hot).select("term", "idf"), "term")
    pair = F.struct("term", (F.col("tf") * F.col("idf")).alias("weight"))
    whole = texts.select(key, F.col(text).alias("_text"), F.lit(None).alias("_rare"))
    parts = whole.unionByName(rare.select(key, F.lit(None).alias("_text"), pair.alias("_rare")))
    # A group is one text, so its lists are no longer than the text; dealt by key first, texts are not sorted twice.
    per_text = parts.repartition(key).groupBy(key).agg(
        F.flatten(F.transform(F.collect_list("_text"), lambda t: F.coalesce(term_counts(t), F.array()))).alias("_counts"),
        F.collect_list("_rare").alias("_rare"),
    )
    columns = per_text.select(
        key, F.col("_counts.term").alias("_terms"), F.col("_counts.tf").alias("_tfs"),
        F.col("_rare.term").alias("_rare_terms"), F.col("_rare.weight").alias("_rare_weights"),
    )
    kinds = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]
    return columns.mapInArrow(_unit_vectors(shared), T.StructType([texts.schema[key], *kinds]))


def _unit_vectors(shared: Broadcast) -> Callable:
    """From texts with counted terms, and rare ones with their weights, to unit vectors; those without known terms go."""

    def weigh(batches):
        idf = shared.value.column("idf").to_numpy()
        for batch in batches:
            key, terms, tfs, rare_terms, rare_weights = batch.columns
            known = shared.value.column("term").combine_chunks().cast(terms.type.value_type)
            every = np.arange(len(key))
            row = np.repeat(every, terms.value_lengths().to_numpy(zero_copy_only=False))
            at = pc.index_in(terms.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            hot = np.flatnonzero(at >= 0)
            weights = tfs.flatten().to_numpy(zero_copy_only=False)[hot] * idf[at[hot]]
            rare_row = np.repeat(every, rare_terms.value_lengths().to_numpy(zero_copy_only=False))
            row = np.concatenate([row[hot], rare_row])
            order = np.argsort(row, kind="stable")
            row = row[order]
            weights = np.concatenate([weights, rare_weights.flatten().to_numpy(zero_copy_only=False)])[order]
            names = pa.concat_arrays([terms.flatten().take(pa.array(hot)), rare_terms.flatten()]).take(pa.array(order))
            norms = np.sqrt(np.bincount(row, weights * weights, len(key)))
            sizes = np.bincount(row, minlength=len(key))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (names, pa.array(weights / norms[row]))]
            found = [key.filter(pa.array(sizes > 0)), *lists]
            yield pa.RecordBatch.from_arrays(found, names=[batch.schema.names[0], "terms", "weights"])

    return weigh


def build_tfidf(reviews: DataFrame, key: str = "id", text: str = "teks_mentah") -> TfidfIndex:
    """Fit on a review table. The vocabulary is computed once and kept."""
    usable = usable_reviews(reviews, text)
    n = usable.count()
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    vocabulary = materialise(document_frequency(usable, text).withColumn("idf", idf))
    return TfidfIndex(n, vocabulary, tfidf_vectors(usable, vocabulary, key, text))


def sparse_scorer(queries: pa.Table):
    """Scores of sparse unit vectors, as products over the terms of the queries."""
    known = pc.unique(queries.column("terms").combine_chunks().flatten())

    def entries(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Row, known term and weight of the entries of sparse vectors, without unknown terms."""
        terms = table.column("terms").combine_chunks()
        weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
        term = pc.index_in(terms.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        return row[term >= 0], term[term >= 0], weights[term >= 0]

    row, term, weight = entries(queries)
    left = np.zeros((queries.num_rows, len(known)))
    left[row, term] = weight
    # Enough texts at a time to keep their dense block within some 32 MB.
    step = max(1, (4 << 20) // max(1, len(known)))

    def score(items: pa.Table) -> np.ndarray:
        row, term, weight = entries(items)
        scores = np.zeros((len(left), items.num_rows))
        for at in range(0, items.num_rows, step):
            here = slice(*np.searchsorted(row, [at, at + step]))
            dense = np.zeros((min(step, items.num_rows - at), len(known)))
            dense[row[here] - at, term[here]] = weight[here]
            scores[:, at : at + step] = left @ dense.T
        return np.where(scores >= MIN_SCORE, scores, -np.inf)

    return score


def tfidf_search(
    queries: DataFrame, reviews: DataFrame, k: int = 5, index: TfidfIndex | None = None, **blocks
) -> DataFrame:
    """The k best places per query: (query_id, rank, id, nama, lokasi, teks_mentah, skor_relevansi).

    The best 5k reviews are cut first, then the best one per place is kept, so
    fewer than k places may remain. Reviews are (id, nama, lokasi, teks_mentah).
    """
    if index is None:
        # Stored, so that no block of queries weighs the texts again.
        index = build_tfidf(reviews)
        index.vectors = materialise(index.vectors)
    asked = tfidf_vectors(queries.select("query_id", "query"), index.vocabulary, "query_id", "query")
    size = F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t) + 16)
    found = score_blocks(asked, index.vectors, sparse_scorer, 5 * k, "query_id", "id", size, **blocks)
    return place_results(found, reviews, k, 2)


def place_results(found: DataFrame, reviews: DataFrame, k: int, decimals: int) -> DataFrame:
    """Best review per query and place, then the k best places, with the whole review."""
    shown = reviews.select("id", "nama", "lokasi", "teks_mentah")
    # The windows see at most a few times k reviews per query.
    named = look_up(found.drop("posisi"), shown, "id")
    order = by_score("id")
    named = named.withColumn("_place", F.struct("query_id", "nama"))
    best = best_rows(named, "_place", 1, *order).drop("posisi", "_place")
    ranked = best_rows(best, "query_id", k, *order)
    return ranked.select(
        "query_id",
        F.col("posisi").alias("rank"),
        "id",
        "nama",
        "lokasi",
        "teks_mentah",
        F.round(F.col("score") * 100, decimals).alias("skor_relevansi"),
    )
