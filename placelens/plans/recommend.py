"""Search plans: retrieve more than asked, then rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.operators.encode import HashingEncoder, encode
from placelens.operators.evaluate import evaluate, mean_metrics
from placelens.operators.rerank import filter_location, rerank, split_queries
from placelens.operators.vector_index import VectorIndex
from placelens.operators.vector_search import attach_metadata, vector_topk


def recommend(
    queries: DataFrame,
    vectors: DataFrame | VectorIndex,
    places: DataFrame,
    k: int = 10,
    overfetch: int = 3,
    location: str | None = None,
    **ranking,
) -> DataFrame:
    """The k best places per query.

    Queries are (query_id, query, embedding), vectors (id, embedding) or a kept
    index of them, places (id, metadata). Retrieval fetches `overfetch` * k candidates by similarity.
    With a location only places in it compete (an index is then read whole), so k results remain if there are
    as many; `filter_location` on the results is the other way, after the cut.
    """
    usable, _ = split_queries(queries)
    if location is not None:
        inside = filter_location(places, F.lit(location))
        rows = vectors.items if isinstance(vectors, VectorIndex) else vectors
        vectors = rows.join(inside.select("id"), "id", "left_semi")
    if isinstance(vectors, VectorIndex):
        candidates = vectors.topk(usable, overfetch * k)
    else:
        candidates = vector_topk(usable, vectors, overfetch * k)
    return rerank(usable, attach_metadata(candidates, places), k, **ranking)


def recommend_texts(
    queries: DataFrame, vectors: DataFrame, places: DataFrame, make_encoder=HashingEncoder, **options
) -> DataFrame:
    """As `recommend`, for queries (query_id, query) that still have to be encoded."""
    texts = queries.withColumn("_text", F.col("query"))
    return recommend(encode(texts, "_text", make_encoder), vectors, places, **options)


def run_evaluation(
    queries: DataFrame, vectors: DataFrame, places: DataFrame, truth: DataFrame, fetch: int = 20, k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Metrics per query and their means, for `fetch` candidates reranked to k."""
    usable, _ = split_queries(queries)
    candidates = attach_metadata(vector_topk(usable, vectors, fetch), places)
    per_query = evaluate(queries, rerank(usable, candidates, k), truth, "id")
    return per_query, mean_metrics(per_query)
