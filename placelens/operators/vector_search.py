"""Exact vector search for a whole table of queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.functions.vectors import normalise
from placelens.operators.blocks import matrix, score_blocks, unit_rows
from placelens.operators.skew import look_up


def build_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The search table: unit vectors as float32, each with its key."""
    return vectors.withColumn(embedding, normalise(F.col(embedding)))


def cosine_scorer(embedding: str):
    def prepare(queries: pa.Table):
        left = unit_rows(matrix(queries.column(embedding)))
        return lambda items: left @ unit_rows(matrix(items.column(embedding))).T

    return prepare


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 20,
    query_id: str = "query_id",
    item_id: str = "id",
    embedding: str = "embedding",
    **blocks,
) -> DataFrame:
    """The k nearest items per query by cosine: (query_id, id, similarity_score, posisi).

    Zero vectors score 0. Fewer than k items give a shorter list.
    """
    asked = queries.select(query_id, embedding).filter(F.col(embedding).isNotNull())
    known = vectors.select(item_id, embedding).filter(F.col(embedding).isNotNull())
    found = score_blocks(
        asked, known, cosine_scorer(embedding), k, query_id, item_id, 8 * F.size(embedding), **blocks
    )
    return found.withColumnRenamed("score", "similarity_score")


def attach_metadata(candidates: DataFrame, places: DataFrame, item_id: str = "id") -> DataFrame:
    """Result rows with the place's metadata; rating and review count default to 0, the price stays null."""
    shown = {"rating_rata": F.lit(0.0), "jumlah_review": F.lit(0).cast("bigint")}
    joined = look_up(candidates, places, item_id)
    filled = [
        F.coalesce(F.nanvl(F.col(c), F.lit(None)) if c == "rating_rata" else F.col(c), shown[c]).alias(c)
        if c in shown
        else F.col(c)
        for c in joined.columns
    ]
    return joined.select(*filled)
