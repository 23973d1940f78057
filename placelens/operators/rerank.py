"""Rerank search candidates by similarity, rating, popularity and price intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions import metadata as M
from placelens.functions.text import contains_any


def detect_intent(query: Column, intents: dict[str, list[str]] | None = None) -> Column:
    """Name of the strongest price intent in the query, else 'none'."""
    lowered = F.lower(query)
    found = [
        F.when(contains_any(lowered, words), F.lit(name))
        for name, words in (intents or fixed.INTENT_WORDS).items()
    ]
    return F.coalesce(*found, F.lit("none"))


def split_queries(queries: DataFrame, query: str = "query") -> tuple[DataFrame, DataFrame]:
    """Usable queries, and the empty or blank ones that are refused."""
    usable = F.length(F.trim(F.coalesce(F.col(query), F.lit("")))) > 0
    return queries.filter(usable), queries.filter(~usable)


def min_max(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / (high - low)


def rerank(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    weights: dict[str, float] | None = None,
    intents: dict[str, list[str]] | None = None,
    complete_by: Column | None = None,
) -> DataFrame:
    """The k best candidates per query with final_score, price_score, intent and rank.

    Candidates carry query_id, posisi, similarity_score, rating_rata,
    jumlah_review, harga_minimum and facilities; queries carry query_id and query.
    All scalings run over one query's candidates, so one shuffle serves them.
    `complete_by` counts what makes a place complete: its facilities by default,
    or its price items with price_item_count.
    """
    w = {**fixed.RANK_WEIGHTS, **(weights or {})}
    one_query = Window.partitionBy("query_id")
    low = lambda c: F.min(c).over(one_query)
    high = lambda c: F.max(c).over(one_query)

    intent = queries.select("query_id", detect_intent(F.col("query"), intents).alias("intent"))
    rated = F.col("rating_rata")
    price = F.nanvl(F.col("harga_minimum"), F.lit(None))
    signals = (
        candidates.join(intent, "query_id")
        .withColumn("_price", price)
        .withColumn("_reviews", F.coalesce(F.col("jumlah_review").cast("double"), F.lit(0.0)))
        .withColumn("_items", (M.facility_count(F.col("facilities")) if complete_by is None else complete_by).cast("double"))
    )
    for c in ("_price", "_reviews", "_items"):
        signals = signals.withColumn(f"{c}_low", low(c)).withColumn(f"{c}_high", high(c))

    def scaled(c: str, equal: Column) -> Column:
        bottom, top = F.col(f"{c}_low"), F.col(f"{c}_high")
        return F.when(top == bottom, equal).otherwise(min_max(F.col(c), bottom, top))

    one, zero, half = F.lit(1.0), F.lit(0.0), F.lit(0.5)
    free = F.when(F.col("_price").isNull() | (F.col("_price") == 0), one).otherwise(zero)
    cheap = F.when(F.col("_price").isNull(), half).otherwise(one - scaled("_price", zero))
    price_score = (
        F.when(F.col("intent") == "gratis", free)
        .when(F.col("intent") == "murah", cheap)
        .when(F.col("intent") == "lengkap", scaled("_items", one))
        .otherwise(one)
    )
    similarity = F.greatest(zero, F.least(one, F.col("similarity_score")))
    rating = F.when(rated.isNull() | F.isnan(rated) | (rated == 0), half).otherwise((rated - 1) / 4)
    popularity = scaled("_reviews", F.when(F.col("_reviews_high") > 0, one).otherwise(zero))
    final = (
        w["similarity"] * similarity
        + w["rating"] * rating
        + w["popularity"] * popularity
        + w["price"] * F.col("price_score")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.asc("posisi"))
    return (
        signals.withColumn("price_score", price_score)
        .withColumn("final_score", F.round(final, 4))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
        .select(*candidates.columns, "intent", "price_score", "final_score", "rank")
    )


def format_results(results: DataFrame) -> DataFrame:
    """Price items and facilities of results as arrays; broken JSON stays in price_items_text."""
    items = M.price_items(F.col("price_items"))
    return results.withColumns(
        {
            "price_items_text": F.when(items.isNull(), F.col("price_items")),
            "price_items": items,
            "facilities": M.facility_output(F.col("facilities")),
        }
    )


def result_cards(results: DataFrame) -> DataFrame:
    """The texts shown for a result: price, facilities, rating, photo."""
    return results.withColumns(
        {
            "harga_teks": M.price_text(F.col("harga_minimum")),
            "fasilitas_teks": M.facility_summary(F.col("facilities")),
            "rating_teks": F.format_number(F.coalesce("rating_rata", F.lit(0.0)), 1),
            "foto": M.photo_or_default(F.col("photo_url")),
        }
    )


def filter_location(results: DataFrame, location: Column, field: str = "lokasi") -> DataFrame:
    """Results whose place lies in the asked location; runs after the ranking, so fewer may remain."""
    asked = F.coalesce(location, F.lit(""))
    anywhere = asked.isin("", fixed.ANY_LOCATION)
    inside = F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lower(asked))
    return results.filter(anywhere | inside)
