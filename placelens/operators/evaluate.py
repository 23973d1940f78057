"""Ranking metrics per query, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(
    queries: DataFrame, results: DataFrame, truth: DataFrame, item: str, recall_at=(5, 10), ndcg_at: int = 10
) -> DataFrame:
    """recall_at_k, mrr and ndcg_at_k per query.

    `results` is (query_id, item, rank), `truth` is (query_id, item) with
    distinct rows. Queries without results or without truth score 0.
    """
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = results.select("query_id", item, "rank").join(truth, ["query_id", item])
    found = {f"_hits_{k}": F.countDistinct(F.when(F.col("rank") <= k, F.col(item))) for k in recall_at}
    gain = F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per_query = hits.groupBy("query_id").agg(
        *[value.alias(name) for name, value in found.items()],
        F.min("rank").alias("_first"),
        F.sum(gain).alias("_dcg"),
    )
    joined = (
        queries.select("query_id").distinct().join(size, "query_id", "left").join(per_query, "query_id", "left")
    )
    relevant = F.coalesce("n_relevant", F.lit(0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.greatest(relevant, F.lit(1)), F.lit(ndcg_at)).cast("int")),
        F.lit(0.0),
        lambda total, i: total + 1 / F.log2(i + 1),
    )
    recalls = [
        F.when(relevant > 0, F.coalesce(f"_hits_{k}", F.lit(0)) / relevant).otherwise(0.0).alias(f"recall_at_{k}")
        for k in recall_at
    ]
    return joined.select(
        "query_id",
        relevant.alias("n_relevant"),
        *recalls,
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.when(relevant > 0, F.coalesce("_dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias(f"ndcg_at_{ndcg_at}"),
    )


def mean_metrics(per_query: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Means over all queries; with targets, a passed flag per target."""
    names = [c for c in per_query.columns if c not in ("query_id", "n_relevant")]
    means = per_query.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in names])
    passed = {f"{c}_passed": F.col(c) >= goal for c, goal in (targets or {}).items()}
    return means.withColumns(passed) if passed else means
