"""Scorecards: aspects, sentiment and visitor badges per place, from word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions.text import contains_any

PLACE = "Nama_Tempat"

# aspect key -> (label, icon, keywords); badge -> keywords; polarity -> keywords.
Aspects = dict[str, tuple[str, str, list[str]]]
Lexicon = dict[str, list[str]]


def _count(flag: Column) -> Column:
    return F.sum(flag.cast("bigint"))


def aspect_score(positive: Column, negative: Column) -> Column:
    """1 to 5 by the share of positive reviews, one decimal; 0 without any sentiment."""
    total = positive + negative
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(1 + 4 * positive / total, 1))


def review_flags(reviews: DataFrame, aspects: Aspects, sentiment: Lexicon, visitors: Lexicon) -> DataFrame:
    """Per review: place, sentiment flags and one flag per aspect and badge."""
    text = F.col("_text")
    flags = {f"_a{i}": contains_any(text, words) for i, (_, _, words) in enumerate(aspects.values())}
    flags |= {f"_b{i}": contains_any(text, words) for i, words in enumerate(visitors.values())}
    positive = contains_any(text, sentiment["positif"])
    negative = contains_any(text, sentiment["negatif"])
    return reviews.filter(F.col(PLACE).isNotNull()).select(
        PLACE, F.lower(F.coalesce("Teks_Mentah", F.lit(""))).alias("_text")
    ).select(
        PLACE,
        (positive & ~negative).alias("_pos"),
        (negative & ~positive).alias("_neg"),
        *[flag.alias(name) for name, flag in flags.items()],
    )


def place_counts(reviews: DataFrame, aspects: Aspects, sentiment: Lexicon, visitors: Lexicon) -> DataFrame:
    """One wide row of counts per place; a single shuffle of partial sums."""
    counts = []
    for i in range(len(aspects)):
        hit = F.col(f"_a{i}")
        counts += [
            _count(hit).alias(f"_mentions{i}"),
            _count(hit & F.col("_pos")).alias(f"_pos{i}"),
            _count(hit & F.col("_neg")).alias(f"_neg{i}"),
        ]
    counts += [_count(F.col(f"_b{i}")).alias(f"_badge{i}") for i in range(len(visitors))]
    flags = review_flags(reviews, aspects, sentiment, visitors)
    return flags.groupBy(PLACE).agg(F.count(F.lit(1)).alias("total_reviews"), *counts)


def _aspect_structs(aspects: Aspects) -> Column:
    rows = []
    for i, (key, (label, icon, _)) in enumerate(aspects.items()):
        pos, neg = F.col(f"_pos{i}"), F.col(f"_neg{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(key).alias("aspect"),
                F.lit(label).alias("label"),
                F.lit(icon).alias("icon"),
                pos.alias("pos"),
                neg.alias("neg"),
                F.col(f"_mentions{i}").alias("mentions"),
                aspect_score(pos, neg).alias("score"),
            )
        )
    return F.array(*rows)


def aspect_table(reviews: DataFrame, aspects: Aspects, sentiment: Lexicon) -> DataFrame:
    """(place, aspect, label, icon, pos, neg, mentions, score); every aspect of every place."""
    counts = place_counts(reviews, aspects, sentiment, {})
    return counts.select(PLACE, F.explode(_aspect_structs(aspects)).alias("_r")).select(PLACE, "_r.*")


def _badges(visitors: Lexicon) -> Column:
    enough = F.greatest(F.lit(2.0), F.col("total_reviews") * 0.1)
    earned = [F.when(F.col(f"_badge{i}") >= enough, F.lit(badge)) for i, badge in enumerate(visitors)]
    return F.array_compact(F.array(*earned)) if earned else F.array().cast("array<string>")


def badge_table(reviews: DataFrame, visitors: Lexicon) -> DataFrame:
    """(place, total_reviews, badges): badges with hits in a tenth of the reviews, and in two at least."""
    counts = place_counts(reviews, {}, {"positif": [], "negatif": []}, visitors)
    return counts.select(PLACE, "total_reviews", _badges(visitors).alias("badges"))


def _extreme(rows: Column, better) -> Column:
    """Label of the best row; the first one wins a tie."""
    start = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"))
    pick = lambda best, x: F.when(
        best["score"].isNull() | better(x["score"], best["score"]),
        F.struct(x["score"].alias("score"), F.lower(x["label"]).alias("label")),
    ).otherwise(best)
    return F.aggregate(rows, start, pick)["label"]


def insight(aspect_rows: Column) -> Column:
    """Struct (best, worst, insight) from a place's aspects with more than two mentions."""
    mentioned = F.filter(aspect_rows, lambda x: x["mentions"] > 2)
    best = _extreme(mentioned, lambda new, old: new > old)
    worst = _extreme(F.filter(mentioned, lambda x: x["score"] > 0), lambda new, old: new < old)
    fill = lambda sentence: F.replace(
        F.replace(F.lit(sentence), F.lit("{best}"), best), F.lit("{worst}"), F.coalesce(worst, F.lit(""))
    )
    text = (
        F.when(best.isNull(), F.lit(fixed.INSIGHT_NONE))
        .when(worst.isNotNull() & (best != worst), fill(fixed.INSIGHT_BOTH))
        .otherwise(fill(fixed.INSIGHT_BEST))
    )
    return F.struct(best.alias("best"), worst.alias("worst"), text.alias("insight"))


def scorecards(reviews: DataFrame, aspects: Aspects, sentiment: Lexicon, visitors: Lexicon) -> DataFrame:
    """One row per place: aspects (map of struct), badges, best, worst, insight, total_reviews."""
    counts = place_counts(reviews, aspects, sentiment, visitors)
    rows = counts.select(
        PLACE, "total_reviews", _badges(visitors).alias("badges"), _aspect_structs(aspects).alias("_rows")
    )
    by_key = F.map_from_entries(
        F.transform(F.col("_rows"), lambda r: F.struct(r["aspect"], r.dropFields("ord", "aspect")))
    )
    return rows.select(
        PLACE, by_key.alias("aspects"), "badges", insight(F.col("_rows")).alias("_i"), "total_reviews"
    ).select(PLACE, "aspects", "badges", "_i.*", "total_reviews")
