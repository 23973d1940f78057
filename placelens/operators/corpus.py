"""Take in raw reviews and merge them into the review corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions.scraped import hours_label, likely_owner, rating_label, time_label
from placelens.functions.text import flatten_lines, trim_all
from placelens.operators.skew import dense_index, first_copies, with_places
from placelens.session import materialise

SIGNATURE = ["Rating", "Waktu", "Teks_Mentah"]


def split_owner_replies(reviews: DataFrame, text: str = "Teks_Mentah") -> tuple[DataFrame, DataFrame]:
    """Visitors' reviews, and the owners' answers for an audit."""
    owner = likely_owner(F.col(text))
    return reviews.filter(~owner), reviews.filter(owner)


def review_rows(raw: DataFrame) -> DataFrame:
    """Raw cards as review rows, without dedup.

    A card has `fragments` (array of texts), and the labels `rating_label` and
    `time_label`. Fragments by the owner are dropped, the rest is joined; cards
    without any text left are dropped.
    """
    visitor = F.filter(
        F.transform(F.col("fragments"), trim_all), lambda t: (t != "") & ~likely_owner(t)
    )
    joined = flatten_lines(F.array_join(visitor, " "))
    # Exploding the text if it is not empty computes it once; a filter would compute it again.
    kept = F.explode(F.filter(F.array(joined), lambda t: t != ""))
    others = [c for c in raw.columns if c not in ("fragments", "rating_label", "time_label")]
    return raw.select(
        *others,
        rating_label(F.col("rating_label")).alias("Rating"),
        time_label(F.col("time_label")).alias("Waktu"),
        kept.alias("Teks_Mentah"),
    )


def place_rows(raw: DataFrame) -> DataFrame:
    """Static info rows from scraped (name, photo, url, hours), with defaults where a field is missing."""
    return raw.select(
        F.coalesce("name", F.lit(fixed.NO_NAME)).alias("Nama_Tempat"),
        F.coalesce("photo", F.lit("")).alias("Photo_URL"),
        F.col("url").alias("Gmaps_Link"),
        hours_label(F.col("hours")).alias("Waktu_Buka"),
    )


def ingest_reviews(raw: DataFrame) -> DataFrame:
    """Distinct reviews by (rating, time, text); Tanggal_Scrap is the first day seen."""
    rows = review_rows(raw)
    first = [F.min("Tanggal_Scrap").alias("Tanggal_Scrap")] if "Tanggal_Scrap" in rows.columns else []
    if first:
        return rows.groupBy(*SIGNATURE).agg(*first)
    return rows.select(*SIGNATURE).distinct()


PLACES = ["_side", "_none", "_order", "_tie"]
COPY = ["Nama_Tempat", "Teks_Mentah"]


def combine(master: DataFrame | None, staging: DataFrame, order: str = "Doc_ID") -> DataFrame:
    """Both tables under one another, names trimmed, with the digest and the place of each row."""
    if master is None:
        master = staging.limit(0)
    sided = master.withColumn("_side", F.lit(0)).unionByName(
        staging.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return with_places(sided.withColumn("Nama_Tempat", trim_all(F.col("Nama_Tempat"))), COPY, order)


def merge_corpus(master: DataFrame | None, staging: DataFrame, order: str = "Doc_ID") -> tuple[DataFrame, DataFrame]:
    """The merged corpus numbered 1..n, and one row of counts.

    Rows with the same place and text count once, and the first one stays:
    master before staging, then by the column `order` (missing last), then by a
    digest of the row. So which copy stays depends on the copies alone. Tables
    whose ids say nothing take an order from readers.with_input_order. The counts
    are rows_before, rows_after, new_rows (their difference, below zero if the
    master held many copies) and inserted_rows (staging rows that stayed).

    The rows that stay are found and numbered by hashes and numbers alone; the
    texts move once, in the last join.
    """
    rows = combine(master, staging, order)
    kept = materialise(first_copies(rows, PLACES))
    numbered = dense_index(kept, ["_side", "_none", "_order"], "_number", ties=("_tie",))
    columns = [c for c in fixed.CORPUS_COLUMNS if c in rows.columns]
    which = ["_digest", "_side", "_tie"]
    # Rows that are alike in everything remain; the join has them side by side.
    found = rows.join(numbered.select(*which, "_number"), which).dropDuplicates(which)
    merged = found.drop("Doc_ID").withColumnRenamed("_number", "Doc_ID").select(*columns)
    before = F.lit(0 if master is None else master.count()).cast("bigint")
    counts = kept.agg(
        before.alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.count(F.lit(1)) - before).alias("new_rows"),
        F.count_if(F.col("_side") == 1).alias("inserted_rows"),
    )
    return merged, counts
