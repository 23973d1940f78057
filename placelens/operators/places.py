"""Build the place table from reviews, prices, facilities and static info.

A place of any size is held in rows of bounded size: long texts and lists come
in numbered segments (column Segmen), each a range of the order column, by the
same rule for every place. Single values per place are the same in all its
segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions.metadata import facility_list, minimum_price
from placelens.functions.text import clean_text, trim_all
from placelens.operators.skew import assemble_lists, row_digest, skew_safe_join, with_segments
from placelens.session import materialise

PLACE = "Nama_Tempat"
# What an info row holds once, however many segments its lists have.
ONCE = ["Photo_URL", "Gmaps_Link", "Waktu_Buka"]


def place_stats(reviews: DataFrame, rating: str = "Rating") -> DataFrame:
    """Mean rating (missing and NaN ratings left out), review count and first known location per place.

    The first step groups by place and location, so that only numbers are
    aggregated and the rows of a large place combine before the shuffle.
    """
    known = F.when(F.col("Lokasi").isNotNull(), F.col("Doc_ID"))
    rated = F.nanvl(F.col(rating).cast("double"), F.lit(None).cast("double"))
    per_location = (
        reviews.filter(F.col(PLACE).isNotNull())
        .groupBy(PLACE, "Lokasi")
        .agg(
            F.sum(rated).alias("_sum"),
            F.count(rated).alias("_rated"),
            F.count("Doc_ID").alias("_reviews"),
            F.min(known).alias("_first"),
        )
    )
    return per_location.groupBy(PLACE).agg(
        (F.sum("_sum") / F.sum("_rated")).alias("Rating_Rata"),
        F.sum("_reviews").alias("Jumlah_Review"),
        F.min_by("Lokasi", F.when(F.col("Lokasi").isNotNull(), F.coalesce("_first", F.lit(0)))).alias("Lokasi"),
    )


def place_profiles(reviews: DataFrame, docs_per_segment: int = 256) -> DataFrame:
    """All cleaned, non-empty reviews of a place joined by a space in Doc_ID order: (place, Segmen, Profil_Teks)."""
    rows = reviews.filter(F.col(PLACE).isNotNull()).select(PLACE, "Doc_ID", "Teks_Mentah")
    text = F.nullif(clean_text(F.col("Teks_Mentah")), F.lit(""))
    lists = assemble_lists(rows, PLACE, "Doc_ID", text, docs_per_segment)
    return lists.select(PLACE, "Segmen", F.array_join("values", " ").alias("Profil_Teks"))


def weighted_rating(reviews: DataFrame, reference: Column, decay: float, rating: str = "Rating") -> DataFrame:
    """Mean rating per place with weight exp(-decay * age in days)."""
    weight = F.exp(-decay * F.datediff(reference, F.col("Waktu")))
    rated = reviews.filter(F.col(rating).isNotNull() & F.col("Waktu").isNotNull()).withColumn("_w", weight)
    return rated.groupBy(PLACE).agg((F.sum(F.col(rating) * F.col("_w")) / F.sum("_w")).alias("Rating_Berbobot"))


def price_lists(prices: DataFrame, order: str = "seq", ids_per_segment: int = 4096) -> DataFrame:
    """JSON price list per place in input order; a missing price is 0."""
    item = F.struct("item", F.coalesce("harga", F.lit(0.0)).alias("harga"), "kategori")
    lists = assemble_lists(prices, PLACE, order, item, ids_per_segment)
    return lists.select(PLACE, "Segmen", F.to_json("values", {"ignoreNullFields": "false"}).alias("Price_Items"))


def facility_texts(facilities: DataFrame, order: str = "seq", ids_per_segment: int = 4096) -> DataFrame:
    """Facilities per place joined by ' | ' in input order; missing ones are left out."""
    lists = assemble_lists(facilities, PLACE, order, trim_all(F.col("Fasilitas")), ids_per_segment)
    return lists.select(PLACE, "Segmen", F.array_join("values", " | ").alias("Facilities"))


def build_place_info(static: DataFrame, prices: DataFrame, facilities: DataFrame, order: str = "seq") -> DataFrame:
    """Static info with price list and facility text: one row per place and segment, defaults filled in."""
    keyed = lambda df: df.withColumn(PLACE, trim_all(F.col(PLACE)))
    lists = price_lists(keyed(prices), order).join(
        facility_texts(keyed(facilities), order), [PLACE, "Segmen"], "full"
    )
    joined = with_segments(keyed(static), lists, PLACE)
    columns = [PLACE, "Segmen", "Photo_URL", "Gmaps_Link", "Waktu_Buka", "Price_Items", "Facilities"]
    return joined.select(*columns).fillna(
        {
            "Segmen": 0,
            "Price_Items": "[]",
            "Facilities": "",
            "Waktu_Buka": fixed.NO_HOURS,
            "Photo_URL": "",
            "Gmaps_Link": "",
        }
    )


def output_columns(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly these columns in this order; missing ones as null."""
    kinds = types or {}
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns]
    )


def prepare_places(reviews: DataFrame, info: DataFrame, key: Column | None = None) -> DataFrame:
    """The place table with Segmen added to its twelve columns.

    Places come from the reviews; info joins on the exact name, or on `key`
    (an expression over Nama_Tempat, such as lower case) where one is given. A
    place with several info rows is listed with each of them, whole.
    """
    match = (lambda: F.col(PLACE)) if key is None else (lambda: key)
    if "Segmen" not in info.columns:
        info = info.withColumn("Segmen", F.lit(0).cast("bigint"))
    info = output_columns(
        info, [PLACE, "Segmen", "Photo_URL", "Gmaps_Link", "Waktu_Buka", "Price_Items", "Facilities"]
    ).withColumn("_key", match()).drop(PLACE)
    # The segments of one info row share its photo, link and hours; rows of a repeated name stay apart.
    info = info.withColumn("_row", row_digest(ONCE))
    single = info.withColumn("_price", minimum_price(F.col("Price_Items"))).groupBy("_key", "_row", *ONCE).agg(
        F.sum("_price").alias("Harga_Minimum"),
    )
    ident = F.struct(PLACE, "_row").alias("_id")
    stats = materialise(place_stats(reviews).withColumn("_key", match()))
    places = stats.join(single, "_key", "left").withColumn("_row", F.coalesce("_row", F.lit(b"")))
    places = materialise(places.drop("_key").withColumn("_id", ident))
    listed = info.select("_key", "_row", "Segmen", "Price_Items", "Facilities")
    lists = skew_safe_join(listed, stats.select(PLACE, "_key"), "_key", F.col("Segmen")).select(
        ident, "Segmen", "Price_Items", "Facilities", facility_list(F.col("Facilities")).alias("Facilities_List")
    )
    profiles = skew_safe_join(place_profiles(reviews), places.select(PLACE, "_id"), PLACE, F.col("Segmen"))
    segments = profiles.drop(PLACE).join(lists, ["_id", "Segmen"], "full")
    columns = [PLACE, "Segmen", *fixed.PLACE_COLUMNS[1:]]
    return output_columns(skew_safe_join(segments, places.drop("_row"), "_id", F.col("Segmen")), columns)


def place_metadata(places: DataFrame) -> DataFrame:
    """The place table without its heavy text."""
    return places.drop("Profil_Teks")


def check_places(places: DataFrame) -> DataFrame:
    """Number of places that break each rule of the place table: (rule, bad_rows); segments of a place count once."""
    fine = F.coalesce(F.col("Rating_Rata").between(1.0, 5.0), F.lit(False))
    per_segment = places.groupBy(PLACE, "Segmen").agg(F.count(F.lit(1)).alias("rows"))
    per_place = places.groupBy(PLACE).agg(
        F.max(F.coalesce(F.length("Profil_Teks"), F.lit(0))).alias("chars"),
        F.min(fine).alias("rated"),
        F.min(F.coalesce("Jumlah_Review", F.lit(0))).alias("reviews"),
    )
    bad = lambda rule: F.coalesce(F.sum(F.when(rule, 1).otherwise(0)), F.lit(0)).cast("bigint")
    rules = {
        "profile_not_empty": bad(F.col("chars") == 0),
        "rating_in_range": bad(~F.col("rated")),
        "at_least_one_review": bad(F.col("reviews") < 1),
    }
    row = per_place.agg(*[value.alias(rule) for rule, value in rules.items()])
    repeated = per_segment.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("bigint").alias("bad_rows"))
    first = repeated.select(F.lit("distinct_places").alias("rule"), "bad_rows")
    return first.unionByName(row.unpivot([], list(rules), "rule", "bad_rows"))
