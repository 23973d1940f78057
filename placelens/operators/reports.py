"""Reports over search log, bookings and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.metadata import PRICE_ITEMS, price_items
from placelens.functions.text import trim_all
from placelens.operators.hybrid import search_summary
from placelens.operators.skew import assemble_lists, latest_value, skew_safe_join, with_segments

LOG_COLUMNS = ["waktu", "query_user", "intent", "region", "jumlah_hasil", "hasil_teratas"]


def search_history(log: DataFrame, limit: int = 50) -> DataFrame:
    """The latest rows of the search log."""
    return log.orderBy(F.desc("id")).limit(limit).select(*LOG_COLUMNS)


def search_log_rows(
    queries: DataFrame,
    results: DataFrame,
    name: str,
    intent: Column,
    region: Column,
    at: Column | None = None,
    seconds: Column | None = None,
) -> DataFrame:
    """One log row per query: time, query, cleaned query, intent, region, result count, best result, duration.

    `at` and `seconds` are columns of the queries; without them the row is timed
    now and has no duration. sinks.append_rows adds the rows to a stored log.
    """
    extra = queries.select(
        "query_id",
        intent.alias("intent"),
        region.alias("region"),
        (F.current_timestamp() if at is None else at).alias("waktu"),
        (F.lit(None) if seconds is None else seconds).cast("double").alias("durasi_detik"),
    )
    return search_summary(queries, results, name).join(extra, "query_id")


def bookings_of_users(bookings: DataFrame, places: DataFrame, user_id: int | None = None) -> DataFrame:
    """Bookings with the place's name, newest first; of one user, or of all users one after another."""
    asked = bookings if user_id is None else bookings.filter(F.col("user_id") == user_id)
    named = places.select(F.col("id").alias("tempat_id"), "nama")
    joined = skew_safe_join(asked, named, "tempat_id", F.col("id"))
    columns = ["user_id", "id", "nama", "tanggal_checkin", "total_harga", "status", "jumlah_orang"]
    return joined.select(*columns).orderBy("user_id", F.desc("id"))


def all_bookings(bookings: DataFrame, users: DataFrame, places: DataFrame) -> DataFrame:
    """Bookings with user and place names, newest first."""
    by_user = users.select(F.col("id").alias("user_id"), "username")
    by_place = places.select(F.col("id").alias("tempat_id"), "nama")
    joined = skew_safe_join(bookings, by_place, "tempat_id", F.col("id"))
    joined = skew_safe_join(joined, by_user, "user_id", F.col("id"))
    return joined.select("id", "username", "nama", "tanggal_checkin", "total_harga", "status").orderBy(
        F.desc("id")
    )


def apply_status_changes(bookings: DataFrame, changes: DataFrame) -> DataFrame:
    """Bookings with the latest status per id from (id, seq, status)."""
    latest = latest_value(changes, "id", "status", "seq").withColumnRenamed("status", "_status")
    joined = bookings.join(latest, "id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def place_details(places: DataFrame, prices: DataFrame, facilities: DataFrame, order: str = "seq") -> DataFrame:
    """Place rows with `harga` (array of struct) and `daftar_fasilitas` (array), per place and segment.

    The price and facility tables come first; a place without rows there falls
    back to its own JSON list and comma-separated text.
    """
    key = "tempat_id"
    items = F.struct("item", "harga", "kategori")
    listed = assemble_lists(prices, key, order, items, 4096).withColumnRenamed("values", "_prices")
    named = assemble_lists(facilities, key, order, F.col("nama_fasilitas"), 4096)
    both = listed.join(named.withColumnRenamed("values", "_named"), [key, "Segmen"], "full")
    held = both.groupBy(key).agg(
        F.min("Segmen").alias("_first"),
        F.max(F.col("_prices").isNotNull()).alias("_has_prices"),
        F.max(F.col("_named").isNotNull()).alias("_has_named"),
    )
    rename = lambda df: df.withColumnRenamed(key, "id")
    joined = with_segments(places.join(rename(held), "id", "left"), rename(both), "id")
    no_prices = F.array().cast(PRICE_ITEMS)
    no_names = F.array().cast("array<string>")
    own_prices = F.coalesce(price_items(F.col("harga_json")), no_prices)
    own_names = F.when(
        F.length("fasilitas") > 0, F.transform(F.split("fasilitas", ","), trim_all)
    ).otherwise(no_names)
    first = F.coalesce(F.col("Segmen") == F.col("_first"), F.lit(True))
    fall_back = lambda has: first & ~F.coalesce(has, F.lit(False))
    return joined.select(
        *places.columns,
        F.coalesce("Segmen", F.lit(0)).cast("bigint").alias("Segmen"),
        F.when(fall_back("_has_prices"), own_prices)
        .otherwise(F.coalesce("_prices", no_prices))
        .alias("harga"),
        F.when(fall_back("_has_named"), own_names)
        .otherwise(F.coalesce("_named", no_names))
        .alias("daftar_fasilitas"),
    )
