"""The given tables in the roles of the engine's inputs; whole tables, no row left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.operators.encode import pool_vectors
from placelens.operators.words import keyword_counts
from placelens.sources.readers import spread_rows

# Word lists over the invented languages of the given texts.
ASPECTS = {
    "akses": ("Akses", "road", ["rewh", "nicht", "avec"]),
    "fasilitas": ("Fasilitas", "tent", ["thatin", "keit", "eau"]),
    "kebersihan": ("Kebersihan", "broom", ["ononst", "lich", "para"]),
    "pemandangan": ("Pemandangan", "peak", ["inoran", "mente", "heit"]),
    "suasana": ("Suasana", "moon", ["hehely", "dans", "sich"]),
}
SENTIMENT = {
    "positif": ["thing", "elle ", "ungen", "ado "],
    "negatif": ["erreat", "queeau", "zube", "ciónes"],
}
VISITORS = {
    "Keluarga": ["pour", "thble", "und "],
    "Pasangan": ["orantion", "aution"],
    "Rombongan": ["worthless", "einheit", "spam"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_rows(table(spark, folder, "documents"), "doc_id")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return texts.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("Doc_ID"),
        F.col("source").alias("Nama_Tempat"),
        F.col("lang").alias("Lokasi"),
        (1.0 + 4 * F.col("quality")).alias("Rating"),
        F.col("text").alias("Teks_Mentah"),
    )


def staging(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents once more, with padded place names, and all conversation turns."""
    texts = documents(spark, folder)
    again = texts.join(table(spark, folder, "labels"), "doc_id").select(
        F.col("doc_id").alias("Doc_ID"),
        F.concat(F.lit("  "), "source", F.lit("\t")).alias("Nama_Tempat"),
        F.col("lang").alias("Lokasi"),
        (F.col("toxic") + 1.0).alias("Rating"),
        F.col("text").alias("Teks_Mentah"),
    )
    turns = table(spark, folder, "conversations").select(
        (1_000_000_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("Doc_ID"),
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("Nama_Tempat"),
        F.lit(None).cast("string").alias("Lokasi"),
        F.lit(None).cast("double").alias("Rating"),
        F.col("text").alias("Teks_Mentah"),
    )
    return again.unionByName(turns)


def static_info(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    return suppliers.select(
        F.concat(F.lit("src"), "s_suppkey", F.lit(" ")).alias("Nama_Tempat"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("https://img.example.com/"), "s_suppkey")).alias("Photo_URL"),
        F.concat(F.lit("https://maps.example.com/?cid="), "s_nationkey").alias("Gmaps_Link"),
        F.when(F.col("s_nationkey") > 9, F.lit("08.00-17.00")).alias("Waktu_Buka"),
    )


def part_prices(spark: SparkSession, folder: str) -> DataFrame:
    kinds = (
        F.when(F.col("p_type") == "STANDARD", "biaya wajib")
        .when(F.col("p_type") == "ECONOMY", "sewa pokok")
        .when(F.col("p_type") == "MEDIUM", "sewa mewah")
        .otherwise("layanan")
    )
    return table(spark, folder, "part").select(
        F.concat(F.lit(" src"), F.substring("p_brand", 7, 9)).alias("Nama_Tempat"),
        F.col("p_name").alias("item"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("harga"),
        kinds.alias("kategori"),
        F.col("p_partkey").alias("seq"),
        F.col("p_size").cast("bigint").alias("tempat_id"),
    )


def order_prices(spark: SparkSession, folder: str) -> DataFrame:
    kinds = (
        F.when(F.col("l_returnflag") == "A", "biaya wajib")
        .when(F.col("l_returnflag") == "R", "sewa pokok")
        .otherwise("layanan")
    )
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("order "), "l_orderkey").alias("Nama_Tempat"),
        F.concat(F.lit("item "), "l_linenumber").alias("item"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("harga"),
        kinds.alias("kategori"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def event_facilities(spark: SparkSession, folder: str) -> DataFrame:
    label = F.concat(F.lit(" "), "event_type", F.lit(" "), F.get_json_object("props", "$.k"), F.lit("  "))
    return table(spark, folder, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 30).cast("string")).alias("Nama_Tempat"),
        F.when(F.col("event_type") != "error", label).alias("Fasilitas"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 2).alias("tempat_id"),
    )


def search_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("nama"),
        F.col("lang").alias("lokasi"),
        F.col("text").alias("teks_mentah"),
    )


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def mixed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Passages and place names."""
    passages = text_queries(spark, folder).withColumn("query_id", F.concat(F.lit("b"), "query_id"))
    names = table(spark, folder, "documents").select("source").distinct()
    return passages.unionByName(
        names.select(F.concat(F.lit("n"), "source").alias("query_id"), F.col("source").alias("query"))
    )


def language_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(word, vector): the share of a word's documents in each language."""
    counts = keyword_counts(documents(spark, folder), "text", "lang", ("de", "en", "es", "fr"))
    shares = F.array(*[F.col(lang) / F.col("n") for lang in ("de", "en", "es", "fr")])
    return counts.select("word", shares.alias("vector"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean vector of the label, and a text with one of the price intents."""
    means = pool_vectors(table(spark, folder, "embeddings"), "label")
    kind = F.col("label") % 5
    text = (
        F.when(kind == 0, "Tempat MURAH dan lengkap")
        .when(kind == 1, "fasilitas Lengkap")
        .when(kind == 2, "camping gratis murah")
        .when(kind == 3, "camping sejuk")
        .otherwise("harga terjangkau")
    )
    place = F.when(kind == 0, "Semua Lokasi").when(kind == 1, "brand#1").when(kind == 2, "RAND#2").otherwise("#")
    return means.select(
        F.col("label").alias("query_id"), text.alias("query"), place.alias("lokasi_filter"), "embedding"
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"))


def place_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of the things the vectors stand for: parts, rated by their order lines."""
    sales = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("jumlah_review"), (1 + F.avg("l_quantity") / 12.5).alias("rating_rata")
    )
    part = table(spark, folder, "part")
    listed = F.to_json(F.array(F.struct(F.col("p_name").alias("item"), F.lit(5.0).alias("harga"), F.lit("layanan").alias("kategori"))))
    facilities = (
        F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" | "), "p_type", F.lit(" | "), "p_brand"))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit('["'), "p_name", F.lit('","'), "p_type", F.lit('"]')))
        .when(F.col("p_size") % 4 == 2, F.col("p_name"))
    )
    return part.join(sales, part["p_partkey"] == sales["l_partkey"], "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("nama_tempat"),
        F.col("p_brand").alias("lokasi"),
        "rating_rata",
        "jumlah_review",
        F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("https://img.example.com/"), "p_partkey")).alias("photo_url"),
        F.concat(F.lit("https://maps.example.com/?cid="), "p_partkey").alias("gmaps_link"),
        F.when(F.col("p_size") % 2 == 0, listed).otherwise(F.lit("[broken")).alias("price_items"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("harga_minimum"),
        facilities.alias("facilities"),
    )


def user_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as queries; some gain a price word or lose their text."""
    kind = F.col("conv_id") % 6
    text = (
        F.when(kind == 0, F.concat("text", F.lit(" yang MURAH")))
        .when(kind == 1, F.concat("text", F.lit(" fasilitas lengkap dan hemat")))
        .when(kind == 2, F.concat("text", F.lit(" komplit")))
        .when(kind == 3, F.concat(F.lit("Gratis murah "), "text"))
        .when(kind == 4, F.lit("   "))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "role", text.alias("query")
    )


def raw_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as scraped cards: one fragment per line."""
    return documents(spark, folder).select(
        F.split("text", "\n").alias("fragments"),
        F.when(F.col("lang") == "en", F.lit("5 bintang")).when(F.col("lang") == "de", F.lit(" 4/5 ")).otherwise(F.lit("baik")).alias("rating_label"),
        F.concat(F.length("source"), F.lit(" bulan lalu ")).alias("time_label"),
    )


def event_cards(events: DataFrame) -> DataFrame:
    """Events as scraped cards; works on a stream as well."""
    reply = F.when(F.col("event_type") == "view", F.lit("Terima kasih kak")).otherwise(F.lit("saya suka, terima kasih"))
    return events.select(
        F.array(F.concat("event_type", F.lit(" "), "props"), reply).alias("fragments"),
        F.concat((F.col("user_id") % 5 + 1).cast("string"), F.lit(" stars")).alias("rating_label"),
        F.concat((F.col("user_id") % 4 + 1).cast("string"), F.lit(" minggu lalu")).alias("time_label"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 25).alias("tempat_id"),
        F.col("o_orderdate").cast("date").alias("tanggal_checkin"),
        F.length("o_orderpriority").alias("jumlah_orang"),
        F.col("o_totalprice").alias("total_harga"),
        F.col("o_orderstatus").alias("status"),
    )


def booking_places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nama")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def status_changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("line "), "l_linestatus").alias("status")
    )


def detail_places(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("s_nationkey") % 3 == 0, F.lit("[broken")).when(
        F.col("s_nationkey") % 3 == 1, F.lit('[{"item":"Tiket","harga":15000.0,"kategori":"biaya wajib"}]')
    )
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("nama"),
        own.alias("harga_json"),
        F.when(F.col("s_nationkey") > 4, F.concat(F.lit("Toilet , Mushola,"), "s_name")).alias("fasilitas"),
    )


def search_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("waktu"),
        F.col("props").alias("query_user"),
        F.col("event_type").alias("intent"),
        F.concat(F.lit("region "), F.col("user_id") % 7).alias("region"),
        F.col("user_id").alias("jumlah_hasil"),
        F.lit("-").alias("hasil_teratas"),
    )
