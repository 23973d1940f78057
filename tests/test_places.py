import json

import pytest
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.operators import aspects as A
from placelens.operators import places as P
from placelens.operators import reports
from placelens.operators import skew

REVIEWS = "Doc_ID long, Nama_Tempat string, Lokasi string, Rating double, Teks_Mentah string, Waktu date"


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (3, "Kali", "Sleman", 4.0, "Sejuk!!!"),
        (1, "Kali", None, None, "Bagus https://x.y sekali"),
        (2, "Kali", "Bantul", 2.0, "@budi"),
        (4, "Bukit", None, None, None),
        (5, None, "Sleman", 5.0, "hilang"),
        (6, "PANTAI", "Bantul", 5.0, "ombak"),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], REVIEWS)


@pytest.fixture(scope="module")
def inputs(spark):
    static = spark.createDataFrame(
        [(" Kali ", "p", "g", None), ("Pantai", None, None, "08.00"), ("Tanpa", None, "g", "x")],
        "Nama_Tempat string, Photo_URL string, Gmaps_Link string, Waktu_Buka string",
    )
    prices = spark.createDataFrame(
        [("Kali", "Tiket", 5000.0, "biaya wajib", 2), ("Kali\t", "Tenda, besar", None, "sewa pokok", 1), ("Pantai", "Kopi", 7.0, "layanan", 3), ("Lain", "x", 1.0, "layanan", 4)],
        "Nama_Tempat string, item string, harga double, kategori string, seq long",
    )
    facilities = spark.createDataFrame(
        [("Kali", " Toilet ", 9), ("Kali", None, 10), ("Kali", "Mushola", 8), ("Pantai", None, 11)],
        "Nama_Tempat string, Fasilitas string, seq long",
    )
    return static, prices, facilities


def by_name(df, key="Nama_Tempat"):
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


def test_stats(reviews):
    rows = by_name(P.place_stats(reviews))
    assert tuple(rows["Kali"]) == ("Kali", 3.0, 3, "Bantul")
    assert tuple(rows["Bukit"]) == ("Bukit", None, 1, None)
    assert None not in rows


def test_profiles(reviews):
    rows = by_name(P.place_profiles(reviews))
    assert rows["Kali"]["Profil_Teks"] == "bagus sekali sejuk!"
    assert rows["Bukit"]["Profil_Teks"] == ""


def test_large_profile_is_whole(spark, no_broadcast):
    df = spark.range(1000).select(
        F.col("id").alias("Doc_ID"),
        F.when(F.col("id") % 3 == 0, "kecil").otherwise("besar").alias("Nama_Tempat"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("Teks_Mentah"),
    )
    rows = P.place_profiles(df, docs_per_segment=64).orderBy("Segmen").collect()
    for place, ids in (("kecil", [i for i in range(1000) if i % 3 == 0]), ("besar", [i for i in range(1000) if i % 3])):
        parts = [r["Profil_Teks"] for r in rows if r["Nama_Tempat"] == place]
        assert " ".join(parts) == " ".join(f"t{i}" for i in ids)
        assert len(parts) == 16


@pytest.mark.parametrize("small", [True, False])
def test_info(inputs, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    rows = by_name(P.build_place_info(*inputs))
    assert set(rows) == {"Kali", "Pantai", "Tanpa"}
    assert json.loads(rows["Kali"]["Price_Items"]) == [
        {"item": "Tenda, besar", "harga": 0.0, "kategori": "sewa pokok"},
        {"item": "Tiket", "harga": 5000.0, "kategori": "biaya wajib"},
    ]
    assert rows["Kali"]["Facilities"] == "Mushola | Toilet"
    assert rows["Kali"]["Waktu_Buka"] == fixed.NO_HOURS
    assert tuple(rows["Tanpa"])[1:] == (0, "", "g", "x", "[]", "")
    assert (rows["Pantai"]["Facilities"], rows["Pantai"]["Photo_URL"]) == ("", "")


@pytest.mark.parametrize("small", [True, False])
def test_places(reviews, inputs, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    info = P.build_place_info(*inputs)
    df = P.prepare_places(reviews, info)
    assert df.columns == ["Nama_Tempat", "Segmen", *fixed.PLACE_COLUMNS[1:]]
    rows = by_name(df)
    assert set(rows) == {"Kali", "Bukit", "PANTAI"}
    kali = rows["Kali"]
    assert (kali["Harga_Minimum"], kali["Facilities_List"], kali["Photo_URL"]) == (5000.0, ["Mushola", "Toilet"], "p")
    assert kali["Profil_Teks"] == "bagus sekali sejuk!"
    assert all(rows["PANTAI"][c] is None for c in ("Price_Items", "Harga_Minimum", "Facilities", "Photo_URL"))
    by_lower = by_name(P.prepare_places(reviews, info, F.lower("Nama_Tempat")))
    assert by_lower["PANTAI"]["Harga_Minimum"] == 0.0
    assert by_lower["PANTAI"]["Facilities_List"] is None
    assert "Profil_Teks" not in P.place_metadata(df).columns


def test_places_with_bare_info(spark, reviews):
    info = spark.createDataFrame([("Kali", "[]")], "Nama_Tempat string, Price_Items string")
    rows = by_name(P.prepare_places(reviews, info))
    assert (rows["Kali"]["Price_Items"], rows["Kali"]["Harga_Minimum"], rows["Kali"]["Waktu_Buka"]) == ("[]", None, None)


def test_checks(reviews, inputs):
    places = P.prepare_places(reviews, P.build_place_info(*inputs))
    assert dict(P.check_places(places).collect()) == {
        "distinct_places": 0,
        "profile_not_empty": 1,
        "rating_in_range": 1,
        "at_least_one_review": 0,
    }


def test_a_large_place_is_one_place(spark):
    """Five reviews of over a million characters, one without a rating and one with NaN; two info rows of one name."""
    reviews = spark.range(5000, 5005).select(
        F.col("id").alias("Doc_ID"),
        F.lit("Besar").alias("Nama_Tempat"),
        F.lit("X").alias("Lokasi"),
        F.expr("CASE id WHEN 5000 THEN NULL WHEN 5001 THEN double('NaN') ELSE 4.0D END").alias("Rating"),
        F.repeat(F.lit("kata "), 240_000).alias("Teks_Mentah"),
    )
    item = '[{{"item":"a","harga":{0},"kategori":"biaya wajib"}}]'
    info = spark.createDataFrame(
        [("Besar", "p1", "g1", item.format("5.0")), ("Besar", "p2", "g2", item.format("7.0"))],
        "Nama_Tempat string, Photo_URL string, Gmaps_Link string, Price_Items string",
    )
    places = P.prepare_places(reviews, info)
    rows = places.select("Nama_Tempat", "Rating_Rata", "Photo_URL", "Gmaps_Link", "Harga_Minimum").distinct().collect()
    assert sorted(map(tuple, rows)) == [("Besar", 4.0, "p1", "g1", 5.0), ("Besar", 4.0, "p2", "g2", 7.0)]
    bad = dict(P.check_places(places).collect())
    assert (bad["profile_not_empty"], bad["rating_in_range"], bad["at_least_one_review"]) == (0, 0, 0)
    alone = P.prepare_places(reviews, info.filter("Photo_URL = 'p1'"))
    assert set(dict(P.check_places(alone).collect()).values()) == {0}


def test_weighted_rating(spark):
    df = spark.sql("SELECT 'a' AS Nama_Tempat, r AS Rating, d AS Waktu FROM VALUES (4.0D, DATE'2024-01-01'), (2.0D, DATE'2024-01-11'), (NULL, DATE'2024-01-11') t(r, d)")
    got = P.weighted_rating(df, F.lit("2024-01-11").cast("date"), 0.1).first()[1]
    assert got == pytest.approx((4 * 2.718281828 ** -1 + 2) / (2.718281828 ** -1 + 1))


ASPECTS = {"wc": ("Toilet", "w", ["toilet", "wc"]), "view": ("Pemandangan", "v", ["view"]), "jalan": ("Akses", "j", ["jalan"])}
SENTIMENT = {"positif": ["bagus", "bersih"], "negatif": ["kotor", "rusak"]}
VISITORS = {"Keluarga": ["anak"], "Solo": ["sendiri"]}


def cards(spark, texts):
    df = spark.createDataFrame([("p", t) for t in texts], "Nama_Tempat string, Teks_Mentah string")
    return A.scorecards(df, ASPECTS, SENTIMENT, VISITORS).first()


def test_scorecard_counts(spark):
    card = cards(spark, ["TOILET bersih", "wc kotor", "toilet bersih tapi kotor", None, "view"])
    wc = card["aspects"]["wc"]
    assert (wc["mentions"], wc["pos"], wc["neg"], wc["score"]) == (3, 1, 1, 3.0)
    assert (card["aspects"]["jalan"]["mentions"], card["aspects"]["view"]["score"]) == (0, 0.0)
    assert (card["total_reviews"], card["best"], card["worst"]) == (5, "toilet", "toilet")
    assert card["insight"] == fixed.INSIGHT_BEST.format(best="toilet")


@pytest.mark.parametrize(
    "texts, best, worst, sentence",
    [
        (["wc bagus"] * 2, None, None, fixed.INSIGHT_NONE),
        (["wc"] * 3, "toilet", None, fixed.INSIGHT_BEST),
        (["wc bagus"] * 3 + ["view rusak"] * 3, "toilet", "pemandangan", fixed.INSIGHT_BOTH),
        (["wc bagus jalan view"] * 3, "toilet", "toilet", fixed.INSIGHT_BEST),
    ],
)
def test_insight(spark, texts, best, worst, sentence):
    card = cards(spark, texts)
    assert (card["best"], card["worst"]) == (best, worst)
    assert card["insight"] == sentence.format(best=best, worst=worst)


def test_badges(spark):
    badges = lambda texts: cards(spark, texts)["badges"]
    assert badges(["anak"] * 2) == ["Keluarga"]
    assert badges(["anak"]) == []
    assert badges(["anak", "anak sendiri", "sendiri"] + ["x"] * 17) == ["Keluarga", "Solo"]
    assert badges(["anak"] * 2 + ["x"] * 19) == []


@pytest.mark.parametrize("small", [True, False])
def test_place_details(spark, small, request, monkeypatch):
    if not small:
        request.getfixturevalue("no_broadcast")
    places = spark.createDataFrame(
        [(1, "a", '[{"item":"t","harga":1.0,"kategori":"layanan"}]', "x, y"), (2, "b", '[{"item":"u","harga":2.0,"kategori":"layanan"}]', "x , y"), (3, "c", "[bad", ""), (4, "d", None, None)],
        "id long, nama string, harga_json string, fasilitas string",
    )
    prices = spark.createDataFrame([(1, "z", 5.0, "layanan", 1)], "tempat_id long, item string, harga double, kategori string, seq long")
    facilities = spark.createDataFrame([(3, "wc", 2), (3, "api", 1)], "tempat_id long, nama_fasilitas string, seq long")
    rows = by_name(reports.place_details(places, prices, facilities), "id")
    got = {i: ([h["item"] for h in r["harga"]], r["daftar_fasilitas"]) for i, r in rows.items()}
    assert got == {1: (["z"], ["x", "y"]), 2: (["u"], ["x", "y"]), 3: ([], ["api", "wc"]), 4: ([], [])}


def test_large_details_are_whole(spark, monkeypatch, no_broadcast):
    assemble = skew.assemble_lists
    monkeypatch.setattr(reports, "assemble_lists", lambda df, key, order, value, _: assemble(df, key, order, value, 8))
    places = spark.createDataFrame([(1, "a", None, "x,y")], "id long, nama string, harga_json string, fasilitas string")
    prices = spark.range(50).select(F.lit(1).cast("long").alias("tempat_id"), F.col("id").cast("string").alias("item"), F.lit(1.0).alias("harga"), F.lit("layanan").alias("kategori"), F.col("id").alias("seq"))
    facilities = spark.createDataFrame([], "tempat_id long, nama_fasilitas string, seq long")
    rows = reports.place_details(places, prices, facilities).orderBy("Segmen").collect()
    assert [h["item"] for r in rows for h in r["harga"]] == [str(i) for i in range(50)]
    assert [f for r in rows for f in r["daftar_fasilitas"]] == ["x", "y"]


def test_bookings(spark, no_broadcast):
    bookings = spark.createDataFrame([(i, i % 2, 7 if i < 8 else 9, None, 2, 5.0, "baru") for i in range(10)], "id long, user_id long, tempat_id long, tanggal_checkin date, jumlah_orang int, total_harga double, status string")
    places = spark.createDataFrame([(7, "Kali")], "id long, nama string")
    users = spark.createDataFrame([(0, "u0"), (1, "u1")], "id long, username string")
    mine = reports.bookings_of_users(bookings, places, 1).collect()
    assert [r["id"] for r in mine] == [7, 5, 3, 1]
    every = reports.all_bookings(bookings, users, places).collect()
    assert [(r["id"], r["username"], r["nama"]) for r in every] == [(i, f"u{i % 2}", "Kali") for i in range(7, -1, -1)]
    changes = spark.createDataFrame([(3, 1, "batal"), (3, 2, "lunas"), (99, 1, "x")], "id long, seq int, status string")
    changed = {r["id"]: r["status"] for r in reports.apply_status_changes(bookings, changes).collect()}
    assert changed == {i: "lunas" if i == 3 else "baru" for i in range(10)}


def test_history(spark):
    log = spark.range(5).selectExpr("id", *[f"cast(id as string) AS {c}" for c in reports.LOG_COLUMNS])
    assert [r["waktu"] for r in reports.search_history(log, 2).collect()] == ["4", "3"]
