"""Explicit schemas of the input tables."""

from __future__ import annotations

REVIEWS = "Doc_ID BIGINT, Nama_Tempat STRING, Lokasi STRING, Rating DOUBLE, Teks_Mentah STRING, Waktu STRING"
RAW_REVIEWS = "Rating STRING, Waktu STRING, Teks_Mentah STRING, Tanggal_Scrap DATE"
STATIC_INFO = "Nama_Tempat STRING, Photo_URL STRING, Gmaps_Link STRING, Waktu_Buka STRING"
PRICES = "Nama_Tempat STRING, item STRING, harga DOUBLE, kategori STRING"
FACILITIES = "Nama_Tempat STRING, Fasilitas STRING"
PLACE_INFO = f"{STATIC_INFO}, Price_Items STRING, Facilities STRING"
SEARCH_LOG = (
    "id BIGINT, waktu TIMESTAMP, query_user STRING, query_bersih STRING, intent STRING, region STRING, "
    "jumlah_hasil INT, hasil_teratas STRING, durasi_detik DOUBLE"
)
BOOKINGS = (
    "id BIGINT, user_id BIGINT, tempat_id BIGINT, tanggal_checkin DATE, jumlah_orang INT, "
    "total_harga DOUBLE, status STRING"
)
VECTORS = "id BIGINT, embedding ARRAY<FLOAT>"
