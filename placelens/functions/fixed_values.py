"""They have to equal the reference's, or results differ."""

# Words that mark a text as an answer by the owner.
OWNER_WORDS = [
    "terimakasih", "terima kasih", "makasih", "trimakasih", "trims", "tq", "thanks", "thank you",
    "matur nuwun", "suwun", "hatur nuhun",
    "mohon maaf", "maaf", "sorry", "apologize",
    "respon dari pemilik", "response from the owner",
    "atas ulasannya", "atas masukannya", "atas kunjungan", "atas review", "atas bintang",
    "ditunggu kedatangannya", "maaf atas ketidaknyamanan", "sehat selalu", "sukses selalu",
    "kak", "sis", "gan", "bund", "bapak", "ibu", "om", "tante",
]

# Words that show that a visitor is speaking.
VISITOR_PRONOUNS = ["saya", "aku", "gue", "kami merasa", "kita", "keluarga saya"]

# Words of a time label.
TIME_WORDS = [
    "lalu", "ago", "week", "month", "year", "day", "jam", "menit", "detik", "bulan", "tahun", "hari",
]

# Price intents of a query, strongest first.
INTENT_WORDS = {
    "gratis": ["gratis", "free"],
    "murah": ["murah", "hemat", "budget", "ekonomis", "terjangkau"],
    "lengkap": ["lengkap", "full", "komplit"],
}

# Price categories that add up to the minimum price.
REQUIRED_CATEGORIES = ["biaya wajib", "sewa pokok"]

# Weights of similarity, rating, popularity and price match.
RANK_WEIGHTS = {"similarity": 0.50, "rating": 0.25, "popularity": 0.15, "price": 0.10}

# Weights of meaning, text hit and name hit.
HYBRID_WEIGHTS = {"semantic": 0.4, "text": 0.3, "name": 0.3}

# Columns of the tables.
CORPUS_COLUMNS = ["Doc_ID", "Nama_Tempat", "Lokasi", "Rating", "Teks_Mentah", "Waktu"]
PLACE_COLUMNS = [
    "Nama_Tempat", "Profil_Teks", "Rating_Rata", "Jumlah_Review", "Lokasi",
    "Photo_URL", "Gmaps_Link", "Waktu_Buka", "Price_Items", "Harga_Minimum",
    "Facilities", "Facilities_List",
]

# Texts shown where data is missing.
NO_HOURS = "Info tidak tersedia"
NO_NAME = "Nama Tidak Ditemukan"
CHECK_HOURS = "Cek Gmaps"
NO_PRICE = "Gratis / Hubungi Pengelola"
NO_FACILITIES = "Informasi fasilitas tidak tersedia"
NO_RESULT = "Tidak ditemukan"
NO_PHOTO = (
    "https://images.unsplash.com/photo-1504280390225-b8252277d3f8"
    "?ixlib=rb-4.0.3&auto=format&fit=crop&w=500&q=80"
)
ANY_LOCATION = "Semua Lokasi"

# Link errors.
IMAGE_LINK = "Link Salah! Jangan pakai link gambar."
NOT_A_LINK = "Sepertinya Anda memasukkan NAMA tempat, bukan URL."

# Insight sentences of a scorecard ({best}, {worst} are aspect labels).
INSIGHT_NONE = "Belum cukup data untuk menyimpulkan."
INSIGHT_BOTH = "Pengunjung sangat menyukai {best}, namun perlu memperhatikan {worst}."
INSIGHT_BEST = "Kekuatan utama tempat ini adalah {best} yang sangat memuaskan."
