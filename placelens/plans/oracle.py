"""The registered queries once more, in SQL over the same tables."""

from __future__ import annotations

from placelens.functions import fixed_values as fixed
from placelens.plans import roles as R

WORD = r"\p{L}\p{N}_"
BLANK = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(column: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        column = f"regexp_replace({column}, {text(pattern)}, {text(new)}, 'g')"
    return column


def clean(column: str) -> str:
    marks = replaced(
        f"coalesce({column}, '')",
        (rf"https?://[^{BLANK}]+", ""),
        (rf"@[{WORD}]+", ""),
        (rf"#[{WORD}]+", ""),
        (rf"[^{WORD}{BLANK}.,!?'\"-]", " "),
        (r"!+", "!"),
        (r"\?+", "?"),
        (r"\.+", "."),
    )
    return f"trim({replaced(f'lower({marks})', (f'[{BLANK}]+', ' '))})"


def keywords(column: str) -> str:
    return replaced(f"lower({column})", (rf"[^a-z0-9{BLANK}]", ""))


def word_list(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {text(f'[{BLANK}]+')}), lambda w: w <> '')"


def token_list(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {text(f'[{WORD}]{{2,}}')})"


def strip(column: str) -> str:
    return replaced(column, (f"^[{BLANK}]+|[{BLANK}]+$", ""))


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in phrases) + ")"


REVIEWS = """reviews AS (
  SELECT d.doc_id AS "Doc_ID", d.source AS "Nama_Tempat", d.lang AS "Lokasi",
         1.0::DOUBLE + 4 * l.quality AS "Rating", d.text AS "Teks_Mentah"
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

STATS = f"""{REVIEWS}, stats AS (
  SELECT "Nama_Tempat", avg("Rating") AS "Rating_Rata", count("Doc_ID") AS "Jumlah_Review",
         arg_min("Lokasi", "Doc_ID") FILTER (WHERE "Lokasi" IS NOT NULL) AS "Lokasi"
  FROM reviews GROUP BY 1)"""


def profiles(segment: str) -> str:
    return f"""cleaned AS (SELECT "Nama_Tempat", "Doc_ID", {clean('"Teks_Mentah"')} AS t FROM reviews),
profiles AS (
  SELECT "Nama_Tempat", {segment} AS "Segmen",
         coalesce(string_agg(t, ' ' ORDER BY "Doc_ID") FILTER (WHERE t <> ''), '') AS "Profil_Teks"
  FROM cleaned GROUP BY 1, 2)"""


def price_lists(source: str) -> str:
    return f"""SELECT "Nama_Tempat", seq // 4096 AS "Segmen", to_json(list(struct_pack(item := item,
             harga := coalesce(harga, 0.0), kategori := kategori)
             ORDER BY seq, item, coalesce(harga, 0.0), kategori))::VARCHAR AS "Price_Items",
             sum(coalesce(harga, 0.0)) FILTER (WHERE kategori IN ('biaya wajib', 'sewa pokok')) AS total
      FROM {source} GROUP BY 1, 2"""


ORDER_PRICES = """order_prices AS (
  SELECT 'order ' || l_orderkey AS "Nama_Tempat", 'item ' || l_linenumber AS item,
         CASE WHEN l_tax > 0 THEN l_extendedprice END AS harga,
         CASE l_returnflag WHEN 'A' THEN 'biaya wajib' WHEN 'R' THEN 'sewa pokok' ELSE 'layanan' END AS kategori,
         l_partkey * 8 + l_linenumber AS seq
  FROM lineitem)"""

PART_PRICES = """part_prices AS (
  SELECT 'src' || substr(p_brand, 7) AS "Nama_Tempat", p_name AS item,
         CASE WHEN p_size > 5 THEN p_retailprice END AS harga,
         CASE p_type WHEN 'STANDARD' THEN 'biaya wajib' WHEN 'ECONOMY' THEN 'sewa pokok'
                     WHEN 'MEDIUM' THEN 'sewa mewah' ELSE 'layanan' END AS kategori,
         p_partkey AS seq, p_size::BIGINT AS tempat_id
  FROM part)"""

FACILITIES = """facilities AS (
  SELECT 'src' || (user_id % 30) AS "Nama_Tempat",
         CASE WHEN event_type <> 'error'
              THEN ' ' || event_type || ' ' || json_extract_string(props, '$.k') || '  ' END AS "Fasilitas",
         event_id AS seq, user_id * 2 AS tempat_id
  FROM events)"""

INFO = f"""{PART_PRICES}, {FACILITIES}, price_texts AS ({price_lists('part_prices')}),
facility_texts AS (
  SELECT "Nama_Tempat", seq // 4096 AS "Segmen", coalesce(string_agg(trim("Fasilitas"), ' | ' ORDER BY seq), '') AS "Facilities"
  FROM facilities GROUP BY 1, 2),
listed AS (SELECT * FROM price_texts FULL JOIN facility_texts USING ("Nama_Tempat", "Segmen")),
info AS (
  SELECT s."Nama_Tempat", coalesce("Segmen", 0) AS "Segmen", coalesce(photo, '') AS "Photo_URL",
         'https://maps.example.com/?cid=' || s.nation AS "Gmaps_Link",
         CASE WHEN s.nation > 9 THEN '08.00-17.00' ELSE 'Info tidak tersedia' END AS "Waktu_Buka",
         coalesce("Price_Items", '[]') AS "Price_Items", coalesce("Facilities", '') AS "Facilities",
         CASE WHEN "Price_Items" IS NOT NULL THEN coalesce(total, 0.0) END AS total
  FROM (SELECT 'src' || s_suppkey AS "Nama_Tempat", s_nationkey AS nation,
               CASE WHEN s_acctbal > 0 THEN 'https://img.example.com/' || s_suppkey END AS photo FROM supplier) s
  LEFT JOIN listed USING ("Nama_Tempat"))"""

PLACES = f"""{STATS}, {profiles('"Doc_ID" // 256')}, {INFO}, once AS (
  SELECT "Nama_Tempat", any_value("Photo_URL") AS "Photo_URL", any_value("Gmaps_Link") AS "Gmaps_Link",
         any_value("Waktu_Buka") AS "Waktu_Buka", round(sum(total), 2) AS "Harga_Minimum" FROM info GROUP BY 1),
segments AS (SELECT "Nama_Tempat", "Segmen", "Profil_Teks", "Price_Items", "Facilities"
  FROM profiles FULL JOIN info USING ("Nama_Tempat", "Segmen")),
places AS (
  SELECT s."Nama_Tempat", "Segmen", "Profil_Teks", s."Rating_Rata", s."Jumlah_Review", s."Lokasi",
         i."Photo_URL", i."Gmaps_Link", i."Waktu_Buka", "Price_Items", i."Harga_Minimum", "Facilities",
         CASE WHEN "Facilities" <> '' THEN to_json(list_transform(string_split("Facilities", '|'),
              lambda x: trim(x)))::VARCHAR END AS "Facilities_List"
  FROM stats s JOIN segments USING ("Nama_Tempat") LEFT JOIN once i USING ("Nama_Tempat"))"""

MERGED = f"""{REVIEWS}, combined AS (
  SELECT 0 AS src, "Doc_ID" AS id, "Nama_Tempat", "Lokasi", "Rating", "Teks_Mentah" FROM reviews
  UNION ALL
  SELECT 1, doc_id, source, lang, toxic + 1.0::DOUBLE, text FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 1, 1000000000000 + conv_id * 1000 + turn, 'src' || (conv_id % 25), NULL, NULL, text FROM conversations),
kept AS (
  SELECT * FROM combined
  QUALIFY row_number() OVER (PARTITION BY "Nama_Tempat", "Teks_Mentah" ORDER BY src, id) = 1)"""


def flags() -> str:
    columns = [
        f"({any_of('t', R.SENTIMENT['positif'])} AND NOT {any_of('t', R.SENTIMENT['negatif'])}) AS pos",
        f"({any_of('t', R.SENTIMENT['negatif'])} AND NOT {any_of('t', R.SENTIMENT['positif'])}) AS neg",
    ]
    columns += [f"{any_of('t', words)} AS a_{key}" for key, (_, _, words) in R.ASPECTS.items()]
    columns += [f"{any_of('t', words)} AS b_{key}" for key, words in R.VISITORS.items()]
    return f"""{REVIEWS}, flags AS (
  SELECT "Nama_Tempat", {', '.join(columns)}
  FROM (SELECT "Nama_Tempat", lower(coalesce("Teks_Mentah", '')) AS t FROM reviews))"""


def aspect_rows() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT "Nama_Tempat", {i} AS ord, {text(key)} AS aspect, {text(label)} AS label, {text(icon)} AS icon,
            count(*) FILTER (WHERE a_{key} AND pos) AS pos, count(*) FILTER (WHERE a_{key} AND neg) AS neg,
            count(*) FILTER (WHERE a_{key}) AS mentions FROM flags GROUP BY 1"""
        for i, (key, (label, icon, _)) in enumerate(R.ASPECTS.items())
    )
    return f"""{flags()}, aspects AS (
  SELECT *, CASE WHEN pos + neg = 0 THEN 0.0::DOUBLE ELSE round(1 + 4.0::DOUBLE * pos / (pos + neg), 1) END AS score
  FROM ({rows}))"""


def badges() -> str:
    columns = ", ".join(f"count(*) FILTER (WHERE b_{key}) AS b_{key}" for key in R.VISITORS)
    earned = ", ".join(
        f"CASE WHEN b_{key} >= greatest(2.0::DOUBLE, n * 0.1::DOUBLE) THEN {text(key)} END" for key in R.VISITORS
    )
    return f"""badges AS (
  SELECT "Nama_Tempat", n AS total_reviews, list_filter([{earned}], lambda b: b IS NOT NULL) AS badges
  FROM (SELECT "Nama_Tempat", count(*) AS n, {columns} FROM flags GROUP BY 1))"""


ASPECT_SCORES = ", ".join(
    f"""(SELECT score FROM aspects a WHERE a."Nama_Tempat" = b."Nama_Tempat" AND aspect = '{a}') AS {a}_score"""
    for a in R.ASPECTS
)
SCORECARDS = f"""WITH {aspect_rows()}, {badges()}, extremes AS (
  SELECT "Nama_Tempat",
         first(lower(label) ORDER BY score DESC, ord) AS best,
         first(lower(label) ORDER BY score, ord) FILTER (WHERE score > 0) AS worst
  FROM aspects WHERE mentions > 2 GROUP BY 1)
SELECT b."Nama_Tempat", b.total_reviews, len(b.badges)::INTEGER AS n_badges,
       {ASPECT_SCORES},
       best, worst,
       CASE WHEN best IS NULL THEN {text(fixed.INSIGHT_NONE)}
            WHEN worst IS NOT NULL AND best <> worst
            THEN replace(replace({text(fixed.INSIGHT_BOTH)}, '{{best}}', best), '{{worst}}', worst)
            ELSE replace({text(fixed.INSIGHT_BEST)}, '{{best}}', best) END AS insight
FROM badges b LEFT JOIN extremes USING ("Nama_Tempat")"""

TFIDF = f"""WITH docs AS (SELECT doc_id AS id, source AS nama, lang AS lokasi, text FROM documents
              WHERE text IS NOT NULL AND text <> ''),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({token_list('text')}) AS term FROM docs) GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
length AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
qtf AS (SELECT query_id, term, count(*) AS tf FROM
  (SELECT item_id AS query_id, unnest({token_list('text')}) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qlength AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
found AS (
  SELECT query_id, id, sum((qw.w / ql.n) * (w.w / l.n)) AS score
  FROM qw JOIN qlength ql USING (query_id) JOIN w USING (term) JOIN length l USING (id)
  GROUP BY 1, 2 HAVING sum((qw.w / ql.n) * (w.w / l.n)) >= 0.01),
"""


def ranked_places(cut: int, k: int, decimals: int) -> str:
    return f"""cut AS (
  SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {cut}),
best AS (
  SELECT c.query_id, c.id, c.score, d.source AS nama, d.lang AS lokasi, d.text AS teks_mentah
  FROM cut c JOIN documents d ON d.doc_id = c.id
  QUALIFY row_number() OVER (PARTITION BY c.query_id, d.source ORDER BY round(c.score, 9) DESC, c.id) = 1),
results AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, nama, lokasi,
         teks_mentah, round(score * 100, {decimals}) AS skor_relevansi FROM best
  QUALIFY rank <= {k})"""


MIXED = f"""asked AS (
  SELECT query_id, query, {keywords('query')} AS clean FROM (
    SELECT 'b' || item_id AS query_id, text AS query FROM benchmark
    UNION ALL SELECT DISTINCT 'n' || source, source FROM documents)),
known AS (SELECT doc_id AS id, source, lang, {keywords('text')} AS clean FROM documents WHERE text IS NOT NULL AND text <> '')"""

PHRASES = f"""WITH {MIXED}, scored AS (
  SELECT query_id, id, 0.3::DOUBLE * contains(k.clean, a.clean)::INT
         + 0.3::DOUBLE * contains(lower(k.source), a.clean)::INT AS raw
  FROM asked a, known k),
found AS (SELECT query_id, id, raw AS score FROM scored WHERE raw > 0.01),
{ranked_places(40, 20, 1)}"""

LANGS = ("de", "en", "es", "fr")
HYBRID = f"""WITH {MIXED},
vocabulary AS (
  SELECT word, {', '.join(f"count(*) FILTER (WHERE lang = '{x}') / count(*)::DOUBLE AS {x}" for x in LANGS)}
  FROM (SELECT lang, unnest(list_distinct({word_list('clean')})) AS word FROM known) GROUP BY 1),
kv AS (SELECT id, {', '.join(f'avg({x}) AS {x}' for x in LANGS)}
       FROM (SELECT id, unnest({word_list('clean')}) AS word FROM known) JOIN vocabulary USING (word) GROUP BY 1),
av AS (SELECT query_id, {', '.join(f'avg({x}) AS {x}' for x in LANGS)}
       FROM (SELECT query_id, unnest({word_list('clean')}) AS word FROM asked) JOIN vocabulary USING (word) GROUP BY 1),
scored AS (
  SELECT a.query_id, k.id, 0.3::DOUBLE * contains(k.clean, a.clean)::INT
         + 0.3::DOUBLE * contains(lower(k.source), a.clean)::INT
         + 0.4::DOUBLE * coalesce(({' + '.join(f'kv.{x} * av.{x}' for x in LANGS)})
           / (sqrt({' + '.join(f'kv.{x} * kv.{x}' for x in LANGS)})
              * sqrt({' + '.join(f'av.{x} * av.{x}' for x in LANGS)})), 0.0) AS raw
  FROM asked a CROSS JOIN known k LEFT JOIN kv ON kv.id = k.id LEFT JOIN av ON av.query_id = a.query_id),
found AS (SELECT query_id, id, raw AS score FROM scored WHERE raw > 0.01),
{ranked_places(40, 20, 1)}"""

SUMMARY = f"""{PHRASES}
SELECT a.query_id, any_value(a.query) AS query_user, any_value(a.clean) AS query_bersih,
       count(r.id) AS jumlah_hasil, coalesce(arg_min(r.nama, r.rank), 'Tidak ditemukan') AS hasil_teratas"""

LABEL_QUERIES = """means AS (
  SELECT label, list(m ORDER BY dim) AS mean FROM (
    SELECT label, dim, avg(x) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
    GROUP BY 1, 2) GROUP BY 1),
asked AS (
  SELECT label AS query_id, mean,
         CASE label % 5 WHEN 0 THEN 'murah' WHEN 1 THEN 'lengkap' WHEN 2 THEN 'gratis' WHEN 3 THEN 'none'
                        ELSE 'murah' END AS intent,
         CASE label % 5 WHEN 0 THEN 'Semua Lokasi' WHEN 1 THEN 'brand#1' WHEN 2 THEN 'RAND#2' ELSE '#' END AS lokasi_filter
  FROM means)"""


def nearest(k: int, vectors: str = "embeddings") -> str:
    return f"""{LABEL_QUERIES}, nearest AS (
  SELECT query_id, id, similarity_score, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity_score, 9) DESC, id) AS posisi
  FROM (SELECT query_id, vec_id AS id, list_cosine_similarity(mean, embedding::DOUBLE[]) AS similarity_score
        FROM asked, {vectors}) QUALIFY posisi <= {k})"""


META = """meta AS (
  SELECT p_partkey AS id, p_name AS nama_tempat, p_brand AS lokasi, coalesce(rating, 0.0) AS rating_rata,
         coalesce(n, 0) AS jumlah_review,
         CASE WHEN p_size % 3 > 0 THEN 'https://img.example.com/' || p_partkey END AS photo_url,
         'https://maps.example.com/?cid=' || p_partkey AS gmaps_link,
         CASE WHEN p_size % 2 = 0 THEN '[{"item":"' || p_name || '","harga":5.0,"kategori":"layanan"}]'
              ELSE '[broken' END AS price_items,
         CASE WHEN p_size > 5 THEN p_retailprice END AS harga_minimum,
         CASE p_size % 4 WHEN 0 THEN p_name || ' | ' || p_type || ' | ' || p_brand
                         WHEN 1 THEN '["' || p_name || '","' || p_type || '"]'
                         WHEN 2 THEN p_name END AS facilities,
         p_size, p_type
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, 1 + avg(l_quantity) / 12.5 AS rating
                       FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


FACILITY_ITEMS = "CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END"


def recommended(fetch: int, k: int, vectors: str = "embeddings", items: str = FACILITY_ITEMS) -> str:
    return f"""{nearest(fetch, vectors)}, {META}, signals AS (
  SELECT n.*, m.* EXCLUDE (id), intent, lokasi_filter,
         ({items})::DOUBLE AS items
  FROM nearest n JOIN meta m USING (id) JOIN asked USING (query_id)),
bounds AS (
  SELECT query_id, min(harga_minimum) AS p0, max(harga_minimum) AS p1, min(jumlah_review) AS r0,
         max(jumlah_review) AS r1, min(items) AS i0, max(items) AS i1 FROM signals GROUP BY 1),
prices AS (
  SELECT s.*, CASE WHEN r1 = r0 THEN CASE WHEN r1 > 0 THEN 1.0 ELSE 0.0 END
                   ELSE (jumlah_review - r0) / (r1 - r0)::DOUBLE END AS popularity,
         CASE intent WHEN 'gratis' THEN CASE WHEN coalesce(harga_minimum, 0) = 0 THEN 1.0 ELSE 0.0 END
                     WHEN 'murah' THEN CASE WHEN harga_minimum IS NULL THEN 0.5 WHEN p1 = p0 THEN 1.0
                                            ELSE 1.0 - (harga_minimum - p0) / (p1 - p0) END
                     WHEN 'lengkap' THEN CASE WHEN i1 = i0 THEN 1.0 ELSE (items - i0) / (i1 - i0) END
                     ELSE 1.0 END::DOUBLE AS price_score
  FROM signals s JOIN bounds USING (query_id)),
scored AS (
  SELECT *, round(0.5::DOUBLE * greatest(0.0, least(1.0, similarity_score))
                  + 0.25::DOUBLE * CASE WHEN rating_rata = 0 THEN 0.5 ELSE (rating_rata - 1) / 4 END
                  + 0.15::DOUBLE * popularity + 0.1::DOUBLE * price_score, 4) AS final_score FROM prices),
results AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, posisi) AS rank
  FROM scored QUALIFY rank <= {k})"""


FACILITY_OUTPUT = """CASE p_size % 4 WHEN 0 THEN [nama_tempat, p_type, lokasi] WHEN 1 THEN [nama_tempat, p_type]
                          WHEN 2 THEN [nama_tempat] ELSE []::VARCHAR[] END"""


def metrics(ranked: str) -> str:
    return f"""truth AS (SELECT label AS query_id, vec_id AS id FROM embeddings),
size AS (SELECT query_id, count(*) AS n_relevant FROM truth GROUP BY 1),
hits AS (SELECT query_id, id, rank FROM {ranked} JOIN truth USING (query_id, id)),
metrics AS (
  SELECT a.query_id, any_value(n_relevant) AS n_relevant,
         count(h.id) FILTER (WHERE rank <= 5) / any_value(n_relevant)::DOUBLE AS recall_at_5,
         count(h.id) FILTER (WHERE rank <= 10) / any_value(n_relevant)::DOUBLE AS recall_at_10,
         coalesce(1.0::DOUBLE / min(rank), 0) AS mrr,
         coalesce(sum(1.0::DOUBLE / log2(rank + 1)), 0) / list_sum(list_transform(
           range(1, least(any_value(n_relevant), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg_at_10
  FROM asked a JOIN size USING (query_id) LEFT JOIN hits h USING (query_id) GROUP BY 1)"""


SHOWN_METRICS = """SELECT query_id, n_relevant, round(recall_at_5, 6) AS recall_at_5,
  round(recall_at_10, 6) AS recall_at_10, round(mrr, 6) AS mrr, round(ndcg_at_10, 6) AS ndcg_at_10 FROM metrics"""


TITLE = """array_to_string(list_transform(regexp_extract_all({name}, '\\p{{L}}+|[^\\p{{L}}]+'),
  lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"""

STUB = "(length({c}) < 5 AND NOT regexp_matches(lower({c}), '[aeiou]'))"


def owner(column: str) -> str:
    lowered = f"lower({column})"
    return (
        f"({STUB.format(c=column)} OR ({any_of(lowered, fixed.OWNER_WORDS)} "
        f"AND NOT {any_of(lowered, fixed.VISITOR_PRONOUNS)}))"
    )


def buckets(column: str, dim: int, key: str, source: str) -> str:
    """Signed token counts per bucket."""
    return f"""SELECT {key}, ('0x' || left(md5(token), 8))::UBIGINT % {dim} AS bucket,
       sum(CASE WHEN substr(md5(token), 9, 1) < '8' THEN 1 ELSE -1 END) AS x
  FROM (SELECT {key}, unnest({token_list(column)}) AS token FROM {source}) GROUP BY ALL"""


BOOKED = """bookings AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 25 AS tempat_id,
         o_orderdate::DATE::VARCHAR AS tanggal_checkin, length(o_orderpriority)::INTEGER AS jumlah_orang,
         o_totalprice AS total_harga, o_orderstatus AS status FROM orders)"""

ORACLE: dict[str, str] = {
    "q01_clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "q02_place_stats": f"WITH {STATS} SELECT * FROM stats",
    "q02b_place_profiles": f"""WITH {REVIEWS}, {profiles('"Doc_ID" // 256')} SELECT * FROM profiles""",
    "q02c_profile_segments": f"""WITH {REVIEWS}, {profiles('"Doc_ID" // 64')} SELECT * FROM profiles""",
    "q03_prepare_places": f"WITH {PLACES} SELECT * FROM places",
    "q03b_place_metadata": f'WITH {PLACES} SELECT * EXCLUDE ("Profil_Teks") FROM places',
    "q04_minimum_price": f"""WITH {ORDER_PRICES}, lists AS ({price_lists('order_prices')})
SELECT "Nama_Tempat", round(sum(coalesce(total, 0.0)), 2) AS "Harga_Minimum" FROM lists GROUP BY 1""",
    "q05_facility_list": """SELECT p_partkey, CASE WHEN p_size % 5 IN (1, 2, 3)
  THEN replace(p_name, ' ', ';') || ';' || p_type END AS facilities FROM part""",
    "q06_price_lists": f"""WITH {ORDER_PRICES}, lists AS ({price_lists('order_prices')})
SELECT "Nama_Tempat", "Segmen", "Price_Items" FROM lists""",
    "q07_place_info": f"WITH {INFO} SELECT * EXCLUDE (total) FROM info",
    "q08_merge_corpus": f"""WITH {MERGED} SELECT row_number() OVER (ORDER BY src, id) AS "Doc_ID",
  "Nama_Tempat", "Lokasi", "Rating", "Teks_Mentah" FROM kept""",
    "q08b_merge_counts": f"""WITH {MERGED} SELECT (SELECT count(*) FROM reviews) AS rows_before,
  count(*) AS rows_after, count(*) - (SELECT count(*) FROM reviews) AS new_rows,
  count(*) FILTER (WHERE src = 1) AS inserted_rows FROM kept""",
    "q09_dense_index": "SELECT event_type, event_id, row_number() OVER (ORDER BY event_type, event_id) AS n FROM events",
    "q09b_dense_index_missing": """SELECT kind, event_id, row_number() OVER (ORDER BY kind NULLS FIRST, event_id) AS n
FROM (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind, event_id FROM events)""",
    "q10_aspect_table": f"WITH {aspect_rows()} SELECT * FROM aspects",
    "q11_badges": f"""WITH {flags()}, {badges()}
SELECT "Nama_Tempat", total_reviews, array_to_string(badges, ',') AS badges FROM badges""",
    "q12_scorecards": SCORECARDS,
    "q13_tfidf_search": f"{TFIDF} {ranked_places(25, 5, 2)} SELECT * FROM results",
    "q13b_search_table": """SELECT l_partkey AS tempat_id, l_returnflag || ' ' || l_linestatus || ' ' || l_orderkey || ' '
  || l_linenumber AS teks_mentah, p_name AS nama, p_brand AS lokasi
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 5""",
    "q14_hybrid_search": f"{HYBRID} SELECT * FROM results",
    "q14b_phrase_search": f"{PHRASES} SELECT * FROM results",
    "q14d_search_summary": f"{SUMMARY} FROM asked a LEFT JOIN results r USING (query_id) GROUP BY 1",
    "q15_vector_topk": f"""WITH {nearest(20)}
SELECT query_id, id, round(similarity_score, 6) AS similarity_score, posisi FROM nearest""",
    "q15b_encoded_places": f"""WITH d AS ({buckets(clean('text'), 384, 'source', 'documents')}),
q AS ({buckets('text', 384, 'item_id', 'benchmark')}),
dn AS (SELECT source, sqrt(sum(x::DOUBLE * x)) AS n FROM d GROUP BY 1),
qn AS (SELECT item_id, sqrt(sum(x::DOUBLE * x)) AS n FROM q GROUP BY 1),
s AS (SELECT item_id AS query_id, source AS nama, sum(d.x::DOUBLE * q.x / dn.n / qn.n) AS score
      FROM q JOIN d USING (bucket) JOIN dn USING (source) JOIN qn USING (item_id) GROUP BY 1, 2),
ranked AS (SELECT query_id, nama, round(score, 6) AS similarity_score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, nama) AS posisi FROM s)
SELECT * FROM ranked WHERE posisi <= 10""",
    "q15c_encode": f"""WITH b AS ({buckets('text', 16, 'conv_id, turn', 'conversations')}),
grid AS (SELECT conv_id, turn, bucket FROM conversations, range(16) r(bucket))
SELECT conv_id, turn, string_agg(coalesce(x, 0)::INTEGER::VARCHAR, ' ' ORDER BY bucket) AS v
FROM grid LEFT JOIN b USING (conv_id, turn, bucket) GROUP BY 1, 2""",
    "q16_unit_vectors": """WITH long AS (
  SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
lengths AS (SELECT id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1)
SELECT id, round(n, 6) AS length, dim::INTEGER AS dim,
       round((CASE WHEN n > 0 THEN x / n ELSE 0 END)::FLOAT::DOUBLE, 5) AS x FROM long JOIN lengths USING (id)""",
    "q16b_label_cosine": f"""WITH {LABEL_QUERIES} SELECT vec_id AS id,
  round(list_cosine_similarity(mean, embedding::DOUBLE[]), 6) AS similarity FROM embeddings JOIN means USING (label)""",
    "q17_candidates": f"""WITH {nearest(20)}, {META}
SELECT id, query_id, round(similarity_score, 6) AS similarity_score, posisi, nama_tempat, lokasi,
       round(rating_rata, 6) AS rating_rata, jumlah_review, photo_url, gmaps_link, price_items, harga_minimum, facilities
FROM nearest JOIN meta USING (id)""",
    "q18_intent": f"""WITH turns AS (SELECT conv_id * 1000 + turn AS query_id,
  CASE conv_id % 6 WHEN 0 THEN text || ' yang MURAH' WHEN 1 THEN text || ' fasilitas lengkap dan hemat'
    WHEN 2 THEN text || ' komplit' WHEN 3 THEN 'Gratis murah ' || text WHEN 4 THEN '   ' ELSE text END AS query
  FROM conversations)
SELECT query_id, CASE {' '.join(f"WHEN {any_of('lower(query)', words)} THEN {text(name)}"
                                for name, words in fixed.INTENT_WORDS.items())} ELSE 'none' END AS intent
FROM turns WHERE length(trim(query)) > 0""",
    "q18b_refused": """SELECT conv_id * 1000 + turn AS query_id, role FROM conversations
WHERE conv_id % 6 = 4 OR (conv_id % 6 = 5 AND length(trim(text)) = 0)""",
    "q19_recommend": f"""WITH {recommended(30, 10)} SELECT query_id, rank, id, nama_tempat, intent,
  round(similarity_score, 6) AS similarity_score, round(price_score, 6) AS price_score, final_score FROM results""",
    "q19c_complete_by_prices": f"""WITH {recommended(30, 10, items="CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END")}
SELECT query_id, rank, id, round(price_score, 6) AS price_score, final_score FROM results""",
    "q19b_formatted": f"""WITH {recommended(30, 10)} SELECT query_id, rank, id,
  array_to_string({FACILITY_OUTPUT}, ';') AS facilities,
  CASE WHEN p_size % 2 = 0 THEN nama_tempat END AS items,
  CASE WHEN p_size % 2 = 1 THEN price_items END AS price_items_text FROM results""",
    "q20_find_places": """WITH asked AS (SELECT upper(p_name) AS asked FROM part
  UNION SELECT upper(c_mktsegment) FROM customer),
first AS (SELECT lower(p_name) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1)
SELECT a.asked, f.p_partkey, p.p_name, p.p_brand, f.p_partkey IS NOT NULL AS found
FROM asked a LEFT JOIN first f ON f.name = lower(a.asked) LEFT JOIN part p ON p.p_partkey = f.p_partkey""",
    "q20b_find_places_like": """WITH asked AS (SELECT DISTINCT 'ER#%' || p_size || '_' AS lookup FROM part
  UNION SELECT DISTINCT 'CUSTOMER#0000000' || p_size FROM part)
SELECT lookup, min(c_custkey) AS c_custkey FROM asked JOIN customer ON c_name ILIKE '%' || lookup || '%' GROUP BY 1""",
    "q20c_find_substrings": """WITH ends AS (SELECT c_custkey * 4 AS lookup, right(c_name, 5) AS five, right(c_name, 4) AS four FROM customer),
asked AS (SELECT lookup, five AS asked FROM ends UNION ALL SELECT lookup + 1, 'R#%' || five FROM ends
  UNION ALL SELECT lookup + 2, 'x' || five FROM ends UNION ALL SELECT lookup + 3, '_' || four FROM ends),
found AS (SELECT asked, min(c_custkey) AS c_custkey FROM (SELECT DISTINCT asked FROM asked)
  JOIN customer ON c_name ILIKE '%' || asked || '%' GROUP BY 1)
SELECT lookup, c_custkey FROM asked JOIN found USING (asked)""",
    "q21_location_filter": f"""WITH {recommended(30, 10)} SELECT query_id, rank, id, lokasi FROM results
WHERE lokasi_filter = 'Semua Lokasi' OR contains(lower(lokasi), lower(lokasi_filter))""",
    "q21b_recommend_in_location": f"""WITH {recommended(15, 5, "(SELECT e.* FROM embeddings e JOIN part ON p_partkey = vec_id WHERE lower(p_brand) LIKE '%brand#1%')")}
SELECT query_id, rank, id, lokasi, final_score FROM results""",
    "q22_result_cards": f"""WITH {recommended(30, 10)} SELECT query_id, rank,
  CASE WHEN coalesce(harga_minimum, 0) = 0 THEN {text(fixed.NO_PRICE)}
       ELSE 'Rp ' || replace(format('{{:,}}', trunc(harga_minimum)::BIGINT), ',', '.') END AS harga_teks,
  CASE WHEN p_size % 4 = 3 THEN {text(fixed.NO_FACILITIES)}
       ELSE array_to_string({FACILITY_OUTPUT}, ' | ') END AS fasilitas_teks,
  format('{{:.1f}}', rating_rata) AS rating_teks, coalesce(photo_url, {text(fixed.NO_PHOTO)}) AS foto FROM results""",
    "q22b_price_text": f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice = 0 THEN {text(fixed.NO_PRICE)}
  ELSE 'Rp ' || replace(format('{{:,}}', trunc(o_totalprice * 10)::BIGINT), ',', '.') END AS harga_teks FROM orders""",
    "q23_metrics": f"""WITH {nearest(10)}, ranked AS (SELECT query_id, id, posisi AS rank FROM nearest), {metrics('ranked')}
{SHOWN_METRICS}""",
    "q24_mean_metrics": f"""WITH {nearest(10)}, ranked AS (SELECT query_id, id, posisi AS rank FROM nearest), {metrics('ranked')}
SELECT count(*) AS n_queries, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10,
       round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM metrics""",
    "q24b_run_evaluation": f"WITH {recommended(20, 10)}, {metrics('results')} {SHOWN_METRICS}",
    "q25_owner_replies": f"SELECT conv_id, turn, {owner('text')} AS owner FROM conversations",
    "q25b_owner_audit": f"""SELECT conv_id, turn, CASE WHEN {owner('text')} THEN 'owner' ELSE 'visitor' END AS side
FROM conversations""",
    "q26_repair_url": f"""WITH bare AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS b FROM pages),
raw AS (SELECT page_id, trim(CASE page_id % 6 WHEN 0 THEN 'httpsmaps.' || b WHEN 1 THEN 'httpmaps.' || b
    WHEN 2 THEN b WHEN 3 THEN url || '&hl=en' WHEN 4 THEN 'https://lh3.googleusercontent.com/' || b
    ELSE CASE WHEN page_id % 4 = 1 THEN replace(replace(b, '.', ' '), '/', '') ELSE url END END) AS u FROM bare),
checked AS (SELECT page_id, u, CASE WHEN contains(u, 'googleusercontent') THEN {text(fixed.IMAGE_LINK)}
    WHEN contains(u, ' ') AND NOT contains(u, '.') THEN {text(fixed.NOT_A_LINK)} END AS error FROM raw),
joined AS (SELECT page_id, error, CASE WHEN u LIKE 'httpsmaps%' THEN replace(u, 'httpsmaps', 'https://maps')
    WHEN u LIKE 'httpmaps%' THEN replace(u, 'httpmaps', 'http://maps') ELSE u END AS u FROM checked),
whole AS (SELECT page_id, error, CASE WHEN u LIKE 'http%' THEN u ELSE 'https://' || u END AS u FROM joined)
SELECT page_id, error, CASE WHEN error IS NOT NULL THEN NULL WHEN contains(u, 'hl=') THEN u
    ELSE u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'hl=id' END AS url FROM whole""",
    "q26b_labels": """SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN user_id::VARCHAR ELSE '0' END AS rating,
  CASE event_id % 5 WHEN 2 THEN user_id || ' minggu lalu' ELSE '' END AS waktu,
  CASE event_id % 5 WHEN 0 THEN user_id || ' bintang' WHEN 1 THEN user_id || '/5' WHEN 2 THEN user_id || ' minggu lalu'
    WHEN 3 THEN 'Open ' || event_type ELSE 'Cek Gmaps' END AS buka FROM events""",
    "q26c_place_rows": f"""SELECT coalesce(nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), ''), {text(fixed.NO_NAME)})
    AS "Nama_Tempat", CASE WHEN page_id % 3 > 0 THEN url || '/foto' ELSE '' END AS "Photo_URL", url AS "Gmaps_Link",
  CASE WHEN page_id % 2 = 0 THEN 'Open 9 am' ELSE 'Cek Gmaps' END AS "Waktu_Buka" FROM pages""",
    "q26d_relative_date": """SELECT event_id, CASE WHEN event_id % 6 < 5 THEN
  (ts::DATE - (user_id * [0, 1, 7, 30, 365][event_id % 6 + 1])::INTEGER)::VARCHAR END AS tanggal FROM events""",
    "q02d_weighted_rating": """WITH rated AS (SELECT o_orderpriority AS place, o_orderkey % 5 + 1.0::DOUBLE AS r,
  exp(-0.001::DOUBLE * (DATE '2000-01-01' - o_orderdate::DATE)) AS w FROM orders)
SELECT place AS "Nama_Tempat", round(sum(r * w) / sum(w), 6) AS "Rating_Berbobot" FROM rated GROUP BY 1""",
    "q27_title_name": "SELECT c_custkey, "
    + TITLE.format(name="""trim(c_mktsegment || '''s bumi-' || lower(c_name) || 'x ÉLAN ')""")
    + " AS name FROM customer",
    "q28_ingest_reviews": f"""WITH lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
  FROM documents),
kept AS (SELECT *, {strip('line')} AS t FROM lines),
cards AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source,
  string_agg(translate(t, chr(13), ' '), ' ' ORDER BY nr) AS t FROM kept WHERE t <> '' AND NOT {owner('t')} GROUP BY 1)
SELECT DISTINCT CASE lang WHEN 'en' THEN '5' WHEN 'de' THEN '4' ELSE '0' END AS "Rating",
  length(source) || ' bulan lalu' AS "Waktu", t AS "Teks_Mentah" FROM cards WHERE t <> ''""",
    "q29_search_history": """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS waktu, props AS query_user, event_type AS intent,
  'region ' || (user_id % 7) AS region, user_id AS jumlah_hasil, '-' AS hasil_teratas FROM events
ORDER BY event_id DESC LIMIT 50""",
    "q29b_search_log": f"""{SUMMARY},
  any_value(CASE {' '.join(f"WHEN {any_of('lower(a.query)', words)} THEN {text(name)}"
                           for name, words in fixed.INTENT_WORDS.items())} ELSE 'none' END) AS intent,
  'Semua Lokasi' AS region, '2024-05-01 08:30:00' AS waktu, length(any_value(a.query)) / 8.0::DOUBLE AS durasi_detik
  FROM asked a LEFT JOIN results r USING (query_id) GROUP BY 1""",
    "q30_place_details": f"""WITH {PART_PRICES}, {FACILITIES},
p AS (SELECT tempat_id, seq // 4096 AS seg, count(*) AS n, string_agg(item, ';' ORDER BY seq) AS items
  FROM part_prices GROUP BY 1, 2),
f AS (SELECT tempat_id, seq // 4096 AS seg, coalesce(string_agg("Fasilitas", ';' ORDER BY seq), '') AS names
  FROM facilities GROUP BY 1, 2),
sides AS (SELECT * FROM p FULL JOIN f USING (tempat_id, seg)),
held AS (SELECT tempat_id, min(seg) AS low, bool_or(n IS NOT NULL) AS priced, bool_or(names IS NOT NULL) AS is_named
  FROM sides GROUP BY 1),
joined AS (SELECT *, seg IS NULL OR seg = low AS on_top FROM supplier LEFT JOIN held ON tempat_id = s_suppkey
  LEFT JOIN sides USING (tempat_id))
SELECT s_suppkey AS id, s_name AS nama, coalesce(seg, 0) AS "Segmen",
  CASE WHEN n IS NOT NULL THEN n WHEN on_top AND priced IS NOT TRUE AND s_nationkey % 3 = 1 THEN 1 ELSE 0 END AS n_harga,
  CASE WHEN n IS NOT NULL THEN items WHEN on_top AND priced IS NOT TRUE AND s_nationkey % 3 = 1 THEN 'Tiket' ELSE '' END AS items,
  CASE WHEN names IS NOT NULL THEN names WHEN on_top AND is_named IS NOT TRUE AND s_nationkey > 4
    THEN 'Toilet;Mushola;' || s_name ELSE '' END AS fasilitas
FROM joined""",
    "q31_bookings_of_users": f"""WITH {BOOKED} SELECT user_id, b.id, n_name AS nama, tanggal_checkin, total_harga, status,
  jumlah_orang FROM bookings b JOIN nation ON n_nationkey = tempat_id""",
    "q32_all_bookings": f"""WITH {BOOKED} SELECT b.id, c_name AS username, n_name AS nama, tanggal_checkin, total_harga, status
FROM bookings b JOIN nation ON n_nationkey = tempat_id JOIN customer ON c_custkey = user_id""",
    "q33_status_changes": """WITH latest AS (SELECT l_orderkey, 'line ' || arg_max(l_linestatus, (l_linenumber, l_linestatus)) AS status
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_custkey AS user_id, coalesce(status, o_orderstatus) AS status
FROM orders LEFT JOIN latest ON l_orderkey = o_orderkey""",
    "q34_check_places": f"""WITH {PLACES},
per_place AS (SELECT "Nama_Tempat", max(length(coalesce("Profil_Teks", ''))) AS chars, any_value("Rating_Rata") AS rating,
  any_value("Jumlah_Review") AS n FROM places GROUP BY 1)
SELECT 'distinct_places' AS rule, count(*) - count(DISTINCT ("Nama_Tempat", "Segmen")) AS bad_rows FROM places
UNION ALL SELECT 'profile_not_empty', count(*) FILTER (WHERE chars = 0) FROM per_place
UNION ALL SELECT 'rating_in_range', count(*) FILTER (WHERE NOT coalesce(rating BETWEEN 1 AND 5, false)) FROM per_place
UNION ALL SELECT 'at_least_one_review', count(*) FILTER (WHERE n < 1) FROM per_place""",
    "st1_ingest_stream": """SELECT DISTINCT (user_id % 5 + 1)::VARCHAR AS "Rating",
  (user_id % 4 + 1) || ' minggu lalu' AS "Waktu",
  event_type || ' ' || props || CASE WHEN event_type = 'view' THEN '' ELSE ' saya suka, terima kasih' END AS "Teks_Mentah"
FROM events""",
    "st2_merge_stream": """WITH master AS (SELECT doc_id, source, text FROM documents JOIN labels USING (doc_id)),
fresh AS (SELECT doc_id, source, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1),
added AS (SELECT f.* FROM fresh f ANTI JOIN master m ON m.source = f.source AND m.text = f.text)
SELECT doc_id AS "Doc_ID", source AS "Nama_Tempat", text AS "Teks_Mentah", 'lama' AS "Waktu" FROM master
UNION ALL
SELECT (SELECT max(doc_id) FROM master) + row_number() OVER (ORDER BY doc_id), source, text, 'baru' FROM added""",
}

# The same rows, through the stored index.
ORACLE["q15d_index_topk"] = ORACLE["q15_vector_topk"]
ORACLE["q19d_recommend_by_index"] = ORACLE["q19_recommend"]
ORACLE["q13c_indexed_search"] = ORACLE["q13_tfidf_search"]
