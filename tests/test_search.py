import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.operators import hybrid as H
from placelens.operators import tfidf
from placelens.operators.encode import HashingEncoder, encode, encode_places
from placelens.operators.tfidf import build_tfidf, tfidf_search
from placelens.operators.words import keyword_counts, word_counts
from placelens.plans.recommend import recommend_texts

GRID = {"max_queries": 2}
WORDS = "api unggun danau pantai sejuk murah toilet bersih kotor ramai sepi hutan pinus kabut jalan rusak".split()


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(5)
    rows = [(i, f"place {rng.randrange(9)}", "kota", " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for i in range(60)]
    rows += [(60, "place 1", "kota", None), (61, "place 2", None, ""), (62, None, "kota", "danau danau"), (63, "X", "kota", "a b c")]
    rows += [(64 + i, "copy", "kota", "pantai sepi") for i in range(6)]
    return rows, spark.createDataFrame(rows, "id long, nama string, lokasi string, teks_mentah string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "Pantai SEPI"), (2, "danau, danau & hutan"), (3, "tidakada"), (4, ""), (5, "toilet bersih jalan rusak kabut")]
    return rows, spark.createDataFrame(rows, "query_id long, query string")


def by_query(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["nama"], r["skor_relevansi"]))
    return got


def ranked(scores, names, cut, k, decimals):
    """Cut, then the best per place, then the first k; scores is {id: score}."""
    order = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:cut]
    seen, out = set(), []
    for i in order:
        if names[i] not in seen:
            seen.add(names[i])
            out.append((len(out) + 1, i, names[i], pytest.approx(scores[i] * 100, abs=0.51 * 10**-decimals)))
    return out[:k]


@pytest.mark.parametrize("blocks", [{}, GRID])
@pytest.mark.parametrize("k", [1, 3])
def test_tfidf_equals_brute_force(spark, reviews, queries, blocks, k, no_broadcast):
    rows, table = reviews
    texts = {r[0]: r[3] for r in rows if r[3]}
    tok = lambda t: Counter(re.findall(r"\b\w\w+\b", t.lower()))
    n = len(texts)
    df = Counter(w for t in texts.values() for w in tok(t))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}

    def unit(text):
        w = {t: c * idf[t] for t, c in tok(text).items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()} if size else {}

    expected = {}
    for q, text in queries[0]:
        v = unit(text)
        scores = {i: sum(x * unit(t).get(w, 0) for w, x in v.items()) for i, t in texts.items()}
        found = ranked({i: s for i, s in scores.items() if s >= 0.01}, {r[0]: r[1] for r in rows}, 5 * k, k, 2)
        if found:
            expected[q] = found
    assert by_query(tfidf_search(queries[1], table, k, **blocks)) == expected


def test_tfidf_index_is_reusable(reviews, queries):
    index = build_tfidf(reviews[1])
    assert index.texts == 68
    assert by_query(tfidf_search(queries[1], reviews[1], 2, index)) == by_query(tfidf_search(queries[1], reviews[1], 2))
    lengths = index.vectors.select(F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w), 9).alias("n"))
    assert lengths.distinct().collect() == [(1.0,)]


@pytest.mark.parametrize("hot_bytes", [0, 100, 1 << 20])
def test_only_rare_terms_are_shuffled(monkeypatch, spark, reviews, hot_bytes):
    """Weights are the same wherever a term is weighed; texts of one key, or of none, are one text each."""
    rows = [(None, "w", "kota", "danau pinus"), (None, "w", "kota", "hutan"), (3, "w", "kota", "danau zzz")]
    table = reviews[1].unionByName(spark.createDataFrame(rows, reviews[1].schema))
    vectors = lambda: {
        r.id: (sorted(r.terms), [round(w, 9) for _, w in sorted(zip(r.terms, r.weights))])
        for r in build_tfidf(table).vectors.collect()
    }
    expected = vectors()
    assert expected[None][0] == ["danau", "hutan", "pinus"] and len(expected) == 68
    met = []
    shared = tfidf.most_frequent
    monkeypatch.setattr(tfidf, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(tfidf, "most_frequent", lambda t, *a: met.append(t.filter(~shared(t, *a)).count()) or shared(t, *a))
    assert vectors() == expected
    assert met[0] == {0: 17, 1 << 20: 0}.get(hot_bytes, met[0]) and (hot_bytes != 100 or 0 < met[0] < 17)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    vectors = {w: [rng.uniform(-1, 1) for _ in range(3)] for w in WORDS[:12]}
    return vectors, spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")


@pytest.mark.parametrize("blocks", [{}, GRID])
@pytest.mark.parametrize("model_bytes", [0, 1 << 20])
def test_hybrid_equals_brute_force(monkeypatch, reviews, queries, model, blocks, model_bytes, no_broadcast):
    load = H.load_words
    monkeypatch.setattr(H, "load_words", lambda vectors: load(vectors, model_bytes))
    vectors, table = model
    clean = lambda t: re.sub(r"[^a-z0-9\s]", "", t.lower())

    def mean(text):
        known = [vectors[w] for w in text.split() if w in vectors]
        return [sum(x) / len(known) for x in zip(*known)] if known else [0.0] * 3

    def cosine(a, b):
        size = math.dist(a, [0] * 3) * math.dist(b, [0] * 3)
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    rows = [r for r in reviews[0] if r[3]]
    names = {r[0]: r[1] for r in rows}
    k, expected = 4, {}
    for q, text in queries[0]:
        c = clean(text)
        scores = {
            i: 0.4 * cosine(mean(c), mean(clean(t))) + 0.3 * (c in clean(t)) + 0.3 * (name is not None and c in name.lower())
            for i, name, _, t in rows
        }
        found = ranked({i: s for i, s in scores.items() if s > 0.01}, names, 2 * k, k, 1)
        if found:
            expected[q] = found
    assert by_query(H.hybrid_search(queries[1], reviews[1], table, k, **blocks)) == expected


@pytest.mark.parametrize("model_bytes", [0, 150])
def test_a_large_model_is_not_shared_whole(monkeypatch, spark, model, model_bytes):
    """Every row gets the mean of its own words, copies and rows without a key too; workers hold few vectors."""
    vectors, table = model
    texts = [(1, "api api danau x"), (2, "jalan"), (2, "jalan"), (2, "murah toilet"), (None, "sepi api"), (None, "sepi api"), (4, "")]
    texts += [(10 + i, "api unggun danau pantai") for i in range(20)]
    shared, share = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: shared.append(x) or share(self, x))
    words = H.load_words(table, model_bytes)
    found = H.mean_vectors(spark.createDataFrame(texts, "k long, t string"), "k", "t", words).collect()
    mean = lambda known: [round(sum(x) / len(known), 9) for x in zip(*known)] if known else [0.0] * 3
    expected = [(k or 0, t, mean([vectors[w] for w in t.split() if w in vectors])) for k, t in texts]
    assert sorted((r.k or 0, r.t, [round(x, 9) for x in r.vector]) for r in found) == sorted(expected)
    held = [x for x in shared if x.num_rows]
    assert len(held) == (model_bytes > 0) and all(x.num_rows * 24 <= model_bytes for x in held)
    assert H.MODEL_BYTES <= 16 << 20


def test_texts_of_a_large_model_are_not_shuffled(monkeypatch, spark, model, tmp_path):
    """Words and sums move, but no text does where only the vectors are asked for."""
    rows = [(i, "api unggun danau pantai jalan murah " * 3 + str(i)) for i in range(50)]
    spark.createDataFrame(rows, "k long, t string").write.parquet(f"{tmp_path}/t")
    plans, store = [], H.materialise
    explain = lambda df: plans.append(df._jdf.queryExecution().explainString(formatted))
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    monkeypatch.setattr(H, "materialise", lambda df: explain(df) or store(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = H.mean_vectors(spark.read.parquet(f"{tmp_path}/t"), "k", "t", H.load_words(model[1], 0)).select("k", "vector")
        explain(found)
        assert found.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = [m for plan in plans for m in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert moved and not [m for m in moved if re.search(r"\bt#", m)]


def test_hybrid_cleans_texts_once(monkeypatch, spark, reviews, queries, model):
    """Every later step, for each block of queries, reads the stored texts."""
    load, cleaned, clean = H.load_words, [], H.cleaned_texts
    monkeypatch.setattr(H, "load_words", lambda vectors: load(vectors, 0))
    monkeypatch.setattr(H, "cleaned_texts", lambda texts: cleaned.append(texts.count()) or clean(texts))
    whole = by_query(H.hybrid_search(queries[1], reviews[1], model[1], 4))
    assert by_query(H.hybrid_search(queries[1], reviews[1], model[1], 4, max_queries=1)) == whole
    assert cleaned == [len([r for r in reviews[0] if r[3]])] * 2
    nothing = H.hybrid_search(queries[1].limit(0), reviews[1], model[1], 4)
    assert nothing.count() == 0 and nothing.columns == H.hybrid_search(queries[1], reviews[1], model[1], 4).columns


def test_word_counts(spark):
    texts = [("Api, api unggun", "en"), ("api\u00a0danau", None), (None, "en"), ("  ", "de"), ("Ünggun api", "id"), ("danau danau", "de")]
    table = spark.createDataFrame(texts, "t string, lang string")
    counts = {r["word"]: r["n"] for r in word_counts(table, "t").collect()}
    assert counts == Counter(w for t, _ in texts for w in (t or "").split())
    found = {r["word"]: tuple(r)[1:] for r in keyword_counts(table, "t", "lang", ("de", "en")).collect()}
    assert found == {"api": (3, 0, 1), "unggun": (1, 0, 1), "nggun": (1, 0, 0), "danau": (2, 1, 0)}


def test_summary(queries, reviews):
    results = H.hybrid_search(queries[1], reviews[1], k=2)
    rows = {r["query_id"]: r for r in H.search_summary(queries[1], results).collect()}
    assert rows[2]["query_bersih"] == "danau danau  hutan"
    assert (rows[3]["jumlah_hasil"], rows[3]["hasil_teratas"]) == (0, fixed.NO_RESULT)
    assert (rows[1]["jumlah_hasil"], rows[4]["jumlah_hasil"]) == (min(2, rows[1]["jumlah_hasil"]), 2)


def test_encoder_is_additive(spark, reviews):
    encoder = HashingEncoder(32)
    parts = encoder(["danau sejuk", "Danau hutan", ""])
    assert (encoder(["danau sejuk danau hutan"])[0] == parts.sum(axis=0)).all()
    assert not parts[2].any()
    table = encode(reviews[1], "teks_mentah", lambda: HashingEncoder(8), batch_size=3)
    assert table.columns == ["id", "nama", "lokasi", "embedding"]
    assert {len(r["embedding"]) for r in table.collect()} == {8}
    assert encode(reviews[1].limit(0), "teks_mentah").count() == 0


def test_recommend_texts(spark, reviews):
    vectors = encode_places(reviews[1].filter("nama is not null"), "nama", "teks_mentah")
    vectors = vectors.withColumnRenamed("nama", "id")
    places = vectors.select("id", F.col("id").alias("nama_tempat"), F.lit(4.0).alias("rating_rata"), F.lit(3).cast("bigint").alias("jumlah_review"), F.lit(None).cast("double").alias("harga_minimum"), F.lit("a | b").alias("facilities"))
    asked = spark.createDataFrame([(1, "pantai sepi"), (2, "  ")], "query_id long, query string")
    rows = recommend_texts(asked, vectors, places, k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"]) for r in rows] == [(1, 1), (1, 2), (1, 3)]
    assert rows[0]["nama_tempat"] == "copy"
