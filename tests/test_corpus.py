from datetime import date, datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from placelens import session
from placelens.functions import fixed_values as fixed
from placelens.operators.corpus import ingest_reviews, merge_corpus, split_owner_replies
from placelens.sources import readers, schemas, sinks
from placelens.streaming import merge
from placelens.streaming.ingest import STATE_SETTINGS, read_reviews, start_ingest
from placelens.streaming.merge import digests, merge_batch, read_corpus, start_merge

MASTER = [
    (2, "Kali", "Sleman", 4.0, "sejuk", "a"),
    (5, "Kali ", "Sleman", 5.0, "sejuk", "b"),
    (3, "Kali", "Sleman", None, None, "c"),
    (9, "Bukit", None, 3.0, "sejuk", "d"),
]
STAGING = [
    (1, " Kali", "X", 1.0, "sejuk", "e"),
    (2, "Kali\t", "X", 1.0, None, "f"),
    (3, "Kali", "X", 1.0, "baru", "g"),
    (4, "Kali", "X", 2.0, "baru", "h"),
    (5, None, None, None, "baru", "i"),
]


@pytest.fixture
def master(spark):
    return spark.createDataFrame(MASTER, schemas.REVIEWS)


@pytest.fixture
def staging(spark):
    return spark.createDataFrame(STAGING, schemas.REVIEWS).withColumn("ekstra", F.lit(1))


def test_merge(master, staging):
    merged, counts = merge_corpus(master, staging)
    rows = [tuple(r) for r in merged.orderBy("Doc_ID").collect()]
    assert merged.columns == fixed.CORPUS_COLUMNS
    assert [(r[0], r[5]) for r in rows] == [(1, "a"), (2, "c"), (3, "d"), (4, "g"), (5, "i")]
    assert rows[0][1] == "Kali"
    assert counts.first().asDict() == {"rows_before": 4, "rows_after": 5, "new_rows": 1, "inserted_rows": 2}


def test_merge_into_nothing(staging):
    merged, counts = merge_corpus(None, staging)
    assert [r["Waktu"] for r in merged.orderBy("Doc_ID").collect()] == ["e", "f", "g", "i"]
    assert counts.first()["rows_before"] == 0


def test_merge_without_unique_ids(spark, master, staging):
    for bad in (F.lit(7), F.lit(None).cast("long"), F.when(F.col("Doc_ID") < 4, F.col("Doc_ID"))):
        merged, counts = merge_corpus(master, staging.coalesce(1).withColumn("Doc_ID", bad))
        rows = merged.orderBy("Doc_ID").collect()
        assert [(r["Doc_ID"], r["Waktu"]) for r in rows[:3]] == [(1, "a"), (2, "c"), (3, "d")]
        assert sorted(r["Teks_Mentah"] for r in rows[3:]) == ["baru", "baru"] and rows[4]["Doc_ID"] == 5
        assert counts.first()["inserted_rows"] == 2


def test_a_repeated_id_elsewhere_changes_nothing(spark, master, staging):
    other = spark.createDataFrame([(3, "Lain", None, None, "x", "z"), (3, "Lain", None, None, "y", "z")], schemas.REVIEWS)
    for extra in (staging, staging.unionByName(other, allowMissingColumns=True)):
        rows = merge_corpus(master, extra)[0].filter("Teks_Mentah = 'baru'").collect()
        assert sorted(r["Waktu"] for r in rows) == ["g", "i"]
    twice = merge_corpus(master, staging.unionByName(staging))[0]
    assert twice.count() == 5


def test_merge_without_column(spark, master, staging):
    merged, _ = merge_corpus(master.drop("Lokasi"), staging.drop("Lokasi", "Waktu"))
    assert merged.columns == ["Doc_ID", "Nama_Tempat", "Rating", "Teks_Mentah", "Waktu"]
    assert merged.count() == 5


CARDS = [
    (["Bagus\nsekali", "Terima kasih kak"], "4 bintang", "2 minggu lalu", date(2024, 5, 2)),
    (["Bagus sekali"], "4/5", "2 minggu lalu", date(2024, 5, 1)),
    (["Terima kasih kak"], "4/5", "kemarin", date(2024, 5, 1)),
    ([" ", None, "Saya suka, terima kasih"], None, "kemarin", date(2024, 5, 1)),
]
CARD = "fragments array<string>, rating_label string, time_label string, Tanggal_Scrap date"


def test_ingest(spark):
    rows = ingest_reviews(spark.createDataFrame(CARDS, CARD)).collect()
    assert sorted(map(tuple, rows)) == [
        ("0", "", "Saya suka, terima kasih", date(2024, 5, 1)),
        ("4", "2 minggu lalu", "Bagus sekali", date(2024, 5, 1)),
    ]


def test_owner_split_is_complete(spark):
    df = spark.createDataFrame([("terima kasih",), ("bagus",), (None,)], "Teks_Mentah string")
    kept, owner = split_owner_replies(df)
    assert (kept.count(), owner.count()) == (2, 1)


def test_ingest_stream_equals_batch(spark, tmp_path):
    cards = spark.createDataFrame([(*c, datetime(2024, 5, 1, i)) for i, c in enumerate(CARDS)], CARD + ", ts timestamp")
    for part in range(2):
        cards.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(cards.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        start_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    columns = ["Rating", "Waktu", "Teks_Mentah"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()))
    assert got == sorted(map(tuple, ingest_reviews(cards).select(*columns).collect()))


def test_late_reviews_arrive(spark, tmp_path):
    """Three files in three runs; the last review is far older than the others."""
    schema = "fragments array<string>, rating_label string, time_label string, ts timestamp"
    for n, ts in enumerate((datetime(2024, 5, 1), datetime(2024, 8, 1), datetime(2022, 12, 1))):
        card = spark.createDataFrame([([f"ulasan {n}"], "4/5", "lama", ts), (["sama"], "4/5", "lama", ts)], schema)
        card.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        start_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = read_reviews(spark, f"{tmp_path}/out", "Teks_Mentah string").collect()
    assert sorted(r["Teks_Mentah"] for r in got) == ["sama", "ulasan 0", "ulasan 1", "ulasan 2"]


def _cards(spark, texts):
    schema = "fragments array<string>, rating_label string, time_label string"
    return spark.createDataFrame([([t], "4/5", "lama") for t in texts], schema)


def _ingest(spark, tmp_path, **options):
    stream = spark.readStream.schema(_cards(spark, []).schema).parquet(f"{tmp_path}/in")
    query = start_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", **options)
    query.awaitTermination()
    return sorted(r["Teks_Mentah"] for r in read_reviews(spark, f"{tmp_path}/out", "Teks_Mentah string").collect())


@pytest.mark.parametrize("keep_for", [None, "30 days"])
def test_ingest_keeps_digests_as_state(spark, tmp_path, keep_for):
    _cards(spark, ["sama"] * 500 + ["satu"]).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    assert _ingest(spark, tmp_path, keep_for=keep_for) == ["sama", "satu"]
    # The next batch does without the rows that were written.
    (tmp_path / "out").rename(tmp_path / "away")
    _cards(spark, ["sama"] * 500 + ["dua"]).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    assert _ingest(spark, tmp_path, keep_for=keep_for) == ["dua"]


def test_ingest_batch_runs_again(spark, tmp_path):
    """A batch that was written but not committed comes once."""
    _cards(spark, ["satu", "dua", "satu"]).write.mode("append").parquet(f"{tmp_path}/in")
    assert _ingest(spark, tmp_path) == ["dua", "satu"]
    for name in ("0", ".0.crc"):
        (tmp_path / "state" / "commits" / name).rename(tmp_path / f"commit-{name}")
    assert _ingest(spark, tmp_path) == ["dua", "satu"]


def test_ingest_leaves_the_settings(spark, tmp_path):
    _cards(spark, []).write.mode("append").parquet(f"{tmp_path}/in")
    assert _ingest(spark, tmp_path) == []
    assert all(spark.conf.get(key, None) is None for key in STATE_SETTINGS)


def test_unseen_leaves_old_digests_where_they_lie(spark, tmp_path, monkeypatch):
    for name, numbers in (("old", range(0, 60, 2)), ("new", range(0, 60, 3))):
        rows = spark.createDataFrame([(bytes([n]),) for n in numbers], "_digest binary")
        rows.write.parquet(f"{tmp_path}/{name}")
    old, new = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new"))
    few = merge.unseen(new, old)
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(merge, "MOST_SENT", 5)
    many = merge.unseen(new, old)
    odd = [bytes([n]) for n in range(3, 60, 6)]
    assert sorted(r[0] for r in few.collect()) == sorted(r[0] for r in many.collect()) == odd


def test_master_is_hashed_once(spark, master, staging, tmp_path):
    master.write.parquet(f"{tmp_path}/master")

    def run():
        source = spark.readStream.schema(schemas.REVIEWS).parquet(f"{tmp_path}/in")
        start_merge(source, f"{tmp_path}/master", f"{tmp_path}/added", f"{tmp_path}/state").awaitTermination()
        return sorted(path.name for path in (tmp_path / "added_digests" / "batch=-1").glob("*.parquet"))

    empty = staging.drop("ekstra").limit(0)
    empty.write.mode("append").parquet(f"{tmp_path}/in")
    first = run()
    staging.drop("ekstra").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == first
    numbers = spark.read.parquet(f"{tmp_path}/added_numbers").orderBy("batch").collect()
    assert (numbers[0]["last"], numbers[-1]["last"]) == (9, 11)
    # Another master under the same path is hashed when the stream starts.
    master.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/master")
    assert run() != first


def test_merge_batch(master, staging):
    rows = merge_batch(digests(master), 9, staging.drop("ekstra")).orderBy("Doc_ID").collect()
    # The master's padded name does not match a trimmed one, as its rows stay untouched.
    assert [(r["Doc_ID"], r["Nama_Tempat"], r["Waktu"]) for r in rows] == [(10, "Kali", "g"), (11, None, "i")]


def test_merge_stream_runs_again(spark, master, staging, tmp_path):
    master.write.parquet(f"{tmp_path}/master")
    source = lambda: spark.readStream.schema(schemas.REVIEWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda state: start_merge(source(), f"{tmp_path}/master", f"{tmp_path}/added", f"{tmp_path}/{state}").awaitTermination()
    staging.drop("ekstra").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run("state")
    staging.drop("ekstra").withColumn("Teks_Mentah", F.concat("Teks_Mentah", F.lit("!"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run("state")
    result = lambda: sorted((r["Doc_ID"], r["Waktu"]) for r in read_corpus(spark, f"{tmp_path}/master", f"{tmp_path}/added").collect())
    first = result()
    assert first == [(2, "a"), (3, "c"), (5, "b"), (9, "d"), (10, "g"), (11, "i"), (12, "e"), (13, "g"), (14, "i")]
    # A lost state replays all batches; the same rows come out once.
    run("other_state")
    assert [d for d, _ in result()] == [d for d, _ in first]


def test_csv_round_trip(spark, tmp_path):
    rows = [("Kali", 'kata "dua"', "buka\nSenin\nSelasa", "a,b"), (" Bukit ", None, "", None)]
    df = spark.createDataFrame(rows, schemas.STATIC_INFO)
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/t.csv")
    back = readers.with_trimmed_key(readers.read_table(spark, f"{tmp_path}/t.csv", schemas.STATIC_INFO)).collect()
    assert tuple(back[0]) == rows[0]
    assert back[1]["Nama_Tempat"] == "Bukit"


def test_info_inputs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Nama_Tempat,Photo_URL,Gmaps_Link,Waktu_Buka\n Kali ,,,\"a\nb\"\n")
    (tmp_path / "h.csv").write_text('Nama_Tempat,item,harga,kategori\nKali,"Tenda, besar",,sewa pokok\nKali,Tiket,5000,biaya wajib\n')
    (tmp_path / "f.csv").write_text("Nama_Tempat,Fasilitas\nKali,Toilet\n")
    static, prices, facilities = readers.read_info_inputs(spark, *(f"{tmp_path}/{n}.csv" for n in "shf"))
    assert static.first()["Waktu_Buka"] == "a\nb"
    assert [r["item"] for r in prices.orderBy("seq").collect()] == ["Tenda, besar", "Tiket"]
    assert facilities.count() == 1


def test_nested_columns_export_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "é"])], "id int, f array<string>")
    sinks.write_csv(df, f"{tmp_path}/n")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/n").first()["f"] == '["a","é"]'
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first()["f"] == ["a", "é"]


def test_missing_master_is_empty(spark, tmp_path):
    empty = readers.read_master(spark, f"{tmp_path}/none.parquet")
    assert empty.count() == 0 and empty.columns == fixed.CORPUS_COLUMNS


def test_versions_and_append(spark, tmp_path):
    path = f"{tmp_path}/v"
    sinks.write_version(spark.range(3), path, datetime(2024, 1, 1))
    sinks.write_version(spark.range(5), path, datetime(2024, 1, 2))
    assert sinks.read_latest_version(spark, path).count() == 5
    sinks.append_rows(spark.range(2), f"{tmp_path}/a")
    sinks.append_rows(spark.range(2), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4


def test_sql_and_spread(spark):
    df = spark.range(10).coalesce(1)
    assert readers.read_sql(spark, "SELECT sum(id) AS s FROM {t}", {"t": df}).first()["s"] == 45
    assert readers.spread_rows(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 20)
    assert readers.spread_rows(many, "id") is many


def test_shared_folder_is_the_configured_one(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.rglob("*.parquet"))
    assert session.materialise(spark.range(3)).count() == 3
    assert set(folder.rglob("*.parquet")) > before


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(bare)
