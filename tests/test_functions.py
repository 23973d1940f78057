import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions import metadata as M
from placelens.functions import scraped as S
from placelens.functions import text as X
from placelens.functions import vectors as V
from placelens.functions.arrow_text import keyword_texts, lists_by_row, positions, text_slices, text_words
from placelens.operators.rerank import detect_intent


def run(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


CLEANED = {
    None: "",
    "": "",
    "   \n ": "",
    "Bagus!!! Sekali??? ya...": "bagus! sekali? ya.",
    "lihat https://a.b/c?d=1 dan http://x": "lihat dan",
    "hai @budi_1 #camping_2024 ok": "hai ok",
    "Ünïcode élan 5★ 😀 a b c": "ünïcode élan 5 a b c",
    "tanda (kurung) [siku] & 'kutip' \"dua\" a-b": "tanda kurung siku 'kutip' \"dua\" a-b",
    "!!! ??? ...": "! ? .",
    "😀😀": "",
    "a\tb\r\nc": "a b c",
}


def test_clean_text(spark):
    assert run(spark, X.clean_text, list(CLEANED)) == list(CLEANED.values())


def test_clean_keywords(spark):
    assert run(spark, X.clean_keywords, ["Café No. 1!", "", None, "a-b c"]) == ["caf no 1", "", None, "ab c"]


def test_tokens(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["", "a b c", "don't stop_it a1 é ñandú", "x" * 3]
    assert run(spark, X.tokens, texts) == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]


def test_title_name(spark):
    names = ["camp's SITE-a 2nd area", 'a/b*c:"d"', "  pantai (umbul)  ", "é lan", ""]
    expected = [re.sub(r'[\\/*?:"<>|]', "", n).strip().title() for n in names]
    assert run(spark, X.title_name, names) == expected


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .,!?@#\n'é-", max_size=30), min_size=1, max_size=20))
def test_clean_text_leaves_no_runs(spark, texts):
    for cleaned in run(spark, X.clean_text, texts):
        assert cleaned == cleaned.strip()
        assert not re.search(r"\s\s|!!|\?\?|\.\.|[@#]|\n", cleaned)


def test_owner(spark):
    cases = {
        "Terima kasih atas kunjungannya": True,
        "Terima kasih, saya suka": False,
        "tq": True,
        "brr": True,
        "bagus": False,
        "kompor ada": True,
        "kompor kita pakai": False,
        "Kami merasa senang, makasih": False,
        None: False,
    }
    assert run(spark, S.likely_owner, list(cases)) == list(cases.values())


def test_labels(spark):
    assert run(spark, S.rating_label, ["4 bintang", "5 stars", "4/5", " 3/5 ", "baik", None, ""]) == [
        "4", "5", "4", "3", "0", "0", "0",
    ]
    assert run(spark, S.time_label, [" 2 minggu lalu ", "a week ago", "kemarin", None]) == [
        "2 minggu lalu", "a week ago", "", "",
    ]
    assert run(spark, S.hours_label, ["Open 9 am ", "", None]) == ["Open 9 am", "Cek Gmaps", "Cek Gmaps"]


def test_repair_url(spark):
    cases = {
        " https://maps.x/a ": ("https://maps.x/a?hl=id", None),
        "httpsmaps.x/a?b=1": ("https://maps.x/a?b=1&hl=id", None),
        "httpmaps.x/a?hl=en": ("http://maps.x/a?hl=en", None),
        "maps.x": ("https://maps.x?hl=id", None),
        "https://lh3.googleusercontent.com/p": (None, fixed.IMAGE_LINK),
        "Pantai Indah": (None, fixed.NOT_A_LINK),
        "Pantai v1.2": ("https://Pantai v1.2?hl=id", None),
    }
    assert [tuple(r) for r in run(spark, S.repair_url, list(cases))] == list(cases.values())


def test_minimum_price(spark):
    cases = {
        None: None,
        "": None,
        "[]": None,
        "[oops": None,
        '[{"item":"a","harga":5000,"kategori":"biaya wajib"},{"item":"b","harga":2500.5,"kategori":"sewa pokok"},'
        '{"item":"c","harga":9,"kategori":"sewa mewah"}]': 7500.5,
        '[{"item":"a","harga":5000,"kategori":"layanan"}]': 0.0,
        '[{"item":"a","harga":null,"kategori":"biaya wajib"}]': 0.0,
    }
    assert run(spark, M.minimum_price, list(cases)) == list(cases.values())


def test_facilities(spark):
    values = [None, "", " | ", "A | | B", "A|B |C", '["A","B"]', "[broken", "nan"]
    assert run(spark, M.facility_list, values[:5]) == [None, None, None, ["A", "B"], ["A", "B", "C"]]
    assert run(spark, M.facility_count, values) == [0, 0, 2, 3, 3, 2, 0, 0]
    assert run(spark, M.facility_output, values) == [
        [], [""], ["", ""], ["A", "", "B"], ["A", "B", "C"], ["A", "B"], ["[broken"], [],
    ]


def test_cards(spark):
    assert run(spark, M.price_text, [None, 0.0, 1500000.9, 999.0], "double") == [
        fixed.NO_PRICE, fixed.NO_PRICE, "Rp 1.500.000", "Rp 999",
    ]
    assert run(spark, M.facility_summary, [list("abcdef"), list("ab"), []], "array<string>") == [
        "a | b | c | d | e...", "a | b", fixed.NO_FACILITIES,
    ]


def test_vectors(spark):
    values = [[3.0, 4.0], [0.0, 0.0]]
    assert run(spark, V.norm, values, "array<float>") == [5.0, 0.0]
    unit = run(spark, V.normalise, values, "array<float>")
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [0.0, 0.0]
    assert run(spark, lambda c: V.cosine(c, F.array(F.lit(4.0), F.lit(3.0))), values, "array<float>") == [
        pytest.approx(0.96), 0.0,
    ]


def test_intent(spark):
    cases = {
        "tempat MURAH lengkap": "murah",
        "gratis dan murah": "gratis",
        "carefree camp": "gratis",
        "komplit": "lengkap",
        "sejuk": "none",
        "": "none",
    }
    assert run(spark, detect_intent, list(cases)) == list(cases.values())


def test_relative_date(spark):
    labels = ["2 minggu lalu", "seminggu lalu", "a month ago", "5 hours ago", "3 tahun lalu", "kemarin", None]
    days = run(spark, lambda c: F.datediff(F.lit("2024-01-01").cast("date"), X.relative_date(c, F.lit("2024-01-01").cast("date"))), labels)
    assert days == [14, 7, 30, 0, 1095, None, None]


def test_term_counts(spark):
    texts = ["danau pantai danau", "", "a b", None, "satu", "É é éé éé zz aa éé"]
    got = run(spark, lambda c: F.map_from_entries(X.term_counts(c)), texts)
    assert got == [{"danau": 2, "pantai": 1}, None, None, None, {"satu": 1}, {"aa": 1, "zz": 1, "éé": 3}]


def test_arrow_text_equals_columns(spark, tmp_path):
    """Every character, alone and among others: cleaned and split in Arrow as in columns."""
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"A{c}b {c}{c} " for c in signs[at : at + 64]) for at in range(0, len(signs), 64)] + ["", " \u2003\t", None]
    pq.write_table(pa.table({"t": pa.array(texts, pa.string())}), f"{tmp_path}/t.parquet")
    t = F.col("t")
    spark.read.parquet(f"{tmp_path}/t.parquet").select("t", X.clean_keywords(t).alias("k"), X.words(t).alias("w")).write.parquet(f"{tmp_path}/out")
    rows = pq.read_table(f"{tmp_path}/out")
    array = rows["t"].combine_chunks()
    assert len(array) == len(texts) and keyword_texts(array).to_pylist() == rows["k"].to_pylist()
    row, said = text_words(array)
    assert lists_by_row(row, said, len(array)).to_pylist() == [w or [] for w in rows["w"].to_pylist()]


def test_arrow_text_of_odd_arrays():
    ends = pa.py_buffer(np.array([0, 6, 6], np.int32))
    broken = pa.Array.from_buffers(pa.string(), 2, [pa.py_buffer(b"\x01"), ends, pa.py_buffer(b"Ab\xff c\xc3")])
    assert keyword_texts(broken).to_pylist() == ["ab c", None]
    batch = pa.RecordBatch.from_pydict({"t": ["", "aaaa", None, "b" * 50, "c", "d" * 9, "e"]})
    slices = [x.column("t").to_pylist() for x in text_slices(batch, "t", 10)]
    assert slices == [["", "aaaa", None, "b" * 50], ["c", "d" * 9], ["e"]]
    assert list(text_slices(batch.slice(0, 0), "t")) == []
    row, said = text_words(batch.column("t"))
    assert row.tolist() == [1, 3, 4, 5, 6] and said.to_pylist()[0] == "aaaa"


def test_positions_are_the_first():
    said, known = pa.array(["b", "x", "a", "b"]), pa.array(["a", "b", "b", "c"])
    assert positions(said, known).tolist() == [1, -1, 0, 1]
    assert positions(said, known.slice(0, 0)).tolist() == [-1] * 4
    assert positions(said.slice(0, 0), known).tolist() == []
