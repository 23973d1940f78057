"""Cases that break counts, bounds or linear time: colliding hashes, repeated ids, long runs, missing ids."""

from __future__ import annotations

import math
import random
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placelens.llm import fingerprints, languages, near_dups, quality, secrets
from placelens.llm.common import materialise
from placelens.llm.queries import op5_secret_scan, op10_quality_rules
from test_registered import WORD, base_counts

# Two windows that share the upper 40 bits of their hash, around a repeated one.
COLLIDING = "a b w652977 p1 p2 p3 a b w674282 q1 q2 q3 a b w652977"


def test_repeats_with_colliding_windows(spark):
    random.seed(3)
    long = " ".join(f"w{random.randrange(900_000)}" for _ in range(400_000))
    texts = [COLLIDING, " ".join(reversed(COLLIDING.split())), f"{long} {COLLIDING} {long[:200_000]} x {COLLIDING}", "a " * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counted = quality.with_counts(docs, "text").select("doc_id", "n_words", "n_repeat_words").collect()
    assert {r.doc_id: (r.n_words, r.n_repeat_words) for r in counted} == {
        i: (base_counts(t)[0], base_counts(t)[4]) for i, t in enumerate(texts)
    }
    assert base_counts(COLLIDING)[4] == 6


def signed_hash(data: bytes, seed: int = 42) -> int:
    value = xxhash.xxh64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value


def test_longer_runs_come_from_shorter_ones(spark):
    """Values are those of plain hashes, and no lambda looks a neighbour up by its place."""
    rows = [[1, 2, 3, 4], [5, 6], [7], [], [1, 1, 1, 1]]
    runs = quality._with_runs(spark.createDataFrame([(r,) for r in rows], "_hashes array<bigint>"), 3)
    assert "get(" not in runs._jdf.queryExecution().optimizedPlan().toString()
    two = lambda a, b: signed_hash(struct.pack("<q", b), signed_hash(struct.pack("<q", a)) % (1 << 64))
    for r in runs.collect():
        pairs = [two(a, b) for a, b in zip(r[0], r[0][1:])]
        assert (r["_runs2"], r["_runs3"]) == (pairs, [two(p, c) for p, c in zip(pairs, r[0][2:])])


def test_quality_ratio_of_the_query(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}

    def grams(text):
        one = [signed_hash(w.encode()) for w in WORD.findall(text)]
        packed = [h.to_bytes(8, "little", signed=True) for h in one]
        two = [signed_hash(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(packed, packed[1:], strict=False)]
        return [h % quality.BUCKETS for h in one + two]

    hashed = {i: grams(t) for i, t in texts.items()}
    raw = Counter(g for found in hashed.values() for g in found)
    trusted = Counter(g for i, found in hashed.items() if i in good for g in found)
    scale, s = trusted.total() / raw.total(), quality.SMOOTHING
    for r in op10_quality_rules(spark, folder).collect():
        found = [math.log((trusted[g] + s) / (raw[g] * scale + s)) for g in hashed[r.doc_id]]
        assert r.llr == pytest.approx(sum(found) / max(1, len(found)), abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_the_language_sample_is_bounded(spark):
    same = spark.range(30_000).select(F.lit(5).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    ids = spark.range(9_000).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit("ein text "), "id").alias("text"))
    one_id = spark.range(9_000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("otro texto "), "id").alias("text"))
    docs = same.unionByName(ids.withColumn("lang", F.lit("de"))).unionByName(one_id.withColumn("lang", F.lit("es")))
    docs = docs.unionByName(spark.range(1).select(F.lit(None).alias("doc_id"), F.lit("x").alias("text"), F.lit(None).alias("lang")))
    found = Counter(r.lang for r in languages.training_sample(docs, "doc_id", "text", "lang", 2400).collect())
    assert found == {"en": 1, "de": 800, "es": 800}
    many = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "string(id % 500) AS lang")
    assert languages.training_sample(many, "doc_id", "text", "lang", 600, languages=100).count() == 600


def test_nearest_centroid(docs):
    """The prediction against a plain TF-IDF and cosine over the same counts."""
    model = languages.fit_languages(docs, "doc_id", "text", "lang", F.lit(True))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 5)) for r in languages.identify_languages(docs, "doc_id", "text", model).collect())
    counter, expected = languages.NgramCounter(languages.BINS), Counter()
    for (i, text), n in texts.items():
        counts = counter.counts(text)
        if counts is None:
            expected[(i, "und", 0.0)] += n
            continue
        weights = [math.log1p(c) * float(w) for c, w in zip(counts, model.idf, strict=True)]
        norm = math.sqrt(math.fsum(w * w for w in weights))
        alike = [math.fsum(w * float(x) for w, x in zip(weights, c, strict=True)) / norm for c in model.centroids]
        best = max(range(len(alike)), key=lambda j: (alike[j], -j))
        expected[(i, model.languages[best], round(min(1.0, max(0.0, alike[best])), 5))] += n
    close = sorted(got.elements(), key=repr), sorted(expected.elements(), key=repr)
    for a, b in zip(*close, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 2e-5


def test_plain_counts_of_ngrams():
    text = "Ab, c\U00010400 12 é"
    stream = " ab c\U00010428 é"
    grams = [stream[i : i + n] for n in (1, 2, 3) for i in range(len(stream) - n + 1) if i + n > 1]
    counts = languages.NgramCounter(4096).counts(text)
    assert counts.sum() == len(grams)
    assert np.count_nonzero(counts) <= len(set(grams))


PREFIXES = ["eyJ", "eyJ-", "eyJ.", "password", "token ", "api_key: ", "AKIA", "AKI", "0123456789abcde ", "ghp_", "xoxb-", "AIza"]
PREFIXES += ["-----BEGIN ", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nAAAAAAAAAAAAAAAA\n", "PRIVATE KEY", "-", "A", " "]


def test_patterns_are_linear(spark):
    """A megabyte of each beginning of a pattern; a matcher that goes back over it needs minutes."""
    spark.createDataFrame([("b", "x")], "blob string, text string").select(secrets._hits(F.col("text"), 0, secrets.RULES[0])).collect()
    for prefix in PREFIXES:
        text = prefix * (1_000_000 // len(prefix))
        blobs = spark.createDataFrame([("b", text)], "blob string, text string")
        start = time.perf_counter()
        secrets.scan_blobs(blobs).select(F.size("hits")).collect()
        assert time.perf_counter() - start < 20, prefix[:30]


def test_tokens_inside_runs_do_not_count(spark):
    token = "eyJhbGciOi.eyJzdWIiOjEyMzQ1Njc4OTAifQ.abc_-x"
    texts = [token, f"é{token}", f"x{token}", f"-{token}", f".{token} {token}.", f"({token})"]
    blobs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "blob string, text string")
    rule = next(i for i, r in enumerate(secrets.RULES) if r.kind == "jwt")
    found = {r.blob: r.hits for r in secrets.scan_blobs(blobs).collect()}
    assert [sum(h.rule == rule for h in found[str(i)]) for i in range(6)] == [1, 1, 0, 0, 2, 1]


def test_the_second_version_scans_nothing(spark, folder, monkeypatch):
    """The registered query records its table twice; the second time every blob is known."""
    scanned, scan = [], secrets.scan_blobs

    def counted(blobs, rules=secrets.RULES):
        out = materialise(scan(blobs, rules))
        scanned.append(out.count())
        return out

    monkeypatch.setattr(secrets, "scan_blobs", counted)
    op5_secret_scan(spark, folder).count()
    texts = spark.read.parquet(f"{folder}/documents.parquet").select(F.coalesce("text", F.lit(""))).distinct().count()
    assert scanned == [texts, 0]


def test_near_copies_without_ids(spark, monkeypatch):
    """Rows without ids meet their own text only, so the whole sets read grow in proportion."""
    read, whole = [], near_dups._whole_sets

    def counted(*arguments):
        out = materialise(whole(*arguments))
        read.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "_whole_sets", counted)
    body = [f"word{i}" for i in range(200)]
    rows = [(None, " ".join([*body[:i], "changed", *body[i + 1 :]])) for i in range(150)]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 3, 85).collect()
    assert read == [150] and len(found) == 150 and sum(r.kept for r in found) == 1


def test_a_missing_id_is_not_a_dash(spark):
    rows = [("-", "one two three"), (None, "one two three"), ("x", "four five six seven eight nine")]
    found = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_chars) for r in found), key=repr) == [("-", 13), ("x", 30), (None, 13)]
