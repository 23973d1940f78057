"""Importance resampling towards a target text: bucket gains score documents, a Gumbel draw takes the highest."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.llm.common import ROWS_PER_BUCKET, materialise, numbered, text_of

BUCKETS = 10_000
# Features are all runs of up to so many words.
LONGEST_RUN = 1
# Documents with fewer words are never drawn; so many percent of the others are.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Bytes cut into words in one go.
SLICE_BYTES = 1 << 20
# So few remaining keys are sorted outright.
LAST_KEYS = 4096

# Lower-cases A-Z and makes all other bytes below 128 than digits and letters a space; the bytes of
# any character beyond 127 stay.
_CLEAN = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def word_slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, about a megabyte at a time: runs of 0-9, a-z (A-Z lower-cased) and characters beyond 127."""
    data = text.encode("utf-8", "surrogatepass").translate(_CLEAN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield words
        at = end


def feature_buckets(text: str, buckets: int, longest: int) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to `longest` words, joined by a space, slice by slice."""
    carried: list[bytes] = []
    for words in word_slices(text):
        yield np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
        both = carried + words
        for n in range(2, longest + 1):
            # Runs that end in this slice.
            firsts = range(max(0, len(carried) - n + 1), len(both) - n + 1)
            runs = [crc32(b" ".join(both[i : i + n])) for i in firsts]
            yield np.array(runs, np.int64) % buckets
        carried = both[len(both) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text_column: str, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Features per bucket over all texts. A task sends a number per bucket at most, the driver gets `buckets` numbers.

    Null texts and texts without words add nothing; an empty table counts 0 everywhere.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in feature_buckets(text.as_py(), buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    found = texts.select(text_of(F.col(text_column)).alias("text")).mapInArrow(counted, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the log of its share in the target over its share in the raw texts, by add-one, in floored thousandths."""
    raw, target, n = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((target + 1) * (raw.sum() + n) / ((raw + 1) * (target.sum() + n)))).astype(np.int64)


def score_documents(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    gains: np.ndarray,
    longest: int = LONGEST_RUN,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight (floored mean gain) and score (weight plus Gumbel noise).

    The gains, an array of a number per bucket, travel with the tasks. The noise
    comes from a digest of the id, so reruns agree. A null or empty text has no
    features and weight 0; a null id draws as an empty one; rows of one id have
    the same noise. Other columns are not read.
    """
    kind, buckets = dict(docs.dtypes)[id_column], len(gains)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n = words = total = 0
                for i, found in enumerate(feature_buckets(text.as_py(), buckets, longest)):
                    n += len(found)
                    words += len(found) if i % longest == 0 else 0
                    total += int(gains[found].sum())
                rows.append((words, n, total // n if n else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col(id_column).alias("doc_id"), text_of(F.col(text_column)).alias("text"))
    scored = chosen.mapInArrow(weighed, f"doc_id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = (F.conv(F.left(F.sha2(name, 256), F.lit(8)), 16, 10).cast("bigint") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(drawn))).cast("bigint")
    return scored.withColumn("score", F.col("weight") + noise)


# Best first: the score downwards, then the smaller id, a missing one last; a stored number parts rows that are alike.
ORDER = ["loss", "no_id", "doc_id", "salt"]


def _key() -> Column:
    return F.struct(*ORDER)


def sorted_parts(rows: DataFrame, n: int) -> DataFrame:
    """Stored rows, each with its part and its position in the order of that part, from 0.

    Parts are dealt by a hash, so they are even and each a fair sample; a file is sorted, so that later
    filters on `loss` read only what remains.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_PER_BUCKET + 1)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("salt"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*ORDER)) - 1
    return materialise(dealt.withColumn("position", place.cast("bigint")))


def _literal(rows: DataFrame, key: dict) -> Column:
    return F.struct(*[F.lit(key[f]).cast(dict(rows.dtypes)[f]).alias(f) for f in ORDER])


def cutoff(rows: DataFrame, n: int, wanted: int, last: int = LAST_KEYS) -> dict:
    """The key of the `wanted`-th of `n` rows of `sorted_parts`, in `ORDER`; 1 <= wanted <= n.

    Weighted median of medians: what remains of a part is a run of positions, so
    its median is one of its rows. The median of these, weighted by how many rows
    remain in their parts, has at least a quarter of all remaining rows on either
    side, and counting those up to it tells which side goes. One key a round
    reaches the driver; at most `last` remaining keys are sorted outright.
    """
    low = high = None
    while True:
        left = rows
        if low is not None:
            left = left.filter((F.col("loss") >= low["loss"]) & (_key() > _literal(rows, low)))
        if high is not None:
            left = left.filter((F.col("loss") <= high["loss"]) & (_key() <= _literal(rows, high)))
        if n <= last:
            return left.orderBy(*ORDER).select(*ORDER).take(wanted)[-1].asDict()
        parts = left.groupBy("part").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
        middle = F.col("first") + F.floor((F.col("n") - 1) / 2)
        medians = left.join(parts.select("part", middle.alias("position"), "n"), ["part", "position"])
        so_far = F.sum("n").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
        pivot = medians.withColumn("so_far", so_far).filter(2 * F.col("so_far") >= n).orderBy(*ORDER).select(*ORDER).first()
        upto = left.filter((F.col("loss") <= pivot["loss"]) & (_key() <= _literal(rows, pivot.asDict()))).count()
        if wanted == upto:
            return pivot.asDict()
        if wanted < upto:
            high, n = pivot.asDict(), upto
        else:
            low, n, wanted = pivot.asDict(), n - upto, wanted - upto


def draw_documents(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """All rows of `score_documents` with rank: 1, 2, ... by falling score for the drawn ones, else null.

    Of the N rows with `least_words` words or more, floor(percent * N / 100) are
    drawn. Ties go to the smaller id, a missing id last; rows that are equal in
    both are drawn in any order. Only the drawn rows are sorted, in ranges. With nothing to
    draw, and in an empty table, no row has a rank.
    """
    rows = scored.withColumn("loss", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull())
    rows = materialise(rows.withColumn("salt", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count()
    wanted = percent * n // 100
    if not wanted:
        return rows.select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    bound = _literal(rows, cutoff(sorted_parts(able.select(*ORDER), n), n, wanted))
    drawn = F.coalesce((F.col("n_words") >= least_words) & (_key() <= bound), F.lit(False))
    ranked = numbered(rows.filter(drawn), ORDER, "rank").withColumn("rank", F.col("rank") + 1)
    others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).select(*scored.columns, "rank")
