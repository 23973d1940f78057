"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.llm.common import hash_key, materialise, text_of

# Hash bins of character n-grams of one to three letters.
BINS = 4096
# Centroids per language.
CENTROIDS = 3
# At most so many labelled documents fit the centroids, the same number of each language.
SAMPLE_ROWS = 2400
# Only so many languages, those with the most labelled documents, are learned.
MOST_LANGUAGES = 200
# Characters counted in one go.
SLICE_CHARS = 1 << 19
UNKNOWN = "und"


class NgramCounter:
    """Counts hashed n-grams of a text's letters; everything between letters is one space."""

    def __init__(self, bins: int) -> None:
        self.bins = bins
        self.shift = np.uint32(32 - (bins.bit_length() - 1))
        self.letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])

    def _is_letter(self, codes: np.ndarray) -> np.ndarray:
        low = codes < (1 << 16)
        found = self.letters[np.where(low, codes, 0)]
        for code in np.unique(codes[~low]):
            found |= (codes == code) & chr(code).isalpha()
        return found

    def counts(self, text: str | None) -> np.ndarray | None:
        """Counts per bin of the whole text; None without any letter."""
        total, letters = np.zeros(self.bins, dtype=np.int64), False
        text = (text or "").lower()
        # The last codes of what was counted: n-grams that end in a slice are counted with it.
        carried, after_letter = np.full(1, 32, dtype=np.uint32), False
        for at in range(0, len(text), SLICE_CHARS):
            codes = np.frombuffer(text[at : at + SLICE_CHARS].encode("utf-32-le", "replace"), dtype="<u4")
            is_letter = self._is_letter(codes)
            letters = letters or bool(is_letter.any())
            kept = is_letter | np.r_[after_letter, is_letter[:-1]]
            new = np.where(is_letter, codes, 32).astype(np.uint32)[kept]
            stream, after_letter = np.r_[carried, new], bool(is_letter[-1])
            one = stream * np.uint32(0x9E3779B1)
            two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + stream[1:] * np.uint32(0x85EBCA6B)
            three = two[:-1] * np.uint32(0xC2B2AE35) + stream[2:] * np.uint32(0x27D4EB2F)
            for grams in (one[len(carried) :], two[len(carried) - 1 :], three):
                mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                total += np.bincount(mixed >> self.shift, minlength=self.bins)
            carried = stream[-2:]
        return total if letters else None


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def cluster(vectors: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out first centroids; the same rows give the same centroids."""
    centroids = unit(vectors.mean(axis=0, keepdims=True))
    while len(centroids) < min(k, len(vectors)):
        nearest = (vectors @ centroids.T).max(axis=1)
        centroids = np.vstack([centroids, vectors[nearest.argmin()]])
    for _ in range(turns):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        members = [vectors[nearest == c] for c in range(len(centroids))]
        centroids = unit(np.array([m.mean(axis=0) if len(m) else centroids[c] for c, m in enumerate(members)]))
    return centroids


@dataclass
class LanguageModel:
    """Inverse document frequencies, unit centroids with their languages, and the least similarity each accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[str, float, bool]:
        similar = self.centroids @ self.weigh(counts)
        best = int(similar.argmax())
        return self.languages[best], float(np.clip(similar[best], 0, 1)), bool(similar[best] < self.least[best])


def fit(rows: list[tuple[str, np.ndarray]], k: int = CENTROIDS) -> LanguageModel | None:
    """A model from (language, counts)."""
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    names = np.array([r[0] for r in rows])
    counts = np.array([r[1] for r in rows])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(np.log1p(counts).astype(np.float32) * idf)
    centroids, languages, least = [], [], []
    for name in sorted(set(names)):
        own = vectors[names == name]
        found = cluster(own, k)
        similar = own @ found.T
        for c in range(len(found)):
            members = similar[similar.argmax(axis=1) == c, c]
            # Half the similarity of the least typical member: farther away is no known language.
            least.append(members.min() / 2 if len(members) else 0.0)
        centroids.append(found)
        languages += [name] * len(found)
    return LanguageModel(idf, np.vstack(centroids), languages, np.array(least))


def training_sample(
    docs: DataFrame, id_column: str, text_column: str, lang_column: str, rows: int, languages: int = MOST_LANGUAGES
) -> DataFrame:
    """(lang, text): at most `rows` documents in all, the same number of each language, by a hash of id and text.

    Equal texts of one id count once. Distinct hashes are counted per language by
    sketches, which combine; a scan then lets about twice the wanted share of each
    language pass, and only these few are put in order. At most `languages` languages
    are learned, those with the most documents (ties by name). Null ids are an id; rows without
    language are left out.
    """
    lang, text = F.col(lang_column).cast("string").alias("lang"), text_of(F.col(text_column)).alias("text")
    keyed = docs.select(lang, text, F.col(id_column).alias("id")).filter("lang IS NOT NULL")
    keyed = keyed.select("lang", "text", hash_key(F.lit("language sample"), F.col("id"), F.col("text")).alias("key"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.count(F.lit(1)).alias("all"))
    sizes = materialise(sizes.orderBy(F.desc("all"), "lang").limit(languages))
    each = max(1, rows // max(1, sizes.count()))
    cuts = sizes.select("lang", F.least(F.lit(1.0), 2.0 * each / F.col("n")).alias("share"))
    passed = keyed.join(F.broadcast(cuts), "lang").filter(F.col("key") / float(1 << 63) <= F.col("share"))
    distinct = passed.groupBy("lang", "key").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return distinct.withColumn("place", place).filter(F.col("place") <= each).select("lang", "text")


def fit_languages(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    lang_column: str,
    train: Column,
    rows: int = SAMPLE_ROWS,
    k: int = CENTROIDS,
    bins: int = BINS,
) -> LanguageModel | None:
    """Fit on a bounded sample of the rows that `train` picks and that have a text and a language.

    Tasks count n-grams; the driver clusters the sample, `rows` vectors of `bins` counts at most. Texts
    without a letter fit nothing; without any row there is no model.
    """
    labelled = docs.filter(train & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    sample = training_sample(labelled, id_column, text_column, lang_column, rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = NgramCounter(bins)
        for batch in batches:
            found = [(lang.as_py(), counter.counts(text.as_py())) for lang, text in zip(*batch.columns, strict=True)]
            found = [(lang, c) for lang, c in found if c is not None]
            names = pa.array([lang for lang, _ in found], pa.string())
            counts = pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())
            yield pa.RecordBatch.from_arrays([names, counts], ["lang", "counts"])

    found = sample.mapInArrow(counted, "lang string, counts binary").collect()
    return fit([(r["lang"], np.frombuffer(r["counts"], dtype=np.int32)) for r in found], k)


def identify_languages(
    docs: DataFrame, id_column: str, text_column: str, model: LanguageModel | None, bins: int = BINS
) -> DataFrame:
    """One row per document: its id, lang_pred, score (cosine, 0 to 1), rejected.

    The whole text alone is judged. `rejected` marks texts farther from their
    nearest centroid than any training text was, twice over; their lang_pred is
    still the nearest language. One scan; the model, a few hundred kilobytes,
    travels with the tasks.

    A text that is null or has no letter, and any text if there is no model, is
    `und` with score 0 and rejected. Equal similarities go to the first language
    by name. Repeated rows give repeated results, an empty table an empty one, a
    null id stays null; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_column]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = NgramCounter(bins)
        for batch in batches:
            out = []
            for text in batch.column(1):
                counts = counter.counts(text.as_py())
                out.append((UNKNOWN, 0.0, True) if counts is None or model is None else model.nearest(counts))
            names, scores, rejected = zip(*out, strict=True) if out else ([], [], [])
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_column, "lang_pred", "score", "rejected"])

    chosen = docs.select(id_column, F.col(text_column).cast("string"))
    return chosen.mapInArrow(judged, f"`{id_column}` {kind}, lang_pred string, score double, rejected boolean")
