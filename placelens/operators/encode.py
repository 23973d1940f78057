"""Turn texts into vectors with a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.functions.text import clean_text

Encoder = Callable[[list[str]], np.ndarray]
# Words of a profile that an encoder gets at a time.
PIECE_WORDS = 256


class HashingEncoder:
    """Signed token counts in a fixed number of buckets; needs no model file.

    Vectors are sums over tokens, so the vector of a joined text is the sum of
    its parts' vectors.
    """

    def __init__(self, dim: int = 384):
        self.dim = dim
        self.known: dict[str, tuple[int, int]] = {}

    def bucket(self, token: str) -> tuple[int, int]:
        """Bucket and sign of a token; recent ones are remembered."""
        found = self.known.get(token)
        if found is None:
            digest = hashlib.md5(token.encode()).hexdigest()
            found = int(digest[:8], 16) % self.dim, 1 if digest[8] < "8" else -1
            if len(self.known) >= 1 << 18:
                self.known.clear()
            self.known[token] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.dim))
        for row, text in zip(rows, texts):
            for token in _TOKEN.findall(text.lower()):
                at, sign = self.bucket(token)
                row[at] += sign
        return rows


_TOKEN = re.compile(r"\b\w\w+\b")


def encode(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    batch_size: int = 32,
    out: str = "embedding",
) -> DataFrame:
    """Replaces the text column by its vector; a null text counts as ''.

    The encoder is made once per task and gets `batch_size` texts at a time.
    """
    kept = [c for c in df.columns if c != text]
    schema = T.StructType(
        [*[df.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.FloatType()))]
    )

    def run(batches):
        encoder = make_encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            parts = [encoder(texts[at : at + batch_size]) for at in range(0, len(texts), batch_size)]
            vectors = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, 1), np.float32)
            width = vectors.shape[1]
            offsets = pa.array(np.arange(0, width * len(texts) + 1, width, dtype=np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(run, schema)


def pool_vectors(vectors: DataFrame, key: str, embedding: str = "embedding", weight: str | None = None) -> DataFrame:
    """Mean vector per key, by `weight` if given; sums combine before the shuffle, so a large key is no heavier than others."""
    weights = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    mean = Summarizer.mean(array_to_vector(F.col(embedding).cast("array<double>")), weights)
    return vectors.groupBy(key).agg(vector_to_array(mean).alias(embedding))


def profile_pieces(reviews: DataFrame, place: str, text: str, words: int = PIECE_WORDS) -> DataFrame:
    """(place, text, words): the cleaned profile of a place in pieces of at most `words` words, each with its count.

    Reviews are cleaned first, so links, mentions and tags are in no piece, and cut where they lie. A null
    text, and one of which nothing is left, gives an empty piece, so its place keeps a vector.
    """
    cleaned = reviews.select(F.col(place), clean_text(F.col(text)).alias("_clean"))
    split = cleaned.withColumn("_words", F.split("_clean", " "))
    starts = F.sequence(F.lit(1), F.size("_words"), F.lit(words))
    cut = split.select(place, "_words", F.explode(starts).alias("_at"))
    piece = cut.select(place, F.slice("_words", F.col("_at"), words).alias("_piece"))
    return piece.select(place, F.array_join("_piece", " ").alias(text), F.size("_piece").alias("words"))


def encode_places(
    reviews: DataFrame,
    place: str,
    text: str,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    words: int = PIECE_WORDS,
    additive: bool = True,
) -> DataFrame:
    """One vector per place, from its whole cleaned profile, which is never held in one row.

    The profile is encoded in pieces (see profile_pieces) and pooled. With an
    additive encoder (its vectors are sums over tokens) the mean over pieces
    points the way the joined profile does; others count by their words.
    """
    vectors = encode(profile_pieces(reviews, place, text, words), text, make_encoder)
    return pool_vectors(vectors, place, weight=None if additive else "words")
