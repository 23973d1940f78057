"""Counts of words over a table of texts; a worker counts slices of its texts, so few rows per word leave it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.functions.arrow_text import keyword_texts, map_slices, text_words


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word, a part between blanks, occurs in all texts."""

    def count(part):
        _, said = text_words(part.column(0))
        return pa.RecordBatch.from_arrays(pc.value_counts(said).flatten(), names=["word", "n"])

    counted = map_slices(texts.select(text), text, "word string, n bigint", lambda: count)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def keyword_counts(texts: DataFrame, text: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """(word, n, *kinds): the number of texts with each word of their cleaned form, in all and of each of the kinds."""
    names, width, value_set = ["word", "n", *kinds], len(kinds) + 1, pa.array(kinds)

    def count(part):
        row, said = text_words(keyword_texts(part.column(text)))
        coded = said.dictionary_encode()
        word, size = coded.dictionary, max(1, len(coded.dictionary))
        # A word counts once per text. Sorting is far faster than np.unique here.
        pairs = np.sort(row * size + coded.indices.to_numpy(zero_copy_only=False))
        row, code = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], size)
        of = pc.index_in(part.column(kind), value_set=value_set.cast(part.schema.field(kind).type))
        of = of.fill_null(len(kinds)).to_numpy(zero_copy_only=False)
        tally = np.bincount(code * width + of[row], minlength=len(word) * width).reshape(len(word), width)
        found = [tally.sum(axis=1), *np.ascontiguousarray(tally.T[:-1])]
        return pa.RecordBatch.from_arrays([word, *map(pa.array, found)], names=names)

    schema = "word string, " + ", ".join(f"`{name}` bigint" for name in names[1:])
    counted = map_slices(texts.select(text, kind), text, schema, lambda: count)
    return counted.groupBy("word").agg(*[F.sum(name).alias(name) for name in names[1:]])
