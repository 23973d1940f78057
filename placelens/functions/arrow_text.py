"""Text steps of `text.py` on Arrow arrays, for Python workers; a test compares both on every character."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Letters, digits and the blanks of text.BLANK, as RE2 writes them.
_OTHER = (
    r"[^a-z0-9\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# Text that is split at a time, in bytes, which bounds the memory of its words.
SLICE_BYTES = 4 << 20


def keyword_texts(texts: pa.Array) -> pa.Array:
    """clean_keywords on an array."""
    try:
        lowered = pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        raw = texts.cast(pa.large_binary()).to_pylist()
        decoded = [t if t is None else t.decode(errors="replace") for t in raw]
        lowered = pc.utf8_lower(pa.array(decoded, texts.type))
    return pc.replace_substring_regex(lowered, _OTHER, "")


def text_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All words of an array of texts, and the row of each; a null text has none."""
    trimmed = pc.utf8_trim_whitespace(texts)
    split = pc.utf8_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, trimmed.type), trimmed))
    sizes = split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(texts)), sizes), split.flatten()


def text_slices(batch: pa.RecordBatch, text: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many bytes of text, and of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    starts = np.flatnonzero(np.diff(before // most_bytes, prepend=-1))
    for at, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(at, end - at)


def map_slices(
    df: DataFrame, text: str, schema: T.StructType | str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]
) -> DataFrame:
    """mapInArrow by slices of bounded text; `start()` makes a task's function of a slice.

    A batch is let go before the next one is read, so a worker holds one batch and the words of one slice.
    """

    def run(batches):
        step = start()
        for batch in batches:
            yield from map(step, text_slices(batch, text))
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def positions(said: pa.Array, known: pa.Array) -> np.ndarray:
    """The first place of each word among the known ones, -1 for others; the hash table is of the words said, the fewer."""
    coded = said.dictionary_encode()
    at = pc.index_in(known.cast(said.type), value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
    # From the last to the first, as the later of two writes stays.
    found = np.flatnonzero(at >= 0)[::-1]
    place = np.full(len(coded.dictionary), -1)
    place[at[found]] = found
    return place[coded.indices.to_numpy(zero_copy_only=False)]


def lists_by_row(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    """One list for each of so many rows, from values in the order of their rows."""
    ends = np.cumsum(np.bincount(row, minlength=rows), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
