"""Token ids and counts by the public tokenizers, in Arrow batches of bounded bytes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import text_of

BYTE_BPE = "byte_bpe_50k.json"
# Bytes of text that are encoded in one go, and the piece size into which longer texts are split.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

# Characters on which the two libraries are known to agree about letters, digits and white space,
# and which stand alone; other texts, and such with long runs of white space, go to `tokenizers`.
_OTHER = re.compile("[^\t\n\r -~¡-¬®-ſ–—‘-„…€]|[ \t\n\r]{256}")
# A space between two characters other than white space: the pre-tokenizer always cuts before it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a long text before single spaces, where byte-level BPE always cuts; a run without any stays whole.

    Special strings hold no space, so none is cut.
    """
    pieces, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    return [*pieces, text[start:]]


def size_batches(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` in sum."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def byte_batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each."""
    return size_batches([len(t) for t in texts], limit)


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids, without begin, end or added special tokens, for a .json or .model file."""
    many = batch_encoder(path)
    return lambda text: many([text])[0]


def batch_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """As `encoder`, for the texts of a batch together."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda texts: [np.array(ids, dtype=np.uint32) for ids in pieces.encode(texts, num_threads=1)]
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
    if plain and spec["model"]["type"] == "BPE" and not spec.get("normalizer"):
        return _byte_level_encoder(path, spec)
    return _own_encoder(path)


def _own_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """By `tokenizers`, of whose results no more than those of about a megabyte of text are held."""
    # A task has one core.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def encode(texts: list[str]) -> list[np.ndarray]:
        ids = []
        for start, end in size_batches([len(t.encode()) for t in texts]):
            found = own.encode_batch(texts[start:end], add_special_tokens=False)
            ids += [np.array(f.ids, dtype=np.uint32) for f in found]
        return ids

    return encode


def _byte_level_encoder(path: str, spec: dict) -> Callable[[list[str]], list[np.ndarray]]:
    """`tiktoken` merges by the same vocabulary several times faster than `tokenizers`.

    It takes all texts of common Latin characters; the pieces of the rest go to `tokenizers` itself, together.
    """
    import public_tokenizers
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of_char = {c: bytes([b]) for b, c in _byte_characters().items()}
    vocabulary = spec["model"]["vocab"].items()
    ranks = {b"".join(map(of_char.__getitem__, word)): i for word, i in vocabulary if word not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    other: list = []

    def encode(texts: list[str]) -> list[np.ndarray]:
        cut = [safe_pieces(text) for text in texts]
        rest = [i for i, text in enumerate(texts) if _OTHER.search(text)]
        if rest and not other:
            other.append(_own_encoder(path))
        own = iter(other[0]([p for i in rest for p in cut[i]]) if rest else ())
        slow = set(rest)
        ids = []
        for i, pieces in enumerate(cut):
            found = [next(own) if i in slow else fast.encode_to_numpy(p, allowed_special="all") for p in pieces]
            ids.append(found[0] if len(found) == 1 else np.concatenate(found))
        return ids

    return encode


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = sorted(set(range(256)) - set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def count_tokens(
    docs: DataFrame, id_column: str, text_column: str, tokenizer: str | None = None, limit: int = 1024
) -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, and over_limit (more than `limit` tokens).

    `tokenizer` is the path of a tokenizer file that all executors have. Texts
    pass to Python in Arrow batches, are encoded together in runs of about a
    megabyte, and only lengths come back; long texts are cut where a byte-level
    tokenizer would cut anyway. One scan, no shuffle.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated
    results, an empty table an empty one, a null id stays null; other columns
    are not read.
    """
    path = tokenizer or tokenizer_path(BYTE_BPE)
    kind = dict(docs.dtypes)[id_column]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in size_batches(sizes.tolist()):
                part = batch.column(1).slice(start, end - start).to_pylist()
                tokens = np.array([len(ids) for ids in encode(part)], dtype=np.int64)
                columns = [batch.column(0).slice(start, end - start), sizes[start:end], tokens, tokens > limit]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    [id_column, "n_bytes", "n_tokens", "over_limit"],
                )

    chosen = docs.select(id_column, text_of(F.col(text_column)).alias(text_column))
    return chosen.mapInArrow(counted, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
