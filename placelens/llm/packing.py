"""Best-fit packing of token pieces into sequences, planned on the histogram of their lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import hash_key, materialise, ranked, text_of
from placelens.llm.tokens import BYTE_BPE, byte_batches, encoder, tokenizer_path

LIMIT = 1024
# The id that ends every document.
END_ID = 2


class Run(NamedTuple):
    """The pieces of one length with ranks first .. first + count - 1, `per` to a sequence, from `offset` on."""

    length: int
    first: int
    count: int
    sequence: int
    per: int
    offset: int


def plan_best_fit(counts: Mapping[int, int], limit: int) -> list[Run]:
    """Best fit, longest first, over counts: sequences with the same room are one entry, however many they are.

    Fitting the n-th piece of a length takes the sequence with the least room
    that is enough, which is the one just used while it has room; so whole
    groups of sequences fill at once. Work and plan depend on the number of
    lengths (`limit`), not on that of the documents.
    """
    runs: list[Run] = []
    rooms: list[int] = []  # ascending rooms that open sequences have
    open_: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room: (first sequence, how many)
    made = 0

    def leave(room: int, sequence: int, n: int) -> None:
        if room and n:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((sequence, n))

    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, n = open_[room].popleft()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, sequence = limit, made
                n = -(-left // (limit // length))
                made += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append(Run(length, first, full * per, sequence, per, limit - room))
                leave(room - per * length, sequence, full)
                first, left = first + full * per, left - full * per
            if full < n and left:  # fewer than `per` are left
                runs.append(Run(length, first, left, sequence + full, left, limit - room))
                leave(room - left * length, sequence + full, 1)
                full, first, left = full + 1, first + left, 0
            leave(room, sequence + full, n - full)
    return runs


def token_pieces(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    tokenizer: str,
    limit: int = LIMIT,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids: one row per piece of a document.

    A document longer than `limit` is cut into pieces of `limit`, the first of
    which takes the remainder.
    """
    kind = dict(docs.dtypes)[id_column]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in byte_batches(texts):
                rows, numbers, starts, lengths, crcs, ids = [], [], [], [], [], []
                for row in range(low, high):
                    every = np.concatenate([encode(texts[row]), end]).astype("<u4")
                    cuts = [0, *range((len(every) - 1) % limit + 1, len(every) + 1, limit)]
                    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = every[a:b]
                        rows.append(row)
                        numbers.append(number)
                        starts.append(a)
                        lengths.append(b - a)
                        crcs.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs)],
                    *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_column).alias("doc_id"), text_of(F.col(text_column)).alias("text"))
    return chosen.mapInArrow(pieces, schema)


def pack_documents(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    tokenizer: str | None = None,
    limit: int = LIMIT,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it comes from (doc_id, piece, start, length, ids_crc32) and where it goes.

    The plan is made from how many pieces there are of each length, at most
    `limit` numbers; pieces then take the planned places by their rank within
    their length, in hashed order, counted bucket by bucket, so a length that
    most pieces share is spread as well. The plan has at most `limit` runs for
    each length and is broadcast.

    A null or empty text is the end id alone. Repeated rows are packed each for
    itself, an empty table gives an empty one, a null id stays null; other
    columns are not read.
    """
    path = tokenizer or tokenizer_path(BYTE_BPE)
    pieces = materialise(token_pieces(docs, id_column, text_column, path, limit, end_id, with_ids))
    keyed = pieces.withColumn("_key", hash_key(F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan_best_fit(counts, limit)
    schema = "length long, _first long, _count long, _sequence long, _per long, _offset long"
    plan = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in runs], schema))
    placed = ranked(keyed, "length", "_key", sum(counts.values()), ties=["doc_id", "piece"])
    taken = F.col("_rank") - F.col("_first")
    fits = (placed["length"] == plan["length"]) & (taken >= 0) & (taken < F.col("_count"))
    sequence = F.col("_sequence") + F.floor(taken / F.col("_per"))
    offset = F.col("_offset") + F.pmod(taken, F.col("_per")) * placed["length"]
    return placed.join(plan, fits).select(
        *[placed[c] for c in pieces.columns],
        sequence.cast("bigint").alias("sequence_id"),
        offset.cast("bigint").alias("offset"),
    )


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, and what lies where."""
    members = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id",
        F.flatten("m.ids").alias("ids"),
        F.transform("m", lambda x: F.struct(x["offset"], x["doc_id"], x["piece"])).alias("documents"),
    )
