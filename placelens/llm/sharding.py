"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.llm.common import LEAST_BUCKETS, hash_key, materialise, ranked, text_of

# Rows of a partition, about: the local permutation sorts so many.
ROWS_PER_PART = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows out of good + bad are good; exact, for numbers of any size.

    Weights follow from the mode outwards by their ratios, as far as they
    matter, and are normalised by their own sum.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    mode = min(max(mode, low), high)
    total = good + bad
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(14 * spread) + 32
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.r_[fall[::-1], 1.0, rise]
    place = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return mode - len(fall) + int(min(place, len(weights) - 1))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard in a uniform shuffle; rows and columns add up exactly."""
    rng, room, matrix = np.random.default_rng(seed), list(shards), []
    for n in rows:
        left, rest, line = n, sum(room), []
        for shard, free in enumerate(room):
            rest -= free
            got = hypergeometric(rng, free, rest, left)
            line.append(got)
            room[shard] -= got
            left -= got
        matrix.append(line)
    return matrix


def shuffle_to_shards(
    docs: DataFrame, id_column: str, text_column: str, shards: int, seed: int = 0, carry: bool = False
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (and, with `carry`, `_row`).

    Shard sizes differ by one row at most. Rows are dealt to partitions by a
    hash, so a rerun agrees whatever the files' layout. The driver draws from
    the partitions' row counts how many rows each sends to each shard (the
    matrix is one line per million rows); every partition permutes its rows and
    deals them out by its line; shards permute what they got, bucket by bucket,
    which gives the slots from 0.

    The size is the text's UTF-8 bytes plus 1; a null text has none, and the
    checksum of an empty one. Rows alike in id, size and checksum are
    interchangeable. An empty table gives an empty one, a null id stays null;
    other columns are not read.
    """
    text = text_of(F.col(text_column))

    def key(step: str) -> Column:
        return hash_key(F.lit(step), F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("size"))

    rows = materialise(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            *([F.struct("*").alias("_row")] if carry else []),
        )
    )
    n = rows.count()
    parts = max(LEAST_BUCKETS, n // ROWS_PER_PART + 1)
    dealt = rows.withColumn("_part", F.pmod(key("part"), F.lit(parts)).cast("int"))
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    used = sorted(counts)
    matrix = communication_matrix([counts[p] for p in used], sizes, seed)
    # The places in a permuted partition at which the next shard begins.
    lines = [{"p": p, "ends": np.cumsum(line)[:-1].tolist()} for p, line in zip(used, matrix, strict=True)]
    plan = docs.sparkSession.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(lines)), "array<struct<p:int,ends:array<bigint>>>")).alias("line")
    )
    plan = F.broadcast(plan.select(F.col("line.p").alias("_part"), "line.ends"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key("permute"), "doc_id", "size")) - 1
    sent = dealt.withColumn("_place", place).join(plan, "_part")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("_place"))).cast("int")
    exchanged = materialise(
        sent.withColumn("shard", shard).withColumn("_key", key("permute again")).drop("_part", "_place", "ends")
    )
    slotted = ranked(exchanged, "shard", "_key", n, ties=["doc_id", "size"])
    return slotted.select(
        "doc_id", "size", "text_crc32", "shard", F.col("_rank").cast("bigint").alias("slot"), *(["_row"] if carry else [])
    )
