"""Building blocks that hold when one key has a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.session import materialise

# A side with at most this many rows and bytes may be broadcast.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 64 << 20
# A key with more than 1/HOT_SHARE of the rows is hot; fewer than HOT_SHARE keys can be.
HOT_SHARE = 10_000


def is_small(df: DataFrame) -> bool:
    """Counts rows and bytes, but never reads on beyond the row bound."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def skew_safe_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread: Column,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join a fact table to a table with few rows per key, whatever the share of the largest key.

    A dim of checked size is broadcast. Beyond that, the hot keys (fewer than
    HOT_SHARE, as their shares add up to 1) take their values from a broadcast,
    and their rows pass the shuffle spread over many partitions.
    `counts` is (key, _rows) if the caller has it already; `how` is inner or left.
    """
    if is_small(dim):
        return fact.join(F.broadcast(dim), key, how)
    if counts is None:
        counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        rows = fact.count()
    else:
        rows = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("_rows") * HOT_SHARE > rows).select(key)
    values = [c for c in dim.columns if c != key]
    hot_dim = dim.join(F.broadcast(hot), key, "left_semi").select(
        key, F.struct(F.lit(1).alias("_hit"), *values).alias("_hot")
    )
    # A hash of key and salt is the second join key: the optimizer would fold a bare constant salt away.
    cold_dim = dim.select(
        key,
        F.xxhash64(key, F.lit(0)).alias("_part"),
        F.struct(F.lit(1).alias("_hit"), *values).alias("_cold"),
    )
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int")
    )
    joined = (
        fact.join(F.broadcast(hot_dim), key, "left")
        .withColumn("_part", F.xxhash64(key, salt))
        .join(cold_dim, [key, "_part"], "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
    )
    if how == "inner":
        joined = joined.filter(F.col("_found").isNotNull())
    return joined.select(
        key, *[c for c in fact.columns if c != key], *[F.col(f"_found.{c}").alias(c) for c in values]
    )


def most_frequent(table: DataFrame, rows: str, size: Column, most_bytes: int) -> Column:
    """A condition on `rows`, how often a key occurs: it holds for the most frequent keys, of `most_bytes` at most in all.

    The cut lies between powers of 2 ** (1 / 8), so it comes from a few hundred sums, and no key is ranked.
    """
    level = F.floor(F.log2(rows) * 8)
    sums = table.groupBy(level.alias("_level")).agg(F.sum(size).alias("_bytes")).dropna().collect()
    left, least = most_bytes, None
    for found in sorted(sums, reverse=True):
        left -= found["_bytes"]
        if left < 0:
            break
        least = found["_level"]
    return F.lit(False) if least is None else F.coalesce(level >= least, F.lit(False))


def look_up(found: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of stored results to a table that may be far larger and has unique keys.

    Results of checked size are broadcast, and the table is scanned where it
    lies. Beyond that, the hot keys among the results (fewer than HOT_SHARE) are
    broadcast with their values, and the optimizer is free in joining the rest.
    """
    if is_small(found):
        return F.broadcast(found).join(table, key)
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.broadcast(counts.filter(F.col("_rows") * HOT_SHARE > found.count()).select(key))
    hot_table = F.broadcast(table.join(hot, key, "left_semi"))
    rest = found.join(hot, key, "left_anti").join(table, key)
    return found.join(hot, key, "left_semi").join(hot_table, key).unionByName(rest)


def assemble_lists(df: DataFrame, key: str, order: str, value: Column, ids_per_segment: int = 256) -> DataFrame:
    """Ordered list of values per key as (key, Segmen, values), in rows of bounded size.

    `order` is a number that is unique within a key. Every range of
    `ids_per_segment` order numbers is a row, whatever the size of the key;
    together, in Segmen order, they hold the whole list, and no task ever holds
    all rows of a large key. Rows without an order go by a hash of their value.
    """
    placed = df.select(key, F.col(order).alias("_order"), value.alias("_value"))
    place_in_order = F.coalesce("_order", F.pmod(F.xxhash64("_value"), F.lit(1 << 31)))
    collected = F.array_sort(F.collect_list(F.struct("_order", "_value")))
    return (
        placed.withColumn("Segmen", F.floor(place_in_order / ids_per_segment))
        .groupBy(key, "Segmen")
        .agg(F.transform(collected, lambda x: x["_value"]).alias("values"))
    )


def dense_index(
    df: DataFrame,
    order: list[str],
    out: str,
    start: int = 1,
    rows_per_bucket: int = 1_000_000,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Number all rows start, start+1, ... by `order`, without a window over the whole table.

    The last order column is a number, unique within the ones before it unless
    `ties`, of which the first is a digest, orders the rest. Rows whose group is
    null are numbered first. Rows are numbered inside buckets cut at percentiles
    of that column, those that lack it in ranges of the digest; a running sum over
    the bucket counts gives each bucket its offset.
    """
    *groups, last = order
    rows = df.count()
    buckets = rows // rows_per_bucket + 1
    if buckets == 1 and not groups:
        number = F.row_number().over(Window.orderBy(last, *ties)) + (start - 1)
        return df.withColumn("_n", number.cast("bigint")).select(
            *[c for c in df.columns if c != out], F.col("_n").alias(out)
        )
    bucketed = df.withColumn("_bucket", F.lit(0))
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = df.agg(F.percentile_approx(last, shares, max(10_000, 20 * buckets))).first()[0]
        cut = bucketed
        if cuts:
            splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
            cutter = Bucketizer(splits=splits, inputCol="_last", outputCol="_bucket")
            cut = cutter.transform(df.withColumn("_last", F.col(last).cast("double"))).drop("_last")
        bucketed = cut.withColumn(
            "_bucket",
            F.when(F.col(last).isNull(), _digest_range(ties[0] if ties else row_digest(df.columns), buckets) - buckets)
            .otherwise(F.col("_bucket"))
            .cast("int"),
        )
    parts = [*groups, "_bucket"]
    # One row per bucket, so this window stays small.
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(last, *ties))
    numbered = bucketed.withColumn("_inside", inside)
    same = reduce(and_, [numbered[c].eqNullSafe(offsets[c]) for c in parts])
    # The rows already lie by bucket, so the join to the offsets does not move them again.
    return numbered.join(offsets, same).select(
        *[numbered[c] for c in df.columns if c != out],
        (F.col("_offset") + F.col("_inside") + (start - 1)).alias(out),
    )


def _digest_range(digest: Column | str, ranges: int) -> Column:
    """Which of so many equal ranges, from 0, a digest lies in; they are in its order."""
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint")
    return F.shiftright(F.coalesce(head, F.lit(0)) * F.lit(ranges), 32)


def latest_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value with the highest order per key (largest value on ties); rows combine before the shuffle."""
    per_value = df.groupBy(key, value).agg(F.max(order).alias("_order"))
    return per_value.groupBy(key).agg(F.max(F.struct("_order", value))[value].alias(value))


def with_places(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Add a digest of the key, and what places a row: a missing order comes last, ties go by a digest of the row."""
    return df.withColumns(
        {"_digest": row_digest(key), "_none": F.col(order).isNull(), "_order": F.col(order), "_tie": row_digest(df.columns)}
    )


def first_copies(df: DataFrame, places: list[str]) -> DataFrame:
    """(digest, places) of the first row per digest.

    Copies collapse before the shuffle, and only fixed-size hashes and numbers move.
    """
    first = df.groupBy("_digest").agg(F.min(F.struct(*places)).alias("_first"))
    return first.select("_digest", "_first.*")


def row_digest(columns: list[str]) -> Column:
    """Fixed-size key of some columns; nulls count as equal."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def with_segments(dim: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Left join of a table to segment rows (key, Segmen, ...), of which one key may hold very many."""
    found = skew_safe_join(segments, dim, key, F.col("Segmen"))
    missing = dim.join(segments.select(key).distinct(), key, "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)
