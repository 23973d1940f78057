"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelens.session import discard, materialise

__all__ = ["discard", "hash_key", "materialise", "md5_key", "numbered", "ranked", "read_table", "text_of", "words_of"]

# Rows that one window task sorts, about.
ROWS_PER_BUCKET = 250_000
# So many buckets at least, to have work for all cores.
LEAST_BUCKETS = 64


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text: what lies between spaces, once the controls 9 to 13 are spaces too.

    Plain scans; the four controls other than the line feed are rare, and looked for first.
    """

    def split(text: Column, controls: str) -> Column:
        for control in controls:
            text = F.replace(text, F.lit(control), F.lit(" "))
        return F.array_remove(F.split(text, " "), "")

    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), split(text, "\n\t\x0b\x0c\r")).otherwise(split(text, "\n"))


def hash_key(*columns: Column) -> Column:
    """A number of 63 bits, spread evenly."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def md5_key(text: Column) -> Column:
    """As hash_key, from the first 15 hex digits of an MD5, which SQL engines share."""
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("bigint") * 8


def bucket_bits(rows: int) -> int:
    return max(LEAST_BUCKETS, rows // ROWS_PER_BUCKET + 1).bit_length()


def ranked(
    df: DataFrame,
    group: str,
    key: str,
    rows: int,
    size: str | None = None,
    ties: list[str] | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add `_rank`, the place of a row in its group from 0, and with `size` also `_before`, the sizes ahead of it.

    Rows of a group are ordered by `key`, a number of 63 evenly spread bits, then
    by `ties`. A window never holds more than one bucket of a group (the rows of
    one range of keys), however large the group is, and running sums over the
    bucket counts give the offsets. `df` is read twice, so it should be stored;
    `group` holds no nulls. The columns of `per_group`, one row per group, come
    along with the offsets, so its join does not gather a group either.
    """
    dealt = df.withColumn("_bucket", F.shiftright(key, 63 - bucket_bits(rows)))
    sized = F.sum(size) if size else F.lit(0).cast("bigint")
    sums = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), sized.alias("_s"))
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        group,
        "_bucket",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n_ahead"),
        F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s_ahead"),
    )
    if per_group is not None:
        offsets = offsets.join(per_group, group)
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *(ties or []))
    out = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    if size:
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_sum", F.coalesce(F.sum(size).over(before), F.lit(0)))
    out = out.join(offsets, [group, "_bucket"]).withColumn("_rank", F.col("_n_ahead") + F.col("_inside"))
    if size:
        out = out.withColumn("_before", F.col("_s_ahead") + F.col("_sum"))
    return out.drop("_bucket", "_n_ahead", "_s_ahead", "_inside", "_sum")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows 0, 1, ... by `order`: range partitions numbered each for itself, plus their offsets.

    The only window over everything has one row per partition.
    """
    parts = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_PER_BUCKET + 1
    )
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(offsets, "_part")
        .withColumn(out, (F.col("_ahead") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_ahead")
    )
