"""Take in raw reviews as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placelens.operators.corpus import SIGNATURE, review_rows
from placelens.operators.skew import row_digest

# State lies on the executors' disks and is saved as changes, so a batch reads and writes the keys of its own rows.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def first_seen(raw: DataFrame, keep_for: str | None = None) -> DataFrame:
    """The stream of distinct review rows: a row whose (rating, time, text) came before is dropped.

    The digests seen are Spark's keyed state. Which of several copies in one
    batch stays is left open. Without `keep_for` digests are kept for ever; with
    it (such as "90 days") for at least that long after a review was first
    taken in, by the clock of the batches, so no review is ever too late.

    A review that comes very often is dropped inside the Arrow batches of the
    scan first, so the task of its digest gets it once per batch.
    """
    rows = review_rows(raw).withColumn("_digest", row_digest(SIGNATURE))
    rows = rows.mapInArrow(_once_per_batch, rows.schema)
    if keep_for is None:
        return rows.dropDuplicates(["_digest"]).drop("_digest")
    rows = rows.withColumn("_taken", F.current_timestamp()).withWatermark("_taken", keep_for)
    return rows.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest", "_taken")


def _once_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        again = batch.column("_digest").to_pandas().duplicated()
        yield batch.filter(pa.array(~again.to_numpy()))


def start_ingest(
    raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, keep_for: str | None = None
) -> StreamingQuery:
    """Append distinct reviews to a Parquet table; by default takes what is there and stops.

    A batch meets only the state of its own digests, never the table or earlier
    batches, so its cost follows its own rows. It writes its own folder and can
    run again after a failure. Table and checkpoint belong together; the number
    of shuffle partitions is that of the first run.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = raw.sparkSession.conf
    ours = {key: value for key, value in STATE_SETTINGS.items() if conf.get(key, None) is None}
    try:
        for key, value in ours.items():
            conf.set(key, value)
        return (
            first_seen(raw, keep_for)
            .writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        # The started query has its own copy of the settings.
        for key in ours:
            conf.unset(key)


def read_reviews(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The reviews that all batches wrote, with the columns of the schema."""
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(path).drop("batch")
