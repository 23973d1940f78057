"""Merge staged reviews into the corpus, batch after batch."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placelens.functions import fixed_values as fixed
from placelens.operators.corpus import COPY, PLACES, combine
from placelens.operators.places import output_columns
from placelens.operators.skew import dense_index, first_copies, row_digest
from placelens.session import materialise, noted_folders, path_exists, remove_folders

# Digests of a batch (32 bytes each) that are broadcast.
MOST_SENT = 500_000


def digests(rows: DataFrame) -> DataFrame:
    """One fixed-size hash per place and text; nulls count as equal."""
    return rows.select(row_digest(COPY).alias("_digest")).distinct()


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows with a digest that is not among the seen ones; both hold a digest once, and `rows` is stored.

    Up to MOST_SENT rows, the seen digests are scanned where they lie, against a
    broadcast of the rows' own; a larger batch meets them in a shuffle.
    """
    if rows.limit(MOST_SENT + 1).count() > MOST_SENT:
        return rows.join(seen, "_digest", "left_anti")
    found = seen.join(F.broadcast(rows.select("_digest")), "_digest", "left_semi")
    return rows.join(F.broadcast(found), "_digest", "left_anti")


def merge_batch(seen: DataFrame, last: int, batch: DataFrame) -> DataFrame:
    """The rows of a batch whose place and text are not among the seen digests, numbered after `last`.

    Hashes find the new rows; only their texts are read again.
    """
    rows = combine(None, batch)
    fresh = materialise(unseen(materialise(first_copies(rows, PLACES)), seen))
    numbered = dense_index(fresh, ["_none", "_order"], "_number", last + 1, ties=("_tie",))
    which = ["_digest", "_tie"]
    found = rows.join(numbered.select(*which, "_number"), which).dropDuplicates(which)
    found = found.drop("Doc_ID").withColumnRenamed("_number", "Doc_ID")
    return output_columns(found, fixed.CORPUS_COLUMNS, {"Rating": "double"})


def read_corpus(spark: SparkSession, master: str, added: str, before: int | None = None) -> DataFrame:
    """The master table and the rows added by batches, optionally only those before a batch."""
    base = spark.read.parquet(master).select(*fixed.CORPUS_COLUMNS)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    extra = _batches(spark, added, columns, before)
    return base.unionByName(extra)


def start_merge(
    staging: DataFrame, master: str, added: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Merge every batch of a staging stream.

    A batch writes its own folder of the `added` table, of a table of digests
    beside it, and of one that holds the last number; it reads the digests of
    earlier batches and the number of the one before, never the corpus. So a
    batch that runs again after a failure gives the same rows once. The master
    is hashed once, and again only if its files have changed when a stream starts.
    """
    spark = staging.sparkSession
    _take_master(spark, master, added)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        seen = _batches(session, _digests(added), "_digest BINARY", number)
        last = session.read.parquet(f"{_numbers(added)}/batch={number - 1}").first()["last"]
        used: list[str] = []
        with noted_folders(used):
            merge_batch(seen, last, batch).write.mode("overwrite").parquet(f"{added}/batch={number}")
        remove_folders(session, used)
        new = session.read.parquet(f"{added}/batch={number}")
        digests(new).write.mode("overwrite").parquet(f"{_digests(added)}/batch={number}")
        _last_number(new, last).write.mode("overwrite").parquet(f"{_numbers(added)}/batch={number}")

    return (
        staging.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _digests(added: str) -> str:
    return f"{added}_digests"


def _numbers(added: str) -> str:
    return f"{added}_numbers"


def _last_number(rows: DataFrame, before: int) -> DataFrame:
    """One row: the largest Doc_ID, or the one before if there is none."""
    return rows.agg(F.coalesce(F.max("Doc_ID"), F.lit(before)).cast("bigint").alias("last"))


def _take_master(spark: SparkSession, master: str, added: str) -> None:
    """Batch -1: an empty folder of rows, the master's digests, and its last number with a mark of its files."""
    base = spark.read.parquet(master).select(*fixed.CORPUS_COLUMNS)
    mark = sha256("\n".join(sorted(base.inputFiles())).encode()).hexdigest()
    number = f"{_numbers(added)}/batch=-1"
    if path_exists(spark, f"{number}/_SUCCESS") and spark.read.parquet(number).first()["files"] == mark:
        return
    base.limit(0).write.mode("overwrite").parquet(f"{added}/batch=-1")
    digests(base).write.mode("overwrite").parquet(f"{_digests(added)}/batch=-1")
    _last_number(base, 0).withColumn("files", F.lit(mark)).write.mode("overwrite").parquet(number)


def _batches(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    """A table written batch by batch, optionally only the batches before one."""
    table = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    return (table if before is None else table.filter(F.col("batch") < before)).drop("batch")
