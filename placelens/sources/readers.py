"""Readers. Parquet is the format for large tables; CSV cells may span lines, so a CSV file is one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.functions.text import trim_all
from placelens.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, doubled quotes, and cells that may hold line ends."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    return spark.read.schema(schema).options(**options).csv(path)


def read_table(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """A CSV or Parquet table, told apart by its name unless `kind` says so."""
    kind = kind or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    return read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).parquet(path)


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Spread a table read in fewer parts than there are cores; larger tables stay as they are.

    The key is unique, so the parts are even, and later groupings by it need no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def with_input_order(df: DataFrame, out: str = "seq") -> DataFrame:
    """Adds a number that grows in file order; apply right after reading."""
    return df.withColumn(out, F.monotonically_increasing_id())


def with_trimmed_key(df: DataFrame, key: str = "Nama_Tempat") -> DataFrame:
    return df.withColumn(key, trim_all(F.col(key)))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.REVIEWS)


def read_place_info(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PLACE_INFO)


def read_info_inputs(spark: SparkSession, static: str, prices: str, facilities: str) -> tuple[DataFrame, ...]:
    """The three inputs of the place info, with trimmed keys and input order."""
    inputs = ((static, schemas.STATIC_INFO), (prices, schemas.PRICES), (facilities, schemas.FACILITIES))
    return tuple(with_input_order(with_trimmed_key(read_table(spark, p, s))) for p, s in inputs)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The review corpus, or an empty one where there is none yet."""
    try:
        return read_reviews(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.REVIEWS)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their key and whatever metadata lies in the same table."""
    return spark.read.parquet(path)


def read_sql(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL over the given tables."""
    return spark.sql(query, **(views or {}))


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that an outside database runs; partitioning options make it a parallel read."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
