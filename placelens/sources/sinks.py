"""Sinks. All of them write in parallel; nothing passes through the driver."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with header and doubled quotes; arrays and structs become JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").options(header=True, quote='"', escape='"', encoding="UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    write_parquet(df, path, "append")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, as for scorecards."""
    df.write.mode("overwrite").json(path)


def write_version(df: DataFrame, path: str, stamp: datetime | None = None) -> str:
    """A new version of a table beside the old ones, which stay as they are."""
    version = f"{path.rstrip('/')}/version={(stamp or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    df.write.mode("errorifexists").parquet(version)
    return version


def read_latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table written with write_version."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)]
    stamps = sorted(n for n in names if re.fullmatch(r"version=\d{8}_\d{6}", n))
    return spark.read.parquet(f"{path.rstrip('/')}/{stamps[-1]}")
