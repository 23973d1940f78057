"""Session for local runs, and the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", partitions: int = 8, memory: str = "12g", settings: dict[str, str] | None = None
) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("placelens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    return builder.config(map=settings or {}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placelens-"))
    return spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]


_NOTED: ContextVar[list[str] | None] = ContextVar("noted_folders", default=None)


@contextmanager
def noted_folders(folders: list[str]) -> Iterator[None]:
    """Inside, every new folder is added to the list."""
    token = _NOTED.set(folders)
    try:
        yield
    finally:
        _NOTED.reset(token)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/placelens-{spark.sparkContext.applicationId}/"


def run_folder(spark: SparkSession) -> str:
    """A new folder inside the shared one; all those of an application lie together, for later removal."""
    folder = f"{_own_folder(spark)}{uuid.uuid4().hex}"
    noted = _NOTED.get()
    if noted is not None:
        noted.append(folder)
    return folder


def remove_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Remove folders that run_folder gave to this application, once nothing reads them any more."""
    own = _own_folder(spark).split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if own not in folder:
            raise ValueError(f"{folder} is not a folder of this application")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise stored. What was computed from them must be stored by then."""
    for table in tables:
        remove_folders(table.sparkSession, {file.rsplit("/", 1)[0] for file in table.inputFiles()})


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into a table of the shared folder.

    This cuts the lineage, survives lost executors, and tells the optimizer the real size.
    """
    path = run_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
