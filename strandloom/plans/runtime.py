"""Session, shared folders and materialised intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine is written for; a cluster's own come first.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "strandloom", **settings: str) -> SparkSession:
    """The active session or a new one, with SETTINGS."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


@lru_cache(1)
def _local_folder() -> str:
    """A folder of this process, removed at its end."""
    base = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(base, exist_ok=True)
    folder = tempfile.mkdtemp(dir=base)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; a local one is used only where a local session has none. What is written there is
    for the owner of that folder to remove, as results may still be read from it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{_local_folder()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read again, so later jobs neither recompute it nor depend on an executor's disk. replaces: a materialised
    table of which nothing is read any more once df is written; its folder is removed."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    if replaces is not None:
        remove_folder(df.sparkSession, replaces._folder)
    return out


def added(df: DataFrame, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """df written beside what a table that this gave before holds: df read again, and the table with it. What is known is not written again, so the rounds
    of a search write what they find."""
    spark = df.sparkSession
    folder = shared_folder(spark) if table is None else table._folder
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    every = spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(folder)
    every._folder = folder
    return spark.read.schema(df.schema).parquet(path), every


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever Spark can write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
