"""Stages of a run that can be resumed: each result is kept in a folder that all executors share, under a name that says what it was made of.

A stage is known by its name, its options and the stages and tables that it reads; tables from outside are known by their schema and content (rows and the sum of their hashes: one scan).
A run that is started again reads finished stages back; one whose options or inputs have changed is made anew, and so is all that reads it. A stage is
finished when Spark has committed its files, so one that was cut short is not taken for done. What an earlier run left under the stage's name goes when the new result is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialised, remove_folder


def unkept(name: str, make: Callable[[], DataFrame], *inputs: DataFrame, options: object = "") -> DataFrame:
    """A stage of a run that isn't kept."""
    return materialised(make())


class Stages:
    """Stages in a folder. made: names of those that this run had to make."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []
        self._known: dict[int, tuple[DataFrame, str]] = {}

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, system = self._path(path)
        return system.exists(p)

    def _names(self, path: str) -> list[str]:
        p, system = self._path(path)
        return [f.getPath().getName() for f in system.listStatus(p)] if system.exists(p) else []

    def content(self, df: DataFrame) -> str:
        """What a table is known by; a stage's result by how it was made."""
        known = self._known.get(id(df))
        if known is None:
            row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{x}`") for x in df.columns)).cast("decimal(38,0)")).alias("h")).first()
            known = self._known[id(df)] = df, f"{df.schema.simpleString()} {row.n} {row.h}"
        return known[1]

    def __call__(self, name: str, make: Callable[[], DataFrame], *inputs: DataFrame, options: object = "") -> DataFrame:
        """The result of a stage: read back if it is there, else made and kept. inputs: all tables that make reads; options: all else that it depends on."""
        key = hashlib.sha256("\n".join([name, str(options), *(self.content(x) for x in inputs)]).encode()).hexdigest()[:32]
        path = f"{self.folder}/{name}/{key}"
        if not self._exists(f"{path}/_SUCCESS"):
            self.made.append(name)
            make().write.mode("overwrite").parquet(path)
        for other in self._names(f"{self.folder}/{name}"):
            if other != key:
                remove_folder(self.spark, f"{self.folder}/{name}/{other}")
        out = self.spark.read.parquet(path)
        self._known[id(out)] = out, f"stage {name} {key}"
        return out

    def keep(self, *names: str) -> None:
        """Removes all stages but these: what no later run is to read."""
        for name in self._names(self.folder):
            if name not in names:
                remove_folder(self.spark, f"{self.folder}/{name}")
