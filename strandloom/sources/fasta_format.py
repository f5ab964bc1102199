"""FASTA as a Spark data source: spark.read.format("fasta") and df.write.format("fasta"), after register(spark).

A partition is a range of bytes and reads the records whose '>', at the begin of a line, lies in it, so a file of any size is read side by side and no record twice.
Only the columns of the schema that is asked for are made (give .schema("name string, len int") and no sequence leaves the reader), and filters on
names are applied before a sequence is joined. Paths are files, folders, or patterns in their last part, on the file systems that pyarrow knows. A gzipped file
is one partition. A record is one row, however long.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

c = F.col
SCHEMA = "file string, pos long, name string, header string, seq string, len int"
#: Bytes of a partition, of a read, and letters of a batch.
PARTITION, BLOCK, BATCH = 64 << 20, 4 << 20, 8 << 20


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files (with their sizes) of a path in order of name; those whose names begin with _ or . are left out."""
    system, inner = _opened(path)
    folder, last = os.path.split(inner.rstrip("/"))
    if any(x in last for x in "*?["):
        found = [f for f in system.get_file_info(arrow_fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        info = system.get_file_info(inner)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(inner))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "_.")


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def records(stream, begin: int, end: int | None, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place, text behind the '>') of the records that begin in [begin, end) of a stream (all from 0 on, if end is None, of one that can't seek)."""
    at = max(begin - 1, 0)
    if at:
        stream.seek(at)
    buf, start, look, first = bytearray(), None, 0, begin == 0
    while True:
        more = stream.read(block)
        if first and more[:1] == b">":
            start = 0
        first = False
        buf += more
        while (i := buf.find(b"\n>", look)) >= 0:
            if start is not None:
                yield at + start, bytes(buf[start + 1 : i])
            if end is not None and at + i + 1 >= end:
                return
            start = look = i + 1
        if not more:
            if start is not None:
                yield at + start, bytes(buf[start + 1 :])
            return
        if start is None and end is not None and at + len(buf) > end:
            return
        # what lies before the open record goes, but for a last byte that may be the end of a line
        gone = len(buf) - 1 if start is None else start
        del buf[:gone]
        at, start = at + gone, None if start is None else 0
        look = max(len(buf) - 1, 0)


class FastaReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, options: dict):
        self.schema, self.path = schema, path
        self.size = int(options.get("partitionbytes", PARTITION))
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("name",):
                self.names.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        system = _opened(self.path)[0].type_name
        prefix = "" if system == "local" else self.path.split("://", 1)[0] + "://"
        out = []
        for file, size in _files(self.path):
            step = max(1, size) if file.endswith(".gz") else self.size
            out += [Range(prefix + file, a, min(a + step, size)) for a in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def _passes(self, name: str) -> bool:
        one = lambda f: name in f.value if isinstance(f, In) else name.startswith(f.value) if isinstance(f, StringStartsWith) else name == f.value
        return all(one(f) for f in self.names)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, inner = _opened(partition.file)
        packed = inner.endswith(".gz")
        wanted = {f.name for f in self.schema.fields}
        kind = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        held = 0
        with system.open_input_stream(inner, compression="gzip") if packed else system.open_input_file(inner) as stream:
            for pos, text in records(stream, 0 if packed else partition.begin, None if packed else partition.end):
                head, _, body = text.partition(b"\n")
                header = head.decode().strip()
                name = header.split(None, 1)[0] if header else ""
                if not header and not body.strip() or not self._passes(name):
                    continue
                seq = b"".join(body.split()).decode() if wanted & {"seq", "len"} else ""
                row = {"file": inner, "pos": pos, "name": name, "header": header, "seq": seq, "len": len(seq)}
                rows.append(tuple(row[f.name] for f in self.schema.fields))
                held += len(seq) if "seq" in wanted else 100
                if held >= BATCH:
                    yield self._batch(rows, kind)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, kind)

    @staticmethod
    def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    file: str


class FastaWriter(DataSourceArrowWriter):
    """A file for each task, under a hidden name until all are written; then they get their names and, where the mode says so, those of before go."""

    def __init__(self, schema: StructType, path: str, options: dict, overwrite: bool):
        if not {"name", "seq"} <= {f.name for f in schema.fields}:
            raise ValueError("FASTA is written from columns name and seq")
        self.path, self.width, self.overwrite = path, int(options.get("width", 0)), overwrite
        self.run = uuid.uuid4().hex[:12]
        system, inner = _opened(path)
        system.create_dir(inner, recursive=True)

    def _lines(self, seq: str) -> str:
        return "\n".join(seq[i : i + self.width] for i in range(0, len(seq), self.width)) if self.width else seq

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = _opened(self.path)
        context = TaskContext.get()
        file = f"part-{context.partitionId():05d}-{self.run}-{context.taskAttemptId()}.fa"
        with system.open_output_stream(f"{inner}/.{file}") as out:
            for batch in iterator:
                for name, seq in zip(batch.column("name").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                    out.write(f">{name or ''}\n{self._lines(seq or '')}\n".encode())
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _opened(self.path)
        before = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(f"{inner}/.{m.file}", f"{inner}/{m.file}")
        for file, _ in before:
            system.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        """Files of this run go, those of tasks that ended without a message too."""
        system, inner = _opened(self.path)
        for f in system.get_file_info(arrow_fs.FileSelector(inner)):
            if f.base_name.startswith(".part-") and self.run in f.base_name:
                system.delete_file(f.path)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(schema, self._path(), dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FastaWriter:
        return FastaWriter(schema, self._path(), dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    return spark


def ordered(rows: DataFrame, set_id: str = "", range_: int = PARTITION) -> DataFrame:
    """set_id, seq_idx (in order of files and places), name, seq, len of rows read with this format. Records are counted per range of bytes first, so no window
    holds more than those of a range."""
    block = rows.withColumn("_r", F.floor(c("pos") / range_))
    sizes = block.groupBy("file", "_r").agg(F.count("*").alias("_k")).withColumn("_b", F.coalesce(F.sum("_k").over(Window.orderBy("file", "_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("file", "_r").orderBy("pos")) - 1 + c("_b")
    return block.join(sizes, ["file", "_r"]).select(F.lit(set_id).alias("set_id"), number.cast("long").alias("seq_idx"), "name", "seq", "len")
