"""Ordered lines as one file that tasks write.

The lines are sorted over all partitions, and every task writes the lines of its
own part beside the file. When all parts are there, a manifest gives each its
place, by a prefix sum over the parts' sizes; tasks then copy the parts to their
places in a file of the final size, which takes its name by one rename. Parts
bear the attempt that wrote them and the manifest names those that count, so a
task that runs twice, or is lost half-way, harms nothing; copying twice writes
the same bytes. If the job fails, the parts are removed and no file appears.

The driver sees sizes of parts, no lines. Paths must lie in a folder that the
driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from snapgraph.session import ship

MANIFEST = "_manifest.json"
#: Bytes that are copied or read at once, and bytes of a file that one task reads.
CHUNK, RANGE = 8 << 20, 32 << 20


def local(path: str) -> str:
    """A path as the operating system knows it."""
    return os.path.abspath(path.removeprefix("file://"))


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    size: int
    lines: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        context = TaskContext.get()
        name, size, lines = f"part-{context.partitionId():08d}-{context.taskAttemptId()}", 0, 0
        with open(os.path.join(self.folder, name), "wb") as f:
            for batch in iterator:
                size += f.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
                lines += batch.num_rows
        return _Part(context.partitionId(), name, size, lines)

    def commit(self, messages: list[_Part | None]) -> None:
        at, rows = 0, []
        for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            if part.size:
                rows.append({"name": part.name, "at": at, "size": part.size, "lines": part.lines})
            at += part.size
        text = json.dumps({"size": at, "parts": rows})
        path = os.path.join(self.folder, MANIFEST)
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{path}.new", path)

    def abort(self, messages: list[_Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class OrderedLines(DataSource):
    """df.write.format("ordered_lines").mode("append").save(folder): the partitions' lines, in their order, as parts with a manifest."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write_parts(lines: DataFrame, folder: str) -> dict:
    """Write the column line of an ordered relation as parts into a new folder; returns the manifest."""
    spark = lines.sparkSession
    ship(spark)
    spark.dataSource.register(OrderedLines)
    os.makedirs(folder)
    lines.select("line").write.format("ordered_lines").mode("append").save(folder)
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        return json.load(f)


def assemble(spark: SparkSession, folder: str, manifest: dict, path: str) -> None:
    """Copy parts to their places in one file, by tasks."""
    new = f"{path}.{uuid.uuid4().hex}.new"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            target = os.open(new, os.O_WRONLY)
            try:
                for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with open(os.path.join(folder, name), "rb") as f:
                        while data := f.read(CHUNK):
                            while data:  # a write may take less than it is given
                                n = os.pwrite(target, data, at)
                                data, at, done = data[n:], at + n, done + n
                os.fsync(target)
            finally:
                os.close(target)
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["done"])

    try:
        with open(new, "wb") as f:
            f.truncate(manifest["size"])
        parts = manifest["parts"]
        if parts:
            rows = spark.createDataFrame([(p["name"], p["at"]) for p in parts], "name string, at long").repartition(min(len(parts), 256))
            done = rows.mapInArrow(copy, "done long").agg(F.sum("done")).first()[0]
            if done != manifest["size"]:
                raise OSError(f"{done} of {manifest['size']} bytes were copied to {path}")
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)


def write_file(lines: DataFrame, path: str) -> int:
    """Write the column line of an ordered relation as one file, each line ended by a line feed; returns its size."""
    path = local(path)
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    try:
        manifest = write_parts(lines, folder)
        assemble(lines.sparkSession, folder, manifest, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return manifest["size"]


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): every line of a file with the byte it begins at, read in ranges by tasks."""
    path = local(path)
    size = os.path.getsize(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    f.seek(max(0, begin - 1))
                    if begin:
                        f.readline()  # what began before belongs to the range before
                    while (at := f.tell()) < min(size, begin + RANGE):
                        lines, places = [], []
                        while at < min(size, begin + RANGE) and len(lines) < 4096:
                            line = f.readline()
                            places.append(at)
                            lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                            at += len(line)
                        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["at", "line"])

    ranges = spark.range(0, max(1, -(-size // RANGE)), 1, max(1, min(256, -(-size // RANGE)))).select((F.col("id") * RANGE).alias("begin"))
    return ranges.mapInArrow(rows, "at long, line string")
