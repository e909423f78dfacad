"""Growing logs as a stream whose place in every file is a byte: each whole line once, whatever the cut between two writes."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.arrays import opened, system_of

SCHEMA = "path string, at long, value string"
#: Bytes of a file that a task reads, of a read, and of the lines of a batch.
PART_BYTES, READ_BYTES, BATCH_BYTES = 32 << 20, 1 << 20, 4 << 20


def last_end(path: str, size: int, block: int = READ_BYTES) -> int:
    """The place after the last line feed of the first size bytes; 0 where there is none. Reads backwards, a block at a time."""
    with opened(path) as f:
        end = size
        while end > 0:
            start = max(0, end - block)
            f.seek(start)
            found = f.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def lines(path: str, start: int, end: int, block: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that begin at start or after it and before end, read on to their line feed.

    A line that begins before start belongs to whoever reads that place.
    """
    with opened(path) as f:
        at = start
        if start > 0:
            # The byte before start tells whether a line begins there.
            f.seek(start - 1)
            while True:
                data = f.read(block)
                found = data.find(b"\n")
                if found >= 0 or not data:
                    at = f.tell() - len(data) + found + 1 if data else end
                    break
        f.seek(at)
        parts, length = [], 0
        while at < end:
            data = f.read(block)
            if not data:
                return
            begin = 0
            while (found := data.find(b"\n", begin)) >= 0:
                parts.append(data[begin:found])
                line = b"".join(parts)
                yield at, line
                at, parts, length, begin = at + length + found - begin + 1, [], 0, found + 1
                if at >= end:
                    return
            parts.append(data[begin:])
            length += len(data) - begin


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob = options["path"].rstrip("/"), options.get("glob", "*")
        self.bytes = int(options.get("partitionbytes", PART_BYTES))
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """File to the end of its last whole line; a file that did not grow is not looked into again."""
        system, inner = system_of(self.path)
        lead = self.path.removesuffix(inner)
        out = {}
        for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if f.type != fs.FileType.File or not fnmatch.fnmatch(f.base_name, self.glob):
                continue
            path = lead + f.path
            if self.ends.get(path, (-1, 0))[0] != f.size:
                self.ends[path] = (f.size, last_end(path, f.size))
            out[path] = self.ends[path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """The new bytes of every file, cut to what a task reads. A file that is shorter than it was is a new one and read from its start."""
        out = []
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if first > last else first
            out += [Piece(path, a, min(last, a + self.bytes)) for a in range(first, last, self.bytes)]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        places, values, size = [], [], 0
        for at, line in lines(partition.path, partition.start, partition.end) if partition.path else ():
            places.append(at)
            values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            size += len(line) + 32
            if size >= BATCH_BYTES:
                yield self.batch(partition.path, places, values)
                places, values, size = [], [], 0
        if places:
            yield self.batch(partition.path, places, values)

    def batch(self, path: str, places: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(places)), pa.array(places, pa.int64()), pa.array(values, pa.string())], ["path", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """format("growing_lines"): .load(folder), options glob and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)


def growing_lines(spark: SparkSession, folder: str, glob: str = "*.log", partition_bytes: int = PART_BYTES) -> DataFrame:
    """path, at, value: each whole line of the files of a folder, with the byte at which it begins, once.

    Places are kept in the checkpoint, a number a file, so a query that starts again goes on where its last batch ended. A last line
    without its line feed waits until that is written. Bytes that are no UTF-8 are replaced; carriage returns before the line feed go.
    A line is read whole by the task that has its first byte, however long. A file that becomes shorter is read from its start again;
    one that was replaced by a longer one can't be told from one that grew. Files that go are no error between batches.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("glob", glob).option("partitionBytes", partition_bytes).load(folder)
