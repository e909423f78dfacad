"""Index files of numpy arrays (.npz) as a Spark data source: partitions are row ranges, read in place."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, embedding array<float>, abstract string"
#: Names of the member arrays (fixed values): vectors, ids, texts; a file without texts has empty ones.
MEMBERS = ("embeddings", "arxiv_ids", "abstracts")
#: Bytes of all members that a partition and a batch hold, if a row is not larger.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place."""
    system, inner = system_of(path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Member:
    """Where an array's first row lies in the file (-1: packed, so that it is read from its start), its type and its shape."""

    name: str
    at: int
    kind: str
    shape: tuple

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def header(member) -> tuple[np.dtype, tuple]:
    """Type and shape of an array from its own header; the file then stands at the first row."""
    version = npy.read_magic(member)
    shape, by_columns, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(member)
    if kind.hasobject:
        raise ValueError("arrays of pickled objects are not read")
    if by_columns and len(shape) > 1:
        raise ValueError("an array in the order of columns has no rows in place")
    return kind, shape


def members(path: str) -> dict[str, Member]:
    """The arrays of a file that an index has."""
    out = {}
    with opened(path) as raw, zipfile.ZipFile(raw) as packed:
        for name in MEMBERS:
            if f"{name}.npy" not in packed.namelist():
                continue
            info = packed.getinfo(f"{name}.npy")
            with packed.open(info) as member:
                kind, shape = header(member)
                ahead = member.tell()
            at = -1
            if info.compress_type == zipfile.ZIP_STORED:
                # A member's own header: 30 bytes, then its name and its extra field, whose lengths stand at 26 and 28.
                raw.seek(info.header_offset + 26)
                at = info.header_offset + 30 + sum(np.frombuffer(raw.read(4), "<u2").tolist()) + ahead
            out[name] = Member(name, at, kind.str, tuple(shape))
    for name in MEMBERS[:2]:
        if name not in out:
            raise ValueError(f"{path}: there is no array {name}")
    if len(out["embeddings"].shape) != 2 or len({m.shape[0] for m in out.values()}) != 1:
        raise ValueError(f"{path}: the arrays have different numbers of rows, or the vectors no second dimension")
    return out


@dataclass
class Rows(InputPartition):
    path: str
    arrays: tuple
    first: int
    last: int

    def __init__(self, path: str, arrays: tuple, first: int, last: int) -> None:
        super().__init__((path, first, last))
        self.path, self.arrays, self.first, self.last = path, arrays, first, last


def chunks(raw, member: Member, first: int, last: int, step: int) -> Iterator[np.ndarray]:
    """Rows first to last of an array, step at a time. A packed member has to be unpacked from its start, a batch at a time too."""
    if member.at >= 0:
        source = raw
        source.seek(member.at + first * member.row_bytes)
    else:
        source = zipfile.ZipFile(raw).open(f"{member.name}.npy")
        header(source)
        ahead = first * member.row_bytes
        while ahead > 0 and (got := len(source.read(min(ahead, BATCH_BYTES)))):
            ahead -= got
    for at in range(first, last, step):
        n = min(step, last - at)
        data = source.read(n * member.row_bytes)
        if len(data) < n * member.row_bytes:
            raise ValueError(f"the array {member.name} ends early")
        yield np.frombuffer(data, member.kind).reshape(n, *member.shape[1:]) if member.row_bytes else np.zeros((n, *member.shape[1:]), member.kind)


def texts(values: np.ndarray) -> pa.Array:
    """Texts of an array of characters, of bytes or of numbers."""
    if values.dtype.kind == "S":
        return pa.array([v.decode("utf-8", "replace") for v in values.tolist()], pa.string())
    return pa.array([str(v) for v in values.tolist()], pa.string())


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", PART_BYTES))

    def files(self) -> list[str]:
        """The file itself, or those of a folder in the order of their names."""
        if self.path.endswith(".npz"):
            return [self.path]
        system, inner = system_of(self.path)
        lead = self.path.removesuffix(inner)
        return sorted(lead + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".npz"))

    def partitions(self) -> list[Rows]:
        """Row ranges of a bounded number of bytes: only headers are read here."""
        out = []
        for path in self.files():
            arrays = members(path)
            rows = arrays["embeddings"].shape[0]
            step = max(1, self.bytes // max(1, sum(m.row_bytes for m in arrays.values())))
            if any(m.at < 0 for m in arrays.values()):
                step = max(1, rows)  # packed members can't be entered in the middle
            out += [Rows(path, tuple(arrays.values()), a, min(rows, a + step)) for a in range(0, rows, step)]
        return out or [Rows("", (), 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        arrays = {m.name: m for m in partition.arrays}
        step = max(1, BATCH_BYTES // max(1, sum(m.row_bytes for m in arrays.values())))
        files = {name: opened(partition.path) for name in arrays}
        try:
            parts = {name: chunks(files[name], m, partition.first, partition.last, step) for name, m in arrays.items()}
            for vectors in parts["embeddings"]:
                n, width = vectors.shape
                flat = pa.array(np.ascontiguousarray(vectors, np.float32).ravel())
                vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)
                text = texts(next(parts["abstracts"])) if "abstracts" in parts else pa.array([""] * n, pa.string())
                yield pa.RecordBatch.from_arrays([texts(next(parts["arxiv_ids"])), vector, text], ["id", "embedding", "abstract"])
        finally:
            for f in files.values():
                f.close()


class IndexFiles(DataSource):
    """format("npz_index"): .load(file or folder), option partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "npz_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_npz_index(spark: SparkSession, path: str, partition_bytes: int = PART_BYTES) -> DataFrame:
    """id, embedding, abstract of an .npz index, or of all in a folder, as tables.read_index() gives them of Parquet.

    Every task reads its own rows in place, so no array passes the driver whole. A file with packed members is one task each.
    Arrays of Python objects (pickles) are refused; ids may be texts, bytes or numbers. A file of no rows gives none.
    """
    spark.dataSource.register(IndexFiles)
    return spark.read.format("npz_index").option("partitionBytes", partition_bytes).load(path)
