"""Binary files in parts: an index of where rows lie, and tasks that each read a range of it.

Files are opened through Arrow's file systems, by whatever task needs some of their bytes; Spark only lists them. The index walks over a file
without parsing it: it reads the lengths that tell where the next record begins.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads, about.
RANGE_BYTES = 1 << 26
_WINDOW = 1 << 20
_RANGE = "path string, first bigint, last bigint"


def opened(path: str):
    """A file that can be read anywhere; Spark's short form of local addresses counts too."""
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.open_input_file(name)


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, length of the files under ``path``; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def in_ranges(files: DataFrame, index: Callable[[str], Iterator[tuple[int, int]]], range_bytes: int) -> DataFrame:
    """path, first, last of the parts that ``index`` cuts each file into, dealt to as many tasks as the files have ranges."""
    tasks = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                yield pd.DataFrame([(path, *r) for r in index(path)], columns=["path", "first", "last"])

    return files.select("path").mapInPandas(run, _RANGE).repartition(int(tasks))


class Walk:
    """Small reads that go forward through a file, a window at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.low, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if not self.low <= place or place + n > self.low + len(self.data):
            self.low, self.data = place, self.file.read_at(min(max(_WINDOW, n), max(self.size - place, 0)), place)
        own = self.data[place - self.low : place - self.low + n]
        if len(own) < n:
            raise ValueError(f"file ends at {self.size}, within a record")
        return own

    def until_zero(self, place: int) -> int:
        """Where the first zero byte lies from ``place`` on."""
        step = 64
        while True:
            found = self.at(place, min(step, self.size - place)).find(b"\0")
            if found >= 0:
                return place + found
            if place + step >= self.size:
                raise ValueError("a name without an end")
            step *= 4


def next_image(walk: Walk, at: int) -> int:
    """Where the record after the image's at ``at`` begins: 64 bytes, a name, a zero, a count, 24 bytes a 2-D point."""
    end = walk.until_zero(at + 64)
    return end + 9 + 24 * struct.unpack("<Q", walk.at(end + 1, 8))[0]


def next_point(walk: Walk, at: int) -> int:
    """Where the record after the point's at ``at`` begins: 51 bytes and 8 a track entry."""
    return at + 51 + 8 * struct.unpack("<Q", walk.at(at + 43, 8))[0]


def record_ranges(path: str, after: Callable[[Walk, int], int], range_bytes: int) -> Iterator[tuple[int, int]]:
    """First byte and end of runs of whole records, each of ``range_bytes`` or its last record more."""
    with opened(path) as f:
        walk = Walk(f, f.size())
        (n,) = struct.unpack("<Q", walk.at(0, 8))
        at = first = 8
        for _ in range(n):
            at = after(walk, at)
            if at > walk.size:
                raise ValueError(f"{path} ends at {walk.size}, within a record")
            if at - first >= range_bytes:
                yield first, at
                first = at
        if at > first:
            yield first, at


def records(path: str, first: int, last: int, after: Callable[[Walk, int], int]) -> tuple[bytes, np.ndarray]:
    """The bytes of a range, and where in them each record begins."""
    with opened(path) as f:
        data = f.read_at(last - first, first)
    walk = Walk(None, len(data))
    walk.data = data
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at = after(walk, at)
    return data, np.array(starts, np.int64)


class Bundle:
    """The arrays of an .npz file, of which rows are read where they are stored as they are."""

    def __init__(self, file):
        self.file, self.zip = file, zipfile.ZipFile(file)
        self.at: dict[str, tuple] = {}
        for info in self.zip.infolist():
            name = info.filename.removesuffix(".npy")
            head = file.read_at(30, info.header_offset)
            place = info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))
            with self.zip.open(info) as member:
                version = np.lib.format.read_magic(member)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, fortran, dtype = read(member)
                start = place + member.tell()
            if dtype.hasobject:
                raise ValueError(f"{name} holds objects")
            self.at[name] = (shape, dtype, start, info.compress_type == zipfile.ZIP_STORED and not fortran)

    def rows(self) -> int:
        return min(shape[0] for shape, *_ in self.at.values() if shape)

    def stored(self, names: list[str]) -> bool:
        return all(self.at[n][3] for n in names)

    def row_bytes(self, names: list[str]) -> int:
        return sum(self.at[n][1].itemsize * int(np.prod(self.at[n][0][1:])) for n in names)

    def read(self, name: str, first: int, last: int) -> np.ndarray:
        shape, dtype, start, plain = self.at[name]
        if not plain:
            return np.load(io.BytesIO(self.zip.read(f"{name}.npy")), allow_pickle=False)[first:last]
        size = dtype.itemsize * int(np.prod(shape[1:]))
        return np.frombuffer(self.file.read_at(size * (last - first), start + size * first), dtype).reshape(last - first, *shape[1:])
