"""A source that reads WAV files by ranges of bytes: ``spark.read.format("wav_blocks")``.

Only the header of a file is read to plan; a partition is a stretch of whole blocks of one file, and
reads just its bytes.  A slice in seconds, and filters on ``block``, choose the stretches before
anything is read, so a file of any size is read by as many tasks as it has stretches, and a slice of it
costs what the slice has.  Files are opened through Arrow's file systems by the path's scheme.

Options: ``size`` (samples of a block), ``start`` and ``end`` (seconds; places in the result count from the
slice's start), ``stretch`` (blocks of a partition).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .media import UnsupportedFormat

SCHEMA = "track string, ch int, block bigint, v array<double>, rate int"
#: Blocks of a partition.
STRETCH = 64
#: Bytes of header that are read at once, and format tags: PCM, IEEE floats, and the extended form that names one of them (fixed values).
HEAD, PCM, FLOAT, EXTENDED = 1 << 16, 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are, and of what kind."""

    rate: int
    channels: int
    width: int
    floats: bool
    at: int
    frames: int


def layout(handle, length: int) -> Layout:
    """The layout of an open WAV file of so many bytes, from its chunks' headers."""
    head = handle.read(min(HEAD, length))
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise UnsupportedFormat("no WAV file")
    at, kind = 12, None
    while at + 8 <= length:
        if at + 40 > len(head):
            handle.seek(at)
            head, base = handle.read(64), at
        else:
            base = 0
        name, size = head[at - base : at - base + 4], struct.unpack("<I", head[at - base + 4 : at - base + 8])[0]
        body = head[at - base + 8 : at - base + 40]
        if name == b"fmt ":
            tag, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", body[:16])
            tag = struct.unpack("<H", body[24:26])[0] if tag == EXTENDED and len(body) >= 26 else tag
            width = bits // 8
            if tag not in (PCM, FLOAT) or not channels or frame != channels * width or width not in ((1, 2, 3, 4) if tag == PCM else (4, 8)):
                raise UnsupportedFormat(f"samples of kind {tag} and {bits} bits")
            kind = rate, channels, width, tag == FLOAT
        elif name == b"data":
            if kind is None:
                raise UnsupportedFormat("samples come before their format")
            there = min(size, length - at - 8)
            return Layout(*kind, at + 8, there // (kind[1] * kind[2]))
        at += 8 + size + size % 2
        if base:
            head = b""
    raise UnsupportedFormat("no samples")


def decoded(raw: bytes, form: Layout) -> np.ndarray:
    """(frame, channel) values, whole numbers brought to [-1, 1)."""
    if form.floats:
        values = np.frombuffer(raw, f"<f{form.width}").astype(float)
    elif form.width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif form.width == 3:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((wide[:, 0] << 8 | wide[:, 1] << 16 | wide[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        values = np.frombuffer(raw, f"<i{form.width}") / float(1 << (8 * form.width - 1))
    return values.reshape(-1, form.channels)


@dataclass
class Stretch(InputPartition):
    """Blocks [first, end) of the slice of a file that begins at frame ``start`` and has ``total`` frames."""

    path: str
    form: Layout
    start: int
    total: int
    first: int
    end: int

    def bytes(self, size: int) -> tuple[int, int]:
        """The range [from, to) of the file that holds the blocks."""
        frame = self.form.channels * self.form.width
        a, b = self.start + self.first * size, self.start + min(self.end * size, self.total)
        return self.form.at + a * frame, self.form.at + b * frame


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size, self.stretch = int(options.get("size", 1 << 15)), int(options.get("stretch", STRETCH))
        self.start, self.finish = float(options.get("start", 0)), options.get("end")
        self.ending = options.get("ending", "").lower()
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the block are taken, all other filters are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("block",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                end = f.value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)

    def _files(self) -> Iterator[tuple[fs.FileSystem, fs.FileInfo, str]]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        for each in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and f.base_name.lower().endswith(self.ending)), key=lambda f: f.path):
            yield store, each, scheme + each.path

    def partitions(self) -> list[Stretch]:
        out = []
        for store, info, name in self._files():
            with store.open_input_file(info.path) as handle:
                form = layout(handle, info.size)
            first = int(self.start * form.rate)
            last = form.frames if self.finish is None else min(int(float(self.finish) * form.rate), form.frames)
            if first >= form.frames and form.frames:
                raise ValueError(f"the slice begins after the end of {name}")
            blocks = -(-max(0, last - first) // self.size)
            low, high = self.low, blocks if self.high is None else min(self.high, blocks)
            out += [Stretch(name, form, first, last - first, a, min(a + self.stretch, high)) for a in range(low, high, self.stretch)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        path = partition.path
        store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        form, frame = partition.form, partition.form.channels * partition.form.width
        begin, end = partition.bytes(self.size)
        with store.open_input_file(where) as handle:
            handle.seek(begin)
            for block in range(partition.first, partition.end):
                values = decoded(handle.read(min(self.size * frame, end - handle.tell())), form)
                n = form.channels
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array([block] * n, pa.int64()),
                    pa.array([values[:, c] for c in range(n)], pa.list_(pa.float64())), pa.array([form.rate] * n, pa.int32()),
                ], names=["track", "ch", "block", "v", "rate"])


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def read_wav_blocks(spark: SparkSession, path: str, start: float = 0.0, end: float | None = None, size: int = 1 << 15, stretch: int = STRETCH, ending: str = ""):
    """(track, ch, block, v, rate): the files under a path as blocks of ``size`` samples of a channel, read by ranges.

    ending: that of the names of the files to read, in either case; the others are passed over.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavBlocks)
    options = {"size": size, "stretch": stretch, "start": start, "ending": ending} | ({} if end is None else {"end": end})
    return spark.read.format("wav_blocks").options(**options).load(path)
