"""Sound files as a Spark data source: ``spark.read.format("wav").load(folder)``.

A file is read as many ranges of bytes, each by a task of its own, so one long recording keeps a cluster busy. A sample
belongs to the range in which its first byte lies; a task opens the file, reads its head and its own range, and what it
needs beside it (a resampler and overlapping frames look a little further). Nothing is shuffled.

Options: ``rangeBytes`` (8 MB), ``columns`` (names, separated by commas: no others are made, and without samples among
them only heads are read), ``seconds`` and ``center`` (the first seconds of a file, or the middle ones), ``rate`` (samples
a second to which they are brought), ``chunk`` (samples a row), or ``frame`` and ``hop`` (rows are whole frames of so many
samples, one every hop). Filters on path are pushed down to the listing.

PCM of 8 to 32 bits and floats of 32 and 64 bits, little endian; RF64 and sizes beyond 4 GB. A file that can't be read
has one row with ``error`` if that column is asked for, and none otherwise; an empty file of sound has no rows; one
channel stands on both sides. Paths are local or of any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

_FLOATS = pa.list_(pa.float32())
FIELDS = {
    "path": pa.string(), "sample_rate": pa.int32(), "channels": pa.int32(), "bit_depth": pa.int32(), "codec": pa.string(), "n_samples": pa.int64(), "bytes": pa.int64(),
    "first": pa.int64(), "frame": pa.int64(), "left": _FLOATS, "right": _FLOATS, "mono": _FLOATS, "error": pa.string(),
}
SAMPLES = ("first", "frame", "left", "right", "mono")
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", _FLOATS: "array<float>"}
#: Zero crossings of the resampler's sinc on either side, where it cuts off (1: half the lower rate), and its window's shape: 80 dB.
CROSSINGS, CUT, SHAPE = 32, 0.92, 7.857


@dataclass(frozen=True)
class Head:
    """What the head of a file says."""

    rate: int
    channels: int
    bits: int
    floating: bool
    start: int
    samples: int

    @property
    def step(self) -> int:
        return self.channels * self.bits // 8

    @property
    def codec(self) -> str:
        return f"pcm_f{self.bits}le" if self.floating else "pcm_u8" if self.bits == 8 else f"pcm_s{self.bits}le"

    def values(self, raw: bytes) -> np.ndarray:
        """Samples from -1 to 1, a column for each channel."""
        if self.floating:
            x = np.frombuffer(raw, f"<f{self.bits // 8}").astype(np.float32)
        elif self.bits == 8:
            x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
        elif self.bits == 24:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8).astype(np.float32) / 2**31
        else:
            x = np.frombuffer(raw, f"<i{self.bits // 8}").astype(np.float32) / float(1 << (self.bits - 1))
        return x.reshape(-1, self.channels)


def head_of(file: pa.NativeFile, size: int) -> Head:
    """Walks the chunks of a file up to its samples; ValueError where it isn't one."""
    file.seek(0)
    top = file.read(12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise ValueError("no RIFF file of sound")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"ds64":
            long_size = struct.unpack("<Q", file.read(16)[8:])[0]
        elif name == b"fmt ":
            data = file.read(min(n, 40))
            if len(data) < 16:
                raise ValueError("its format is cut off")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[:16])
            if kind == 0xFFFE and len(data) >= 26:
                kind = struct.unpack("<H", data[24:26])[0]
            if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)} or not channels or not rate:
                raise ValueError(f"format {kind} with {bits} bits isn't known")
            form = (rate, channels, bits, kind == 3)
        elif name == b"data":
            if form is None:
                raise ValueError("it has no format")
            n = long_size if n == 0xFFFFFFFF and long_size is not None else n
            return Head(*form, at + 8, max(0, min(n, size - at - 8)) // (form[1] * form[2] // 8))
        at += 8 + n + n % 2
    raise ValueError("it has no samples")


def kernel(own: int, rate: int) -> tuple[int, int, int, np.ndarray]:
    """Outputs a period, inputs a period, reach in inputs, and a row of weights for each phase of a windowed sinc."""
    common = math.gcd(own, rate)
    up, down, low = rate // common, own // common, min(1.0, rate / own)
    reach = math.ceil(CROSSINGS / low)
    off = np.arange(up)[:, None] / up - np.arange(1 - reach, reach + 1)[None, :]
    w = np.sinc(off * low * CUT) * np.i0(SHAPE * np.sqrt(np.maximum(0, 1 - (off / reach) ** 2)))
    return up, down, reach, w / w.sum(1, keepdims=True)


def resampled(read, n: int, own: int, rate: int, first: int, last: int) -> np.ndarray:
    """Samples first to last at another rate; read(a, b) gives those at its own, which has n. Beyond the ends is silence.

    Each output is the same sum of the same products, whatever stretch it is asked for with.
    """
    up, down, reach, weights = kernel(own, rate)
    j = np.arange(first, last, dtype=np.int64)
    if not len(j):
        return read(0, 0)
    at, phase = j * down // up, j * down % up
    a, b = int(at[0]) + 1 - reach, int(at[-1]) + reach + 1
    x = read(max(0, a), min(n, b))
    x = np.pad(x, ((max(0, -a), max(0, b - max(n, 0))), (0, 0)))
    out = np.zeros((len(j), x.shape[1]))
    for k in range(2 * reach):
        out += x[at - a + 1 - reach + k] * weights[phase, k][:, None]
    return out.astype(np.float32)


@dataclass
class Ranges(InputPartition):
    """Ranges of bytes of some files: (path, size, first byte, last byte)."""

    items: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.names, self.folder = names, options["path"]
        self.range_bytes, self.chunk = int(options.get("rangeBytes", 8 << 20)), int(options.get("chunk", 1 << 16))
        self.seconds = float(options["seconds"]) if "seconds" in options else None
        self.center, self.rate = options.get("center", "false").lower() == "true", int(options.get("rate", 0)) or None
        self.frame = int(options.get("frame", 0))
        self.hop = int(options.get("hop", self.frame)) if self.frame else 0
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, top = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        lead = self.folder[: self.folder.rfind(top)] if self.folder.endswith(top) else ""
        info = system.get_file_info(top)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        found = sorted((f"{lead}{f.path}", f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        out, held, size = [], [], 0
        with_samples = any(n in SAMPLES for n in self.names)
        for path, n in found:
            if self.paths is not None and path not in self.paths:
                continue
            for a in range(0, max(1, n), self.range_bytes) if with_samples else [0]:
                held.append((path, n, a, min(n, a + self.range_bytes)))
                size += held[-1][3] - a if with_samples else 4096
                if size >= self.range_bytes:
                    out.append(Ranges(held))
                    held, size = [], 0
        return [*out, Ranges(held)] if held or not out else out

    def batch(self, head: Head | None, path: str, size: int, **values) -> pa.RecordBatch:
        told = {"path": path, "bytes": size} | values
        if head is not None:
            told |= {"sample_rate": self.rate or head.rate, "channels": head.channels, "bit_depth": head.bits, "codec": head.codec, "n_samples": head.samples}
        return pa.RecordBatch.from_arrays([pa.array([told.get(n)], FIELDS[n]) for n in self.names], names=self.names)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, size, a, b in partition.items:
            system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            with system.open_input_file(name) as file:
                try:
                    head = head_of(file, size)
                except (ValueError, struct.error) as x:
                    if a == 0 and "error" in self.names:
                        yield self.batch(None, path, size, error=str(x))
                    continue
                if any(n in SAMPLES for n in self.names):
                    yield from self.stretches(file, head, path, size, a, b)
                elif a == 0:
                    yield self.batch(head, path, size)

    def stretches(self, file: pa.NativeFile, head: Head, path: str, size: int, a: int, b: int) -> Iterator[pa.RecordBatch]:
        """The rows of a file that start in its bytes a to b."""
        most = head.samples if self.seconds is None else min(head.samples, int(self.seconds * head.rate))
        lo = (head.samples - most) // 2 if self.center else 0
        rate = self.rate or head.rate
        total = most if rate == head.rate else most * rate // head.rate

        def own(first: int, last: int) -> np.ndarray:
            file.seek(head.start + (lo + first) * head.step)
            return head.values(file.read(max(0, last - first) * head.step))

        def place(byte: int) -> int:
            """The first sample of the result that doesn't start before a byte."""
            sample = min(most, max(0, -(-(byte - head.start) // head.step) - lo))
            return sample if rate == head.rate else min(total, -(-sample * rate // head.rate))

        first, last = place(a) if a else 0, place(b) if b < size else total
        read = own if rate == head.rate else lambda i, j: resampled(own, most, head.rate, rate, i, j)
        if self.frame:
            for f in range(-(-first // self.hop), -(-last // self.hop)):
                if f * self.hop + self.frame <= total:
                    yield self.row(head, path, size, f * self.hop, read(f * self.hop, f * self.hop + self.frame), f)
        else:
            for i in range(first, last, self.chunk):
                yield self.row(head, path, size, i, read(i, min(last, i + self.chunk)), None)

    def row(self, head: Head, path: str, size: int, first: int, x: np.ndarray, frame: int | None) -> pa.RecordBatch:
        sides = {"left": x[:, 0], "right": x[:, min(1, x.shape[1] - 1)], "mono": x.mean(1, dtype=np.float32)}
        return self.batch(head, path, size, first=first, frame=frame, **{k: v for k, v in sides.items() if k in self.names})


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def names(self) -> list[str]:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or [n for n in FIELDS if n not in ("error", "frame") or (n == "frame" and "frame" in self.options)]
        unknown = [c for c in wanted if c not in FIELDS]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        return wanted

    def schema(self) -> str:
        return ", ".join(f"`{n}` {_SQL[FIELDS[n]]}" for n in self.names())

    def reader(self, schema) -> WavReader:
        return WavReader(self.options, self.names())


def load(spark: SparkSession, folder: str, *columns: str, **options) -> DataFrame:
    """The files below a folder, by the data source, which is registered first."""
    spark.dataSource.register(WavSource)
    if not spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    told = {k: str(v) for k, v in options.items()} | ({"columns": ",".join(columns)} if columns else {})
    return spark.read.format("wav").options(**told).load(folder)
