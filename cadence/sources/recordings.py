"""WAV files as a data source: read in ranges of bytes, written a file a recording.

    spark.dataSource.register(recordings.Wav)
    blocks = spark.read.format("wav").option("path", "folder").option("block", 48000).load()
    blocks.write.format("wav").option("path", "out").option("rate", 48000).mode("append").save()

A file's header is read once, when the scan is planned; its samples are ranges of whole blocks, as many tasks as they make.
Equality on ``path`` leaves files out and bounds on ``block`` leave ranges out before anything is opened; both are pushed filters.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Rates that are admitted (give or take one), names of the widths, endings of the files that are read.
RATES, LABELS, ENDINGS = (16_000, 22_050, 44_100, 48_000), {1: "PCM_U8", 2: "PCM_16", 3: "PCM_24", 4: "PCM_32"}, (".wav", ".wave")
#: Bytes of samples that a task reads, about.
RANGE = 16 << 20


def _where(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; both driver and executors open it themselves, not through Spark's readers."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    width: int
    start: int  # of the samples, in bytes
    frames: int

    @property
    def label(self) -> str:
        return LABELS[self.width]

    @property
    def seconds(self) -> float:
        return self.frames / self.rate


def header(read, size: int, name: str = "") -> Header:
    """What a WAV file's chunks say; read(at, n) gives n bytes. Only whole-number samples of one or two channels at an admitted rate are let in."""

    def wrong(why: str) -> ValueError:
        return ValueError(f"{name}: {why}")

    if not size:
        raise wrong("empty")
    top = read(0, 12)
    if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
        raise wrong("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        kind, n = struct.unpack("<4sI", read(at, 8))
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if code == 0xFFFE and n >= 26:  # the extended form names the real one
                code = struct.unpack("<H", read(at + 32, 2))[0]
            if code != 1 or bits not in (8, 16, 24, 32):
                raise wrong(f"samples of form {code}, {bits} bits")
            form = rate, channels, bits // 8
        elif kind == b"data":
            if form is None:
                raise wrong("samples before their form")
            rate, channels, width = form
            n = min(n, size - at - 8)  # a file that was cut off, or written with no length
            if channels not in (1, 2):
                raise wrong(f"{channels} channels")
            near = [r for r in RATES if abs(r - rate) <= 1]
            if not near:
                raise wrong(f"rate {rate} not admitted")
            if not n // (width * channels):
                raise wrong("no samples")
            return Header(near[0], channels, width, at + 8, n // (width * channels))
        at += 8 + n + n % 2
    raise wrong("no samples")


def decode(raw: bytes, h: Header) -> np.ndarray:
    """Samples from -1 to 1; two channels are averaged."""
    if h.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[h.width]).astype(np.float64)
        x = (x - 128) / 128 if h.width == 1 else x / 2.0 ** (8 * h.width - 1)
    return x.reshape(-1, h.channels).mean(1)


def encode(x: np.ndarray, width: int = 3) -> bytes:
    """Samples as whole numbers of 16 or 24 bits, held to what these can tell."""
    top = 2 ** (8 * width - 1)
    whole = np.clip(np.rint(np.asarray(x, float) * top), -top, top - 1).astype("<i4")
    if width == 2:
        return whole.astype("<i2").tobytes()
    return whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def head(frames: int, rate: int, width: int) -> bytes:
    n = frames * width
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate * width, width, 8 * width, b"data", n)


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    first: int  # block
    last: int  # one after


class WavReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block
        self.names: set[str] | None = None
        self.low, self.high = 0, 2**62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("path",), v):
                    self.names = {v} if self.names is None else self.names & {v}
                case In(("path",), v):
                    self.names = set(v) if self.names is None else self.names & set(v)
                case EqualTo(("block",), v):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                case GreaterThan(("block",), v):
                    self.low = max(self.low, v + 1)
                case GreaterThanOrEqual(("block",), v):
                    self.low = max(self.low, v)
                case LessThan(("block",), v):
                    self.high = min(self.high, v - 1)
                case LessThanOrEqual(("block",), v):
                    self.high = min(self.high, v)
                case _:
                    yield f

    def partitions(self) -> list[Range]:
        system, path = _where(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(ENDINGS) and "/_" not in f.path[len(path) :]), key=lambda f: f.path)
        out = []
        for file in files:
            if self.names is not None and file.path not in self.names:
                continue
            with system.open_input_file(file.path) as f:
                h = header(lambda at, n, f=f: f.read_at(n, at), file.size, file.path)
            blocks = -(-h.frames // self.block)
            step = max(1, RANGE // (self.block * h.width * h.channels))
            out += [Range(file.path, h, a, min(a + step, blocks, self.high + 1)) for a in range(max(0, self.low), min(blocks, self.high + 1), step)]
        return out or [Range("", Header(0, 1, 2, 0, 0), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h = partition.header
        if partition.first >= partition.last:
            return
        system, _ = _where(self.path)
        step = h.width * h.channels
        with system.open_input_file(partition.path) as f:
            for k in range(partition.first, partition.last):
                at = k * self.block
                x = decode(f.read_at(min(self.block, h.frames - at) * step, h.start + at * step), h)
                values = [[partition.path], [h.rate], [h.label], [h.frames], [h.seconds], [k], [x]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, TYPES)], NAMES)


NAMES = ["path", "rate", "label", "frames", "seconds", "block", "samples"]
TYPES = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # as written, and the name they get


class WavWriter(DataSourceArrowWriter):
    """Rows (path, block, samples) of a partition, sorted by path and block, as one file a path: written under a name of their own and
    renamed when the job commits. Blocks of one path are in one partition."""

    def __init__(self, folder: str, rate: int, width: int, overwrite: bool):
        if width not in (2, 3):
            raise ValueError("16 or 24 bits are written")
        if overwrite:
            raise ValueError("files are added; name a folder of its own")
        self.folder, self.rate, self.width = folder, rate, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        system, folder = _where(self.folder)
        system.create_dir(f"{folder}/_parts", recursive=True)
        files, name, out, frames, last = [], None, None, 0, -1

        def close() -> None:
            if out is None:
                return
            out.write(b"\0" * (frames * self.width % 2))
            out.close()
            # the length is known at the end: the header is a file of its own until then
            with system.open_input_stream(files[-1][0] + ".raw") as raw, system.open_output_stream(files[-1][0]) as whole:
                whole.write(head(frames, self.rate, self.width))
                while part := raw.read(8 << 20):
                    whole.write(part)
            system.delete_file(files[-1][0] + ".raw")

        for batch in iterator:
            for path, block, samples in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("samples")):
                if path != name:
                    close()
                    name, frames, last = path, 0, -1
                    files.append((f"{folder}/_parts/{uuid.uuid4().hex}.wav", f"{folder}/{path}.wav"))
                    out = system.open_output_stream(files[-1][0] + ".raw")
                if block != last + 1:
                    raise ValueError(f"{path}: block {block} after {last}: rows must be sorted by path and block, and none missing")
                x = samples.values.to_numpy(zero_copy_only=False)
                out.write(encode(x, self.width))
                frames, last = frames + len(x), block
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _where(self.folder)
        names = [f for m in messages if m for f in m.files]
        if len({to for _, to in names}) < len(names):
            raise ValueError("blocks of one path came from several partitions")
        for now, to in names:
            system.move(now, to)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _where(self.folder)
        for now, _ in (f for m in messages if m for f in m.files):
            if system.get_file_info(now).type == fs.FileType.File:
                system.delete_file(now)


class Wav(DataSource):
    """Options: path; block (samples of a row, 48000); when writing rate (48000) and bits (24)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, rate int, label string, frames long, seconds double, block long, samples array<double>"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("block", 48_000)))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], int(self.options.get("rate", 48_000)), int(self.options.get("bits", 24)) // 8, overwrite)


def register(spark) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Wav)
    spark.dataSource.register(Catalogue)


class CatalogueReader(DataSourceReader):
    """Row groups of Parquet files, those that the pushed filters' bounds leave; the filters hold inside as well."""

    PUSHED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}

    def __init__(self, path: str):
        self.path, self.held = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self.PUSHED and len(f.attribute) == 1:
                self.held.append((f.attribute[0], self.PUSHED[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _files(self):
        import pyarrow.dataset as ds

        system, path = _where(self.path)
        return ds.dataset(path, filesystem=system, format="parquet")

    def _condition(self):
        import pyarrow.parquet as pq

        return pq.filters_to_expression([self.held]) if self.held else None

    def partitions(self) -> list[InputPartition]:
        condition, out = self._condition(), []
        for k, part in enumerate(self._files().get_fragments()):
            groups = part.split_by_row_group(condition) if condition is not None else part.split_by_row_group()
            out += [InputPartition((k, g.id)) for piece in groups for g in piece.row_groups]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        k, group = partition.value
        piece = list(self._files().get_fragments())[k].subset(row_group_ids=[group])
        yield from piece.to_batches(filter=self._condition(), schema=self._files().schema)


class Catalogue(DataSource):
    """A catalogue of items kept as Parquet; options: path. What a search asks for is decided by the source, row group by row group."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(CatalogueReader(self.options["path"])._files().schema)

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(self.options["path"])
