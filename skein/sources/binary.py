"""Binary line, field and critical point files as Spark data sources.

Formats: ``skein_bsl``, ``skein_amira`` and ``skein_critical``. Each cuts a file into ranges of
records, so one large file is read by many tasks, and hands Arrow batches to Spark. ``path`` may
be a file or a folder; it may lie on any file system that Arrow knows.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein import schema
from skein.operators.geometry import global_index, line_offsets
from skein.skew import rank_within

RECORDS = 1 << 20        # records of a file that one task reads
HEADER = 16              # bytes before the line sizes of a line file
AMIRA_MAGIC = "# AmiraMesh BINARY-LITTLE-ENDIAN 2.1"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _files(path: str, suffix: str) -> list[str]:
    system, inner = _system(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner))
        return sorted(f.path for f in found if f.path.endswith(suffix))
    return [inner]


def _read(handle, offset: int, dtype: str, count: int) -> np.ndarray:
    handle.seek(offset)
    return np.frombuffer(handle.read(count * np.dtype(dtype).itemsize), dtype=dtype)


@dataclass
class Span(InputPartition):
    """Records [first, last) of a file; ``line`` and ``skip`` locate the first one in its line."""

    file: str
    first: int
    last: int
    n: int = 0
    line: int = 0
    skip: int = 0

    def __post_init__(self):
        super().__init__(None)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.records = int(options.get("records", RECORDS))

    def open(self, file: str):
        return _system(self.path)[0].open_input_file(file)

    def spans(self, file: str, n: int) -> list[Span]:
        return [
            Span(file, a, min(a + self.records, n), n) for a in range(0, n, self.records)
        ]

    def batch(self, file: str, **columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        arrays = {"file": pa.array([file] * size), **{k: pa.array(v) for k, v in columns.items()}}
        return pa.RecordBatch.from_pydict(arrays)


class _LineReader(_Reader):
    def partitions(self):
        out = []
        for file in _files(self.path, ".bsl"):
            with self.open(file) as handle:
                n = int(_read(handle, 0, "<i8", 1)[0])
                out += list(self._cut(handle, file, n))
        return out

    def _cut(self, handle, file: str, n: int):
        """Cut the points evenly while streaming over the sizes, a bounded piece at a time."""
        first, total = 0, 0
        start = (0, 0)
        for at in range(0, n, self.records):
            sizes = _read(handle, HEADER + 8 * at, "<i8", min(self.records, n - at))
            ends = total + np.cumsum(sizes)
            while first + self.records <= ends[-1]:
                border = first + self.records
                line = int(np.searchsorted(ends, border, side="right"))
                yield Span(file, first, border, n, *start)
                before = int(ends[line - 1]) if line else total
                start, first = (at + line, border - before), border
            total = int(ends[-1])
        if first < total:
            yield Span(file, first, total, n, *start)

    def read(self, span: Span):
        with self.open(span.file) as handle:
            base = HEADER + 8 * span.n
            points = _read(handle, base + 12 * span.first, "<f4", 3 * (span.last - span.first))
            points = points.reshape(-1, 3).astype("f8")
            lines, index, line, skip = [], [], span.line, span.skip
            left = len(points)
            while left:
                sizes = _read(handle, HEADER + 8 * line, "<i8", min(1 << 12, span.n - line))
                for size in sizes:
                    take = min(int(size) - skip, left)
                    lines.append(np.full(take, line, dtype="i8"))
                    index.append(np.arange(skip, skip + take, dtype="i4"))
                    left -= take
                    if not left:
                        break
                    line, skip = line + 1, 0
        yield self.batch(
            span.file, line_id=np.concatenate(lines), pt_idx=np.concatenate(index),
            x=points[:, 0], y=points[:, 1], z=points[:, 2],
        )


class LineFile(DataSource):
    """int64 count, int64 zero, the line sizes as int64, then x y z as float32."""

    @classmethod
    def name(cls):
        return "skein_bsl"

    def schema(self):
        return "file string, " + schema.POINTS

    def reader(self, schema):
        return _LineReader(self.options)


def _amira_header(handle) -> tuple[tuple[int, int, int], list[float], int]:
    handle.seek(0)
    raw = handle.read(4096)
    text = raw.decode("latin-1")

    def numbers(pattern: str) -> list[float]:
        found = re.search(pattern, text)
        return [float(t) for t in found.group(1).split()] if found else []

    dims = [int(d) for d in numbers(r"define Lattice((?:\s+\d+){3})")]
    box = numbers(r"BoundingBox((?:\s+[-+.\deE]+){6})")
    parts = re.search(r"Lattice \{ float\[(\d+)\] Data \}", text)
    start = text.find("# Data section follows")
    good = (
        AMIRA_MAGIC in text and len(dims) == 3 and min(dims) > 0 and len(box) == 6
        and all(a <= b for a, b in zip(box[::2], box[1::2]))
        and 'CoordType "uniform"' in text and parts and int(parts.group(1)) == 3 and start > 0
    )
    if not good:
        raise ValueError("not a uniform field with three float components")
    data = raw.index(b"\n", raw.index(b"\n", start) + 1) + 1
    return tuple(dims), box, data


class _FieldReader(_Reader):
    def partitions(self):
        out = []
        for file in _files(self.path, ".am"):
            with self.open(file) as handle:
                dims, _, _ = _amira_header(handle)
                out += self.spans(file, dims[0] * dims[1] * dims[2])
        return out

    def read(self, span: Span):
        with self.open(span.file) as handle:
            dims, _, data = _amira_header(handle)
            cells = _read(handle, data + 12 * span.first, "<f4", 3 * (span.last - span.first))
        cells = cells.reshape(-1, 3).astype("f8")
        i = np.arange(span.first, span.last)

        def valid(column):
            return pa.array(column, mask=np.isnan(cells).any(axis=1))

        yield self.batch(
            span.file, col=(i % dims[0]).astype("i4"), row=(i // dims[0] % dims[1]).astype("i4"),
            layer=(i // (dims[0] * dims[1])).astype("i4"),
            u=valid(cells[:, 0]), v=valid(cells[:, 1]), w=valid(cells[:, 2]),
        )


class FieldFile(DataSource):
    """Uniform AmiraMesh grid of three float32 components, the first axis fastest."""

    @classmethod
    def name(cls):
        return "skein_amira"

    def schema(self):
        return "file string, " + schema.GRID

    def reader(self, schema):
        return _FieldReader(self.options)


class _CriticalReader(_Reader):
    def partitions(self):
        out = []
        for file in _files(self.path, ".cp"):
            with self.open(file) as handle:
                out += self.spans(file, int(_read(handle, 0, "<u4", 1)[0]))
        return out

    def read(self, span: Span):
        count = span.last - span.first
        with self.open(span.file) as handle:
            xyz = _read(handle, 4 + 12 * span.first, "<f4", 3 * count).reshape(-1, 3).astype("f8")
            kind = _read(handle, 4 + 12 * span.n + 4 * span.first, "<i4", count)
            scale = _read(handle, 4 + 16 * span.n + 4 * span.first, "<f4", count)
        yield self.batch(
            span.file, cp_id=np.arange(span.first, span.last, dtype="i8"),
            x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2], type=kind, scale=scale.astype("f8"),
        )


class CriticalFile(DataSource):
    """uint32 count, then all places as float32 triples, all types as int32, all scales as float32."""

    @classmethod
    def name(cls):
        return "skein_critical"

    def schema(self):
        return "file string, " + schema.CRITICAL_POINTS

    def reader(self, schema):
        return _CriticalReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def read_bsl(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, LineFile, path, **options)


def read_amira(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, FieldFile, path, **options)


def read_critical_points(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, CriticalFile, path, **options)


def _put(path: str, at: np.ndarray, data: np.ndarray, start: int, width: int) -> None:
    """Write records at their places, one call per run of neighbours."""
    breaks = np.flatnonzero(np.diff(at) != 1) + 1
    fd = os.open(path, os.O_WRONLY)
    try:
        for run in np.split(np.arange(len(at)), breaks):
            if len(run):
                os.pwrite(fd, data[run].tobytes(), start + int(at[run[0]]) * width)
    finally:
        os.close(fd)


def write_order_file(order: DataFrame, path: str) -> None:
    """The line numbers of an order as int32, each task writing its own run."""
    open(path, "wb").close()

    def put(frames):
        for pdf in frames:
            _put(path, pdf["rank"].to_numpy(), pdf["line_id"].to_numpy().astype("<i4"), 0, 4)
            yield pdf.head(0)[["rank"]]

    ranked = order.select("rank", "line_id").repartitionByRange("rank")
    ranked.sortWithinPartitions("rank").mapInPandas(put, "rank bigint").count()


def write_bsl(points: DataFrame, path: str) -> None:
    """Write one line file in a folder that all executors share.

    The place of every point in the file follows from its global index, so tasks write their own
    runs where they belong. A task that runs twice writes the same bytes again.
    """
    offsets = line_offsets(points)
    ranked = rank_within(offsets, [], ["line_id"], "_ord", dtype="bigint")
    n = offsets.count()
    with open(path, "wb") as handle:
        handle.write(np.asarray([n, 0], dtype="<i8").tobytes())
    base = HEADER + 8 * n

    def put_sizes(frames):
        for pdf in frames:
            _put(path, pdf["_ord"].to_numpy(), pdf["n"].to_numpy().astype("<i8"), HEADER, 8)
            yield pdf.head(0)[["n"]]

    def put_points(frames):
        for pdf in frames:
            data = pdf[["x", "y", "z"]].to_numpy().astype("<f4")
            _put(path, pdf["gid"].to_numpy(), data, base, 12)
            yield pdf.head(0)[["gid"]]

    ordered = ranked.repartitionByRange("_ord").sortWithinPartitions("_ord")
    ordered.select("_ord", "n").mapInPandas(put_sizes, "n bigint").count()
    flat = global_index(points).select("gid", "x", "y", "z")
    spread = flat.repartitionByRange("gid").sortWithinPartitions("gid")
    spread.mapInPandas(put_points, "gid bigint").count()


def convert_folder(spark: SparkSession, source: str, target: str, radius: float = 1.0) -> list[str]:
    """Turn each text line file of a folder into a normalised binary one; returns the new paths."""
    from skein.operators.geometry import normalize
    from skein.sources.text import read_obj

    made = []
    for file in _files(source, ".obj"):
        points = read_obj(spark, file)
        out = os.path.join(target, os.path.basename(file)[:-4] + ".bsl")
        write_bsl(normalize(points, radius), out)
        made.append(out)
    return made
