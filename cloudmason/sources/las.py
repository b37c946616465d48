"""LAS point clouds as a Spark data source: spark.dataSource.register(LasSource); spark.read.format("las").load(path).

A partition is a range of point records, read by position, so one large file is read by many tasks. Options: path (a file or
a glob), points_per_partition, normals. Compressed LAZ needs the optional laspy library with a LAZ backend.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_file string, row_idx long, x double, y double, z double, semantic_label int, classification int, red int, green int, blue int, nx double, ny double, nz double"
# Fixed values of the LAS specification: record sizes and colour offsets by point format, numpy types by extra-bytes code.
RECORD_SIZE = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
NORMAL_NAMES = {"nx": ("nx", "normal_x", "normalx"), "ny": ("ny", "normal_y", "normaly"), "nz": ("nz", "normal_z", "normalz")}


@dataclass
class Header:
    """What reading point records needs."""

    offset: int
    count: int
    form: int
    size: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    extra: dict[str, tuple[int, str]]
    compressed: bool


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        head = f.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        minor, header_size = head[25], struct.unpack_from("<H", head, 94)[0]
        offset, n_vlr = struct.unpack_from("<II", head, 96)
        form, size, count = struct.unpack_from("<BHI", head, 104)
        if minor >= 4:
            count = struct.unpack_from("<Q", head, 247)[0] or count
        scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        extra, at = {}, RECORD_SIZE.get(form & 0x3F, 0)
        f.seek(header_size)
        for _ in range(n_vlr):
            v = f.read(54)
            user, record, length = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
            body = f.read(length)
            if user == b"LASF_Spec" and record == 4:
                for k in range(0, length, 192):
                    kind = EXTRA_TYPES.get(body[k + 2])
                    if kind is None:
                        raise ValueError(f"extra-bytes type {body[k + 2]} is not supported")
                    extra[body[k + 4 : k + 36].rstrip(b"\0").decode().lower()] = (at, kind)
                    at += np.dtype(kind).itemsize
    return Header(offset, count, form & 0x3F, size, scale, shift, extra, bool(form & 0x80))


def read_points(path: str, h: Header, start: int, stop: int, normals: bool) -> pa.RecordBatch:
    """Records start..stop; semantic_label and normals are extra dimensions, null where the file has none."""
    with open(path, "rb") as f:
        f.seek(h.offset + start * h.size)
        raw = np.frombuffer(f.read((stop - start) * h.size), np.uint8).reshape(-1, h.size)
    n = len(raw)
    get = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]
    cols: dict[str, pa.Array] = {"source_file": pa.array([path] * n), "row_idx": pa.array(np.arange(start, stop))}
    for i, c in enumerate("xyz"):
        cols[c] = pa.array(get(4 * i, "<i4") * h.scale[i] + h.shift[i])
    cls = raw[:, 16].astype(np.int32) if h.form >= 6 else (raw[:, 15] & 0x1F).astype(np.int32)
    label = h.extra.get("semantic_label")
    cols["semantic_label"] = pa.array(get(*label).astype(np.int32)) if label else pa.nulls(n, pa.int32())
    cols["classification"] = pa.array(cls)
    for i, c in enumerate(("red", "green", "blue")):
        cols[c] = pa.array(get(COLOUR_AT[h.form] + 2 * i, "<u2").astype(np.int32)) if h.form in COLOUR_AT else pa.nulls(n, pa.int32())
    for c, names in NORMAL_NAMES.items():
        own = next((h.extra[k] for k in names if k in h.extra), None) if normals else None
        cols[c] = pa.array(get(*own).astype(np.float64)) if own else pa.nulls(n, pa.float64())
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _compressed(path: str, start: int, stop: int) -> pa.RecordBatch:
    try:
        import laspy
    except ImportError as e:
        raise ValueError(f"{path} is compressed; reading LAZ needs laspy with a LAZ backend") from e
    with laspy.open(path) as f:
        f.seek(start)
        p = f.read_points(stop - start)
    n = len(p)
    names = set(p.point_format.dimension_names)
    ints = lambda c: pa.array(np.asarray(p[c]).astype(np.int32)) if c in names else pa.nulls(n, pa.int32())
    cols = [pa.array([path] * n), pa.array(np.arange(start, stop)), *(pa.array(np.asarray(getattr(p, c), float)) for c in "xyz"), ints("semantic_label"), ints("classification"), ints("red"), ints("green"), ints("blue"), *(pa.nulls(n, pa.float64()) for _ in "xyz")]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.paths = sorted(glob.glob(os.path.join(path, "*.la[sz]")) if os.path.isdir(path) else glob.glob(path))
        if not self.paths:
            raise FileNotFoundError(path)
        self.step = int(options.get("points_per_partition", 500_000))
        self.normals = options.get("normals", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(a + self.step, n)) for p in self.paths for n in [read_header(p).count] for a in range(0, n, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h = read_header(partition.path)
        step = 100_000
        for a in range(partition.start, partition.stop, step):
            b = min(a + step, partition.stop)
            yield _compressed(partition.path, a, b) if h.compressed else read_points(partition.path, h, a, b, self.normals)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)
