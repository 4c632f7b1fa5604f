"""Geometry files: five bands of little-endian 32-bit floats, band after band, without a header.

Files are larger than what a task should hold, so both directions go by
strips of rows: readers plan byte ranges and read the bands that are asked
for, and writers put strips where they belong in one file, which gets its name
when all of them are there.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from prismara.functions import geometry as geo
from prismara.sources.sink import file_system

BANDS = ["omega", "qw", "qx", "qy", "qz"]
FORMAT = "geometry_file"
#: Rows of a file that a task reads or writes at a time.
STRIP = 64
_BYTES = 4


@dataclass
class Rows(InputPartition):
    path: str
    top: int
    rows: int


class GeometryReader(DataSourceReader):
    def __init__(self, path: str, width: int, height: int, bands: list[str], strip: int):
        self.path, self.width, self.height, self.bands, self.strip = path, width, height, bands, strip

    def partitions(self) -> list[Rows]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        whole = [info] if info.is_file else system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else []
        some = [f for f in whole if f.is_file and (f is info or f.path.endswith(".raw"))]
        if not some:
            raise ValueError(f"no geometry files at {self.path}")
        for f in some:
            if f.size != len(BANDS) * self.width * self.height * _BYTES:
                raise ValueError(f"{f.path} has another size than {len(BANDS)} bands of {self.width}x{self.height}")
        return [Rows(f.path, top, min(self.strip, self.height - top)) for f in some for top in range(0, self.height, self.strip)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        n = partition.rows * self.width
        with system.open_input_file(partition.path) as f:
            read = [np.frombuffer(f.read_at(n * _BYTES, (BANDS.index(b) * self.height + partition.top) * self.width * _BYTES), "<f4").astype(float) for b in self.bands]
        v, u = (x.ravel().astype(np.int32) for x in np.indices((partition.rows, self.width)))
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array(v + np.int32(partition.top)), pa.array(u), *map(pa.array, read)], names=["path", "v", "u", *self.bands])


@dataclass
class Written(WriterCommitMessage):
    tops: list[int]


class GeometryWriter(DataSourceArrowWriter):
    """Strips (``top``, ``data``: the bands of its rows) of one file, on a file system that the driver and all executors mount."""

    def __init__(self, path: str, width: int, height: int, strip: int):
        self.path, self.width, self.height, self.strip = path.removeprefix("file://"), width, height, strip
        self.part = os.path.join(os.path.dirname(self.path), f".{os.path.basename(self.path)}.{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(self.part), exist_ok=True)
        with open(self.part, "wb") as f:
            f.truncate(len(BANDS) * width * height * _BYTES)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        tops = []
        with open(self.part, "r+b") as f:
            for batch in iterator:
                for top, data in zip(batch.column("top").to_pylist(), batch.column("data"), strict=True):
                    x = np.frombuffer(data.as_buffer(), "<f4").reshape(len(BANDS), -1)
                    if x.shape[1] != min(self.strip, self.height - top) * self.width:
                        raise ValueError("a geometry file needs every pixel once")
                    for i, band in enumerate(x):
                        f.seek((i * self.height + top) * self.width * _BYTES)
                        f.write(band.tobytes())
                    tops.append(top)
        return Written(tops)

    def commit(self, messages: list[Written | None]) -> None:
        tops = sorted(t for m in messages if m for t in m.tops)
        if tops != list(range(0, self.height, self.strip)):
            os.remove(self.part)
            raise ValueError("a geometry file needs every pixel once")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class GeometryFiles(DataSource):
    """Options: path (a file or, for reading, a folder of them), width, height; strip (rows of a task); bands (names, comma-joined) for reading."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _bands(self) -> list[str]:
        bands = [b for b in self.options.get("bands", ",".join(BANDS)).split(",") if b]
        if set(bands) - set(BANDS):
            raise ValueError(f"bands are {', '.join(BANDS)}")
        return bands

    def schema(self) -> str:
        return "path string, v int, u int" + "".join(f", {b} double" for b in self._bands())

    def _common(self) -> tuple[str, int, int]:
        return self.options["path"], int(self.options["width"]), int(self.options["height"])

    def reader(self, schema: StructType) -> GeometryReader:
        return GeometryReader(*self._common(), self._bands(), int(self.options.get("strip", STRIP)))

    def writer(self, schema: StructType, overwrite: bool) -> GeometryWriter:
        return GeometryWriter(*self._common(), int(self.options.get("strip", STRIP)))


def read_raw(spark: SparkSession, path: str, width: int, height: int, bands: Sequence[str] = tuple(BANDS), strip: int = STRIP) -> DataFrame:
    """``path``, ``v``, ``u`` and some bands of geometry files of one size: a file, or those ending in .raw of a folder; another size is an error.

    A task reads the byte ranges of ``strip`` rows of the bands that are asked for.
    """
    spark.dataSource.register(GeometryFiles)
    return spark.read.format(FORMAT).option("width", width).option("height", height).option("strip", strip).option("bands", ",".join(bands)).load(path)


def write_raw(geometry: DataFrame, path: str, width: int, height: int, strip: int = STRIP) -> None:
    """Write a geometry (``v``, ``u`` and the bands), which must hold every pixel once, to a file that appears when it is whole.

    A task holds ``strip`` rows and puts them where they belong, so ``path``
    is on a file system that the driver and all executors mount.
    """

    def work(table: pa.Table) -> pa.Table:
        top = int(table.column("_strip")[0].as_py()) * strip
        rows = min(strip, height - top)
        out = np.full((len(BANDS), max(0, rows) * width), np.nan, "<f4")
        at = (np.asarray(table.column("v")) - np.int64(top)) * width + np.asarray(table.column("u"))
        if rows <= 0 or len(at) != rows * width or len(np.unique(at)) != len(at) or at.min() < 0 or at.max() >= rows * width:
            raise ValueError("a geometry file needs every pixel once")
        for i, band in enumerate(BANDS):
            out[i, at] = np.asarray(table.column(band))
        return pa.table({"top": pa.array([top], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    geometry.sparkSession.dataSource.register(GeometryFiles)
    strips = geometry.select("v", "u", *BANDS, F.expr(f"v div {strip}").alias("_strip")).groupBy("_strip").applyInArrow(work, "top int, data binary")
    strips.write.format(FORMAT).mode("append").option("width", width).option("height", height).option("strip", strip).option("path", path).save()


def raw_name(c: geo.Calibration, model: str | None = None) -> str:
    """The name of a lens's geometry file: eight digits of an md5 stand for the model and the parameters, in this order."""
    model = model or c.model
    given = "_".join([model, *(f"{getattr(c, k):.6g}" for k in ("f", "cx", "cy", "k1", "k2", "k3", "k4", "p1", "p2", "b1", "b2"))])
    return f"camera_{model}_{c.width}x{c.height}_{hashlib.md5(given.encode()).hexdigest()[:8]}.raw"


def export_geometry(spark: SparkSession, c: geo.Calibration, directory: str, model: str | None = None, strip: int = STRIP) -> str:
    """Compute a lens's geometry by one of the four models and write it below ``directory``; the file's path."""
    from prismara.operators.rays import geometry

    path = f"{directory.rstrip('/')}/{raw_name(c, model)}"
    write_raw(geometry(spark, c, model), path, c.width, c.height, strip)
    return path
