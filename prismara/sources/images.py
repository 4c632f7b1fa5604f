"""Image files: listing, decoding, encoding and writing.

Spark decodes images but does not write them, so files are encoded in Arrow
batches and leave through ``sources.sink``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions import paths

#: Rows of a decoded image: name, size, channels and the bytes, blue first.
IMAGE = "path string, height int, width int, channels int, data binary"


def image_count(spark: SparkSession, directory: str) -> int:
    """How many image files a directory has."""
    return image_paths(spark, directory).count()


def image_paths(spark: SparkSession, directory: str) -> DataFrame:
    """``path``, ``stem``: the image files of a directory in order, not of those below it."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory).select("path")
    return only_images(listed)


def only_images(listed: DataFrame) -> DataFrame:
    return listed.where(paths.is_image(F.col("path"))).select("path", paths.stem(F.col("path")).alias("stem")).orderBy("path")


def read_images(spark: SparkSession, paths_: str | list[str]) -> DataFrame:
    """Decoded images (IMAGE) of directories or files. A file that cannot be decoded fails the query."""
    image = spark.read.format("image").option("dropInvalid", False).load(paths_)
    bad = F.when(F.col("image.height") < 0, F.raise_error(F.concat(F.lit("cannot decode "), F.col("image.origin"))).cast("string"))
    return image.where(paths.is_image(F.col("image.origin"))).select(F.coalesce(bad, F.col("image.origin")).alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _tags(data: bytes, at: int) -> dict[int, int]:
    """The first numbers of the tags of a TIFF directory, whose file begins at ``at``."""
    order = "<" if data[at : at + 2] == b"II" else ">"
    start = at + struct.unpack_from(order + "I", data, at + 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, start)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, start + 2 + 12 * i)
        place = start + 10 + 12 * i
        if kind in (3, 4):
            if count * (2 if kind == 3 else 4) > 4:
                place = at + struct.unpack_from(order + "I", data, place)[0]
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, place)[0]
    return out


def header(data: bytes) -> tuple[int, int, int, int] | None:
    """Width, height, bits of a sample and orientation (1: upright) that a PNG, JPEG or TIFF file says of itself; nothing is decoded."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return (*struct.unpack_from(">II", data, 16), data[24], 1)
        if data[:4] in (b"II*\0", b"MM\0*"):
            tags = _tags(data, 0)
            return tags[256], tags[257], tags.get(258, 1), tags.get(274, 1)
        if data[:2] == b"\xff\xd8":
            at, turned = 2, 1
            while data[at] == 0xFF:
                kind, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    turned = _tags(data, at + 10).get(274, 1)
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    bits, height, width = struct.unpack_from(">BHH", data, at + 4)
                    return width, height, bits, turned
                at += 2 + length
    except (struct.error, IndexError, KeyError):
        pass
    return None


#: Bytes of a file that are read to find its header; twice as many as often as that does not do.
FIRST_BYTES = 1 << 16


def _read_header(uri: str, size: int) -> tuple[int, int, int, int] | None:
    from prismara.sources.sink import file_system

    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        length = FIRST_BYTES
        while True:
            found = header(f.read_at(min(length, size), 0))
            if found or length >= size:
                return found
            length *= 2


def headers(spark: SparkSession, paths_: str | list[str]) -> DataFrame:
    """``path``, ``width``, ``height``, ``bits``, ``orientation`` of image files; null for those whose header cannot be read.

    Sizes are those of the upright image. Spark lists the files, and workers
    read the beginning of each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _read_header(path, size)
                found.append((None,) * 4 if h is None else (h[1], h[0], *h[2:]) if h[3] >= 5 else h)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.int32()) for i in range(4))], names=["path", "width", "height", "bits", "orientation"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths_).where(paths.is_image(F.col("path")))
    return files.select("path", "length").mapInArrow(work, "path string, width int, height int, bits int, orientation int")


def unfit(headers_: DataFrame, width: int, height: int) -> DataFrame:
    """``path``, ``why``: files that a conversion cannot take."""
    why = F.when(F.col("width").isNull(), "no header of a known format").when((F.col("width") != width) | (F.col("height") != height), "other size than the calibration")
    return headers_.select("path", why.alias("why")).where("why is not null")


def read_any(spark: SparkSession, headers_: DataFrame) -> DataFrame:
    """Decoded images (IMAGE) of the files of ``headers``, upright and of 8 bits a sample.

    Spark's reader takes those it decodes as they are meant; files of more bits
    are decoded by ``sources.decode``, and turned ones are set upright.
    """
    some = headers_.select("path", (F.col("bits") > 8).alias("deep"), F.coalesce("orientation", F.lit(1)).alias("orientation")).collect()  # names, as the listing holds them
    names = {kind: [r.path for r in some if (r.deep, r.orientation != 1) == kind] for kind in ((False, False), (False, True))}
    deep = [r.path for r in some if r.deep]
    bare = lambda path: re.sub("^file:/+", "/", path)  # noqa: E731  # readers spell local paths in different ways
    turn = {bare(r.path): r.orientation for r in some if r.orientation != 1}

    def emitted(path: str, x: np.ndarray) -> pa.RecordBatch:
        from prismara.sources.decode import upright

        x = upright(x, turn.get(bare(path), 1))
        sizes = [pa.array([n], pa.int32()) for n in (*x.shape[:2], 3 if x.ndim == 3 else 1)]
        return pa.RecordBatch.from_arrays([pa.array([path]), *sizes, pa.array([x.tobytes()], pa.binary())], names=["path", "height", "width", "channels", "data"])

    def set_upright(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data in zip(*batch.columns, strict=True):
                x = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), channels.as_py())
                yield emitted(path.as_py(), x[:, :, 0] if x.shape[2] < 3 else x[:, :, :3])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prismara.sources.decode import decoded

        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                try:
                    x = decoded(content.as_buffer().to_pybytes())
                except ValueError as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                yield emitted(path.as_py(), x)

    parts = [read_images(spark, names[False, False])] if names[False, False] else []
    if names[False, True]:
        parts.append(read_images(spark, names[False, True]).mapInArrow(set_upright, IMAGE))
    if deep:
        parts.append(spark.read.format("binaryFile").load(deep).select("path", "content").mapInArrow(decode, IMAGE))
    out = parts[0] if parts else spark.createDataFrame([], IMAGE)
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def wrong_shapes(images: DataFrame, width: int, height: int) -> DataFrame:
    """The rows that have another size than the calibration."""
    return images.where((F.col("width") != width) | (F.col("height") != height)).select("path", "width", "height")


def approved(images: DataFrame, threshold: int, band: int = 64) -> DataFrame:
    """``v``, ``u``, ``n``: how many gray images (IMAGE, of one size) are above ``threshold`` at each pixel.

    A task adds up its images and hands on one count of each band of rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for height, width, channels, data in zip(*batch.columns, strict=True):
                x = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), channels.as_py())
                value = np.floor(x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299 + 0.5) if x.shape[2] >= 3 else x[:, :, 0]
                sums = (value > threshold).astype(np.int64) if sums is None else sums + (value > threshold)
        if sums is not None:
            for top in range(0, len(sums), band):
                yield pa.RecordBatch.from_arrays([pa.array([top], pa.int32()), pa.array([sums.shape[1]], pa.int32()), pa.array([sums[top : top + band].tobytes()], pa.binary())], names=["top", "width", "sums"])

    def together(table: pa.Table) -> pa.Table:
        top, width = table.column("top")[0].as_py(), table.column("width")[0].as_py()
        n = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums")).reshape(-1, width)
        v, u = (i.ravel().astype(np.int32) for i in np.indices(n.shape))
        return pa.table({"v": v + np.int32(top), "u": u, "n": n.ravel()})

    parts = images.select("height", "width", "channels", "data").mapInArrow(work, "top int, width int, sums binary")
    return parts.groupBy("top").applyInArrow(together, "v int, u int, n long")


def exploded(images: DataFrame) -> DataFrame:
    """``path``, ``v``, ``u``, ``b``, ``g``, ``r``: a row for each pixel; gray images have three equal channels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                h, w, c = height.as_py(), width.as_py(), channels.as_py()
                x = np.frombuffer(data.as_py(), np.uint8).reshape(h, w, c)
                bgr = x[:, :, :3] if c >= 3 else np.repeat(x[:, :, :1], 3, 2)
                for top in range(0, h, max(1, 200_000 // w)):
                    part = bgr[top : top + max(1, 200_000 // w)]
                    v, u = (i.ravel().astype(np.int32) for i in np.indices(part.shape[:2]))
                    colours = [pa.array(part[:, :, k].ravel().astype(np.int32)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(u)), pa.array(v + np.int32(top)), pa.array(u), *colours], names=["path", "v", "u", "b", "g", "r"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(work, "path string, v int, u int, b int, g int, r int")


def png(pixels: np.ndarray) -> bytes:
    """An image of bytes or 16-bit numbers, gray or blue-green-red, as a PNG file, packed quickly rather than tightly."""
    deep = pixels.dtype == np.uint16
    if pixels.ndim == 3:
        pixels = pixels[:, :, ::-1]
    height, width = pixels.shape[:2]
    lines = np.ascontiguousarray(pixels.astype(">u2") if deep else pixels).reshape(height, -1).view(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), lines], 1).tobytes()

    def block(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 16 if deep else 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(raw, 1)) + block(b"IEND", b"")


def tiff(pixels: np.ndarray) -> bytes:
    """The same as an uncompressed little-endian TIFF file."""
    height, width = pixels.shape[:2]
    samples = 3 if pixels.ndim == 3 else 1
    bits = pixels.dtype.itemsize * 8
    data = np.ascontiguousarray(pixels[:, :, ::-1] if samples == 3 else pixels).astype(f"<u{bits // 8}").tobytes()
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, samples, None), (259, 3, 1, 1), (262, 3, 1, 2 if samples == 3 else 1), (273, 4, 1, None), (277, 3, 1, samples), (278, 4, 1, height), (279, 4, 1, len(data))]
    start = 8 + 2 + 12 * len(tags) + 4
    depth = struct.pack(f"<{samples}H", *[bits] * samples)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for tag, kind, count, value in tags:
        if tag == 258:
            value = bits if samples == 1 else start
        if tag == 273:
            value = start + len(depth)
        out += struct.pack("<HHII", tag, kind, count, value)
    return out + struct.pack("<I", 0) + depth + data
