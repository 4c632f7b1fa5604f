"""Application of recipes to images."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, SparkRuntimeException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions.geometry import FACES, byte

#: Targets of a part of a recipe.
PART = 65_536


def normalized_weights(w: Column) -> Column:
    """An array of weights divided by its sum; zeros where that is 0."""
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.transform(w, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def remapped(pixels: DataFrame, recipe: DataFrame, channels: tuple[str, ...], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Weighted sums of pixels (``src`` and channels) by a recipe, as a join: ``keys``, ``face``, ``row``, ``col`` and the channels, not yet cut to bytes."""
    each = recipe.select("face", "row", "col", F.explode(F.arrays_zip("src", "w")).alias("n")).select("face", "row", "col", "n.src", "n.w")
    met = pixels.join(each, "src")
    return met.groupBy(*keys, "face", "row", "col").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in channels))


def colours(remapped_: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    return remapped_.withColumns({c: byte(F.col(c)) for c in channels})


def mask(remapped_: DataFrame, channel: str = "val") -> DataFrame:
    return remapped_.withColumn(channel, F.when(byte(F.col(channel)) > 127, 255).otherwise(0))


def packed(recipe: DataFrame, face_width: int, part: int = PART) -> DataFrame:
    """``face``, ``k``, ``at``, ``src``, ``w``: recipes in parts, the first neighbours of all targets of a part one behind the other, then the second ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            faces = table.column("face").to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(faces[1:] != faces[:-1]) + 1, len(faces)]
            for a, b in zip(edges, edges[1:], strict=False):
                t = table.slice(a, b - a).combine_chunks()
                k = len(t.column("src")[0])
                flat = [np.asarray(t.column(c).combine_chunks().flatten()).reshape(-1, k).T for c in ("src", "w")]
                row = [pa.array([faces[a]]), pa.array([k], pa.int32()), *(pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary()) for x, kind in ((np.asarray(t.column("at")), np.int32), (flat[0], np.int32), (flat[1], np.float64)))]
                yield pa.RecordBatch.from_arrays(row, names=["face", "k", "at", "src", "w"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= part:
                yield from out()
        if sum(b.num_rows for b in held):
            yield from out()

    rows = recipe.select("face", (F.col("row") * face_width + F.col("col")).cast("int").alias("at"), "src", "w")
    return rows.mapInArrow(work, "face string, k int, at binary, src binary, w binary")


def write_packed(recipe: DataFrame, face_width: int, path: str) -> None:
    """Keep a recipe below ``path``, uncompressed, so that workers of one machine read the same pages."""
    packed(recipe, face_width).write.mode("overwrite").partitionBy("face").option("compression", "none").parquet(path)


def packed_files(kept: DataFrame) -> dict[str, list[str]]:
    """The files of each face of a kept recipe; there are as many as the recipe has parts at most, whatever the number of images."""
    out: dict[str, list[str]] = {}
    for file in sorted(kept.inputFiles()):
        face = unquote(unquote(file).rpartition("/face=")[2].partition("/")[0])
        out.setdefault(face, []).append(unquote(file))
    return out


#: The table, beside a recipe, of what its parts are.
MANIFEST = "_manifest"


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``bytes``, ``digest`` of every part of a recipe."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{path}/face={f}" for f in FACES])
    return parts.select(F.regexp_extract("path", "/(face=[^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """Say what the parts of a kept recipe are: size and digest of each, and how many targets each face has."""
    targets = F.count_distinct("face").alias("faces"), F.sum(F.length("at") / 4).cast("long").alias("targets")
    both = _digests(spark, path).crossJoin(F.broadcast(spark.read.parquet(path).agg(*targets)))
    both.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def verified(spark: SparkSession, path: str) -> bool:
    """Whether a recipe is there with all parts that its manifest names, unchanged, and no others."""
    try:
        said = spark.read.parquet(f"{path}/{MANIFEST}").select("name", "bytes", "digest", F.lit(True).alias("said"))
        met = said.join(_digests(spark, path).withColumn("there", F.lit(True)), ["name", "bytes", "digest"], "full")
        row = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said").isNull() | F.col("there").isNull()).alias("wrong")).first()
    except (AnalysisException, SparkException, Py4JError):  # no manifest, or one that cannot be read
        return False
    return row.n > 0 and row.wrong == 0


def _parts(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(1, columns=["k", "at", "src", "w"]):
                k, at, src, w = (batch.column(i)[0] for i in range(4))
                yield np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(src.as_buffer(), np.int32).reshape(k.as_py(), -1), np.frombuffer(w.as_buffer(), np.float64).reshape(k.as_py(), -1)


def gathered(pixels: np.ndarray, channels: int, src: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums of packed pixels, a byte for each channel, cut to bytes."""
    out = np.zeros((channels, src.shape[1]))
    for places, weights in zip(src, w, strict=True):
        got = np.take(pixels, places)
        for c in range(channels):
            out[c] += weights * ((got >> 8 * c) & 255)
    return np.clip(out, 0, 255).astype(np.uint8).T


def remapped_images(images: DataFrame, files: dict[str, list[str]], face_width: int, threads: int = 1) -> DataFrame:
    """``path``, ``face``, ``is_mask``, ``data``: faces of whole images (see sources.images.IMAGE, and ``is_mask``), pixels as bytes, blue first, or masks of 0 and 255.

    Each image is decoded once, where it is read, and all faces are made of it
    there. Workers read the recipe part by part from ``files``; nothing of it
    passes the driver, and no more than a part is held. With fewer images than
    cores, ``threads`` faces of an image can be made side by side.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(face: str, held: list) -> list[pa.RecordBatch]:
            outs = [np.zeros((face_width * face_width, 1 if h[1] else 3), np.uint8) for h in held]
            for at, src, w in _parts(files[face]):
                for (_, mask_, pixels), out in zip(held, outs, strict=True):
                    out[at] = gathered(pixels, 1 if mask_ else 3, src, w)
            made = []
            for (path, mask_, _), out in zip(held, outs, strict=True):
                data = (np.where(out > 127, 255, 0).astype(np.uint8) if mask_ else out).tobytes()
                made.append(pa.RecordBatch.from_arrays([pa.array([path]), pa.array([face]), pa.array([mask_]), pa.array([data], pa.binary())], names=["path", "face", "is_mask", "data"]))
            return made

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                held = []
                for path, height, width, channels, data, is_mask in zip(*batch.columns, strict=True):
                    c, mask_ = channels.as_py(), is_mask.as_py()
                    x = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py() * width.as_py(), c)
                    pixels = np.zeros((len(x), 4), np.uint8)
                    pixels[:, :3] = x[:, :1] if mask_ or c < 3 else x[:, :3]
                    held.append((path.as_py(), mask_, pixels.view(np.uint32)[:, 0]))
                for made in pool.map(one, files, [held] * len(files)) if threads > 1 else (one(face, held) for face in files):
                    yield from made

    columns = ["path", "height", "width", "channels", "data", "is_mask"]
    return images.select(*columns).mapInArrow(work, "path string, face string, is_mask boolean, data binary")
