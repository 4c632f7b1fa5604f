"""Small pictures of what a conversion has made, as rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions import paths
from prismara.functions.geometry import FACES
from prismara.operators.coverage import PALETTE
from prismara.plans.convert import Options, existing
from prismara.sources import decode, images
from prismara.sources.sink import file_system

#: The largest side of the picture of a face, and of the others; fixed values.
FACE_SIDE, SIDE = 120, 280
VIEWS = ("Cube faces", "Useful pixel mask", "Mask coverage", "Fallback mask", "Run summary")
SCHEMA = "view string, place int, name string, text string, width int, height int, data binary"


def fitted(width: int, height: int, side: int) -> tuple[int, int]:
    """The size with the same shape, as nearly as whole pixels allow, that fits into a square; never larger than before."""
    if max(width, height) <= side:
        return width, height
    shape = width / height
    near = lambda x, of: max(1, min(floor(x), ceil(x), key=of))
    if shape >= 1:
        return side, near(side / shape, lambda n: abs(shape - side / n) if n else 0)
    return near(side * shape, lambda n: abs(shape - n / side)), side


def _areas(before: int, after: int) -> np.ndarray:
    """What share of each pixel of a shorter line is each pixel of a longer one."""
    edge = np.arange(after + 1) * (before / after)
    at = np.arange(before)
    both = np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at)
    return np.clip(both, 0, None) * (after / before)


def thumbnail(pixels: np.ndarray, side: int) -> np.ndarray:
    """Pixels averaged over areas, along columns and then along rows."""
    height, width = pixels.shape[:2]
    w, h = fitted(width, height, side)
    if (w, h) == (width, height):
        return pixels
    flat = _areas(height, h) @ pixels.reshape(height, -1).astype(float)
    out = np.einsum("ij,hjc->hic", _areas(width, w), flat.reshape(h, width, -1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(h, w, *pixels.shape[2:])


def coloured(count: np.ndarray) -> np.ndarray:
    """Mask counts as blue-green-red; see ``operators.coverage``."""
    values = np.sort(count.ravel())
    high = int(values[int(len(values) * 0.99)]) if len(values) else 0
    gray = np.minimum(255, count.astype(np.int64) * 255 // (high or max(int(values[-1:].sum()), 1)))
    x, colours = zip(*PALETTE, strict=True)
    table = np.stack([np.interp(np.arange(256), x, [c[k] for c in colours]) for k in (2, 1, 0)], 1).astype(np.uint8)
    return table[gray]


def first_faces(listed: DataFrame, root: str, ending: str) -> DataFrame:
    """``face``, ``path``: of each face the first file by name in the first folder below ``root``/images, or else in the face's own folder.

    ``listed`` has the ``path`` of every file; faces without one are left out.
    """
    start = f"{root}/images/"
    below = listed.where(F.startswith("path", F.lit(start))).select("path", F.split(F.substring("path", len(start) + 1, 1 << 16), "/").alias("parts")).where("size(parts) = 2")
    named = below.select("path", F.col("parts")[0].alias("folder"), F.col("parts")[1].alias("name"))
    first = named.agg(F.min("folder").alias("first"))
    faces = F.explode(F.create_map(*(F.lit(x) for f, d in FACES.items() for x in (f, d["suffix"]))))
    each = named.crossJoin(F.broadcast(first)).select("*", faces.alias("face", "suffix")).where(F.endswith("name", F.concat("suffix", F.lit(ending))))
    own = F.col("folder") == F.ltrim("suffix", F.lit("_"))
    rank = F.when(F.col("folder") == F.col("first"), 0).when(own, 1)
    return each.where(rank.isNotNull()).groupBy("face").agg(F.min_by("path", F.struct(rank.alias("rank"), "name")).alias("path"))


def previews(spark: SparkSession, o: Options) -> DataFrame:
    """Five views of a conversion's output (SCHEMA): pictures as PNG files, in ``data``, and what is said of them, in ``text``.

    A view that has nothing to show is a row without a picture whose text says
    so; faces that were not made are left out.
    """
    root = f"{o.output}/{o.label}"
    listed = existing(spark, root)
    order = F.create_map(*(F.lit(x) for i, f in enumerate(FACES) for x in (f, i)))
    faces = first_faces(listed, root, paths.WRITTEN[o.format]).select(F.lit(VIEWS[0]).alias("view"), order[F.col("face")].alias("place"), "face", "path")
    single = {VIEWS[1]: ("useful_pixels.png", "not yet written"), VIEWS[2]: ("validpixelcount_16bit.tif", "only written when support comes from masks"), VIEWS[3]: ("fallback_mask.png", "none was needed: all images have masks"), VIEWS[4]: ("run_report.txt", "no run yet")}
    wanted = spark.createDataFrame([(v, 0, None, f"{root}/bonusdata/{n}" if n != "run_report.txt" else f"{root}/{n}", why) for v, (n, why) in single.items()], "view string, place int, face string, path string, why string")
    there = wanted.join(listed.withColumn("found", F.lit(True)), "path", "left").select("view", "place", "face", F.when(F.col("found"), F.col("path")).alias("path"), "why")
    no_face = faces.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(VIEWS[0]).alias("view"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("face"), F.lit(None).cast("string").alias("path"), F.lit("no faces yet").alias("why"))
    every = faces.withColumn("why", F.lit(None).cast("string")).unionAll(there).unionAll(no_face)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = text = data = None
                size: tuple[int | None, int | None] = (None, None)
                if r["path"] is None:
                    text = r["why"]
                else:
                    name = r["path"].rpartition("/")[2]
                    system, path = file_system(r["path"])
                    with system.open_input_file(path) as f:
                        content = f.read()
                    if r["view"] == VIEWS[4]:
                        text = content.decode()
                    else:
                        x = coloured(decode.tiff(content, deep=True)) if r["view"] == VIEWS[2] else None if name.endswith(".jpg") else decode.decoded(content)
                        if x is not None:
                            small = thumbnail(x, FACE_SIDE if r["face"] else SIDE)
                            size, data = (small.shape[1], small.shape[0]), images.png(small)
                        text = f"{FACES[r['face']]['suffix'].lstrip('_')} ({r['face']} face)" if r["face"] else r["view"]
                row = (r["view"], r["place"], name, text, *size, data)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["view", "place", "name", "text", "width", "height", "data"])

    made = every.where(~F.coalesce(F.endswith("path", F.lit(".jpg")), F.lit(False))).mapInArrow(work, SCHEMA)
    if o.format != "jpg":
        return made
    return made.unionAll(_jpeg_faces(spark, faces))


def _jpeg_faces(spark: SparkSession, faces: DataFrame) -> DataFrame:
    """Faces in JPEG files, which Spark decodes."""
    names = faces.collect()  # five at most
    by_path = {r.path: (r.place, r.face) for r in names}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data in zip(*batch.columns, strict=True):
                bare = "/" + path.as_py().partition(":")[2].lstrip("/") if path.as_py().startswith("file:") else path.as_py()
                place, face = by_path[bare]
                x = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), channels.as_py())
                small = thumbnail(x, FACE_SIDE)
                row = [("Cube faces", pa.string()), (place, pa.int32()), (bare.rpartition("/")[2], pa.string()), (f"{FACES[face]['suffix'].lstrip('_')} ({face} face)", pa.string()), (small.shape[1], pa.int32()), (small.shape[0], pa.int32()), (images.png(small), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], names=["view", "place", "name", "text", "width", "height", "data"])

    decoded = images.read_images(spark, [r.path for r in names]) if names else spark.createDataFrame([], images.IMAGE)
    return decoded.mapInArrow(work, SCHEMA)
