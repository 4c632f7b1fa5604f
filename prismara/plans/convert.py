"""Conversion of one lens: calibration, images and masks in, five faces of each out.

The recipe of a lens is computed once, kept as a table under the key of all
it depends on, and applied to every image. Each image is decoded where it is
read; nothing but recipes and paths leaves its task.
"""

from __future__ import annotations

import os
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

import prismara
from prismara.functions import geometry as geo
from prismara.functions import paths
from prismara.operators import faces, masks, morphology, rays, remap, runlog
from prismara.plans.support import support, supported_rays
from prismara.sources import images as files
from prismara.sources import jpeg, raw
from prismara.sources.calibration import one_calibration
from prismara.sources.sink import write_named
from prismara.streaming.resume import arriving_paths


@dataclass(frozen=True)
class Options:
    """``calibration``: file; ``label``: directory of the lens below ``output``; ``max_fov``: whole degrees, for lenses without masks; ``chunk``: images that are converted together."""

    calibration: str
    label: str
    images: str
    output: str
    masks: str | None = None
    lens_mask: str | None = None
    max_fov: int | None = None
    face_width: int = 2100
    rig: bool = False
    format: str = "png"
    force: bool = False
    chunk: int = 1024


def progress(phase: str, current: int, total: int, message: str) -> None:
    print(f"[PROGRESS] {phase} {current}/{total}: {message}", flush=True)


#: The functions that make a file of pixels.
ENCODERS = {"png": files.png, "tiff": files.tiff, "jpg": jpeg.encode}


def encoder(format_: str):
    if format_ not in ENCODERS:
        raise ValueError(f"unknown output format {format_!r}")
    return ENCODERS[format_]


def encoded(shaped: DataFrame, width: int, encode, threads: int = 1) -> DataFrame:
    """``name``, ``data``: files of raw pixels (``name``, ``is_mask``, ``data``); masks are PNG files of one channel.

    With ``threads`` a task makes so many files side by side, in order.
    """

    def made(name: str, is_mask: bool, data: pa.Buffer) -> pa.RecordBatch:
        x = np.frombuffer(data, np.uint8)
        file = files.png(x.reshape(-1, width)) if is_mask else encode(x.reshape(-1, width, 3))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file], pa.binary())], names=["name", "data"])

    def work(batches):
        waiting = deque()
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for name, is_mask, data in zip(*batch.columns, strict=True):
                    waiting.append(pool.submit(made, name.as_py(), is_mask.as_py(), data.as_buffer()))
                    if len(waiting) > threads:
                        yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()

    return shaped.select("name", "is_mask", "data").mapInArrow(work, "name string, data binary")


def raster(pixels: DataFrame, column: str, width: int, height: int, name: str, encode=files.png, deep: bool = False) -> DataFrame:
    """``name``, ``data``: one file of one value for each pixel (``v``, ``u``); an image is one value by its format."""
    kind = np.uint16 if deep else np.uint8

    def work(table: pa.Table) -> pa.Table:
        out = np.zeros((height, width), kind)
        out[np.asarray(table.column("v")), np.asarray(table.column("u"))] = np.asarray(table.column(column)).astype(np.int64).astype(kind)
        return pa.table({"name": [name], "data": pa.array([encode(out)], pa.binary())})

    return pixels.select("v", "u", column, F.lit(0).alias("_all")).groupBy("_all").applyInArrow(work, "name string, data binary")


def cached_recipe(spark: SparkSession, o: Options, c: geo.Calibration, support_: DataFrame, origin: str, maxangle: float) -> DataFrame:
    """The recipe of all faces, read if a table of its key is there and all its parts are as its manifest says, else computed and kept."""
    parts = {"size": F.lit(f"{c.width}x{c.height}"), "model": F.lit(c.model), "maxangle": F.lit(maxangle), "facewidth": F.lit(o.face_width), "neighbours": F.lit(faces.NEIGHBOURS), "epsilon": F.lit(geo.EPSILON), "pad": F.lit(faces.PAD), "origin": F.lit(origin)}
    parts |= {f"param_{k}": F.lit(v) for k, v in asdict(c).items() if isinstance(v, float)}
    key = spark.range(1).select(paths.cache_key(parts)).first()[0]
    path = f"{o.output}/{o.label}/recipes/{key}"
    if remap.verified(spark, path):
        return spark.read.parquet(path)
    used = supported_rays(spark, c, support_)
    ties = faces.ties(faces.projected(used), o.face_width).persist()
    empty = [r.face for r in faces.tie_counts(ties).where("n = 0").collect()]
    if empty:
        raise ValueError(f"no source pixel meets {', '.join(empty)}; those faces would be black")
    rounds: list[DataFrame] = []
    remap.write_packed(faces.recipe(ties, o.face_width, c.width, rounds=rounds), o.face_width, path)
    for r in rounds:
        r.unpersist()
    remap.write_manifest(spark, path)
    ties.unpersist()
    return spark.read.parquet(path)


#: Tables of names are broadcast up to so many rows.
BROADCAST_NAMES = 1_000_000


def sized(names: DataFrame) -> DataFrame:
    """A table of names, to be broadcast if it has no more than BROADCAST_NAMES rows."""
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def existing(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of all files below ``root``; none if it is not there."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    except AnalysisException:
        return spark.createDataFrame([], "path string")


@dataclass(frozen=True)
class Prepared:
    """What all images of a lens share: its calibration, where support came from, its angle, the mask of images without one, and the recipe's files."""

    calibration: geo.Calibration
    origin: str
    angle: float
    fallback: str
    recipe: dict[str, list[str]]


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def _root(o: Options) -> str:
    return f"{o.output}/{o.label}"


def _masks(spark: SparkSession, o: Options) -> DataFrame | None:
    """The masks of a conversion, each of another image."""
    if not o.masks:
        return None
    listed = _plain(files.image_paths(spark, o.masks))
    twice = [r.base for r in masks.duplicate_masks(listed).limit(5).collect()]
    if twice:
        raise ValueError(f"more than one mask for {', '.join(sorted(twice))}")
    return listed


def prepared(spark: SparkSession, o: Options, c: geo.Calibration, listed_masks: DataFrame | None, fallback: bool = True) -> Prepared:
    """Support, geometry files and recipe of a lens, and with ``fallback`` a mask for images without one; a recipe that is there already is read."""
    root = _root(o)
    has_masks = listed_masks is not None and not listed_masks.isEmpty()
    if has_masks or o.lens_mask:
        origin, half = ("mask-directory" if has_masks else "lens-only-mask"), None
        mask_headers = _fitting(files.headers(spark, o.masks if has_masks else o.lens_mask), c, "masks")
        n = mask_headers.count()
        progress("MASK_SUM", 0, n, origin)
        count = files.approved(files.read_any(spark, mask_headers), masks.THRESHOLD).persist()
        write_named(raster(count.withColumn("n", masks.stored_count(F.col("n"))), "n", c.width, c.height, "bonusdata/validpixelcount_16bit.tif", files.tiff, True), root)
        mask_headers.unpersist()
        progress("MASK_SUM", n, n, origin)
    elif o.max_fov is not None:
        origin, half, count = "manual-fov", o.max_fov / 2, None
    else:
        raise ValueError("support needs masks, a lens mask or a field of view")

    progress("RAYS", 0, 1, c.model)
    support_, angle = support(spark, c, half, count)
    support_ = support_.persist()
    geometry = rays.geometry(spark, c).persist()
    angles = rays.with_angles(geometry)
    pictures = [
        raster(support_, "val", c.width, c.height, "bonusdata/useful_pixels.png"),
        raster(angles.withColumn("theta", geo.byte(F.col("theta"))), "theta", c.width, c.height, "bonusdata/polar.png"), raster(angles.withColumn("phi", geo.azimuth_byte(F.col("phi"))), "phi", c.width, c.height, "bonusdata/azimuth.png"),
    ]
    if fallback and not o.lens_mask:
        pictures.append(raster(morphology.eroded(support_), "val", c.width, c.height, "bonusdata/fallback_mask.png"))
    write_named(reduce(DataFrame.unionAll, pictures), root)
    raw.write_raw(geometry, f"{root}/bonusdata/geometry.raw", c.width, c.height)
    geometry.unpersist()
    progress("RAYS", 1, 1, c.model)
    progress("REMAP_PRECOMPUTE", 0, len(geo.FACES), "recipe")
    recipe = remap.packed_files(cached_recipe(spark, o, c, support_, origin, angle))
    progress("REMAP_PRECOMPUTE", len(geo.FACES), len(geo.FACES), "recipe")
    support_.unpersist()
    if count is not None:
        count.unpersist()
    return Prepared(c, origin, float(angle), o.lens_mask or f"{root}/bonusdata/fallback_mask.png", recipe)


def applied(spark: SparkSession, o: Options, lens: Prepared, items: DataFrame) -> None:
    """The faces of some items (``masks.matched``), which appear together when all are made."""
    root = _root(o)
    filled = masks.with_fallback(items, lens.fallback).persist()
    own = filled.select("stem", F.col("mask_path").alias("path"), F.lit("mask").alias("kind"))
    wanted = filled.select("stem", F.col("image_path").alias("path"), F.lit("image").alias("kind")).unionAll(own)
    parts = []
    for kind, column in (("image", "image_path"), ("mask", "mask_path")):
        found = files.headers(spark, [r[0] for r in filled.select(column).distinct().collect()])
        parts.append(_plain(files.read_any(spark, found)).withColumn("is_mask", F.lit(kind == "mask")))
    # With fewer images than cores, faces of an image are made, and their files, side by side.
    threads = len(geo.FACES) if filled.count() < spark.sparkContext.defaultParallelism else 1
    shaped = remap.remapped_images(parts[0].unionAll(parts[1]), lens.recipe, o.face_width, threads)
    outputs = masks.expected_outputs(filled, root, paths.WRITTEN[o.format], o.rig).withColumnRenamed("path", "output")
    names = wanted.join(outputs, ["stem", "kind"]).select("path", "face", (F.col("kind") == "mask").alias("is_mask"), F.expr(f"substring(output, {len(root) + 2})").alias("name"))
    write_named(encoded(shaped.join(sized(names), ["path", "face", "is_mask"]), o.face_width, encoder(o.format), threads), root)
    filled.unpersist()


def convert(spark: SparkSession, o: Options) -> dict:
    """Convert what is not converted yet; counts, angle and where support came from.

    Images are taken ``o.chunk`` at a time, whose names pass the driver; files
    of a chunk appear together, so a run that is stopped goes on where it was.
    """
    began = time.monotonic()
    root = _root(o)
    c = one_calibration(spark, o.calibration)
    c.model  # an unsupported projection ends here
    encoder(o.format)

    images = _plain(files.image_paths(spark, o.images))
    listed_masks = _masks(spark, o)
    items = masks.matched(images, images.limit(0) if listed_masks is None else listed_masks).persist()
    if items.isEmpty():
        raise ValueError(f"no image files in {o.images}")
    outputs = masks.expected_outputs(items, root, paths.WRITTEN[o.format], o.rig)
    todo = masks.pending(items, outputs, existing(spark, root), o.force).persist()
    total, open_ = items.count(), todo.count()
    if not open_:
        progress("DONE", 1, 1, f"processed=0 skipped={total}")
        items.unpersist()
        todo.unpersist()
        return {"processed": 0, "skipped": total}
    open_headers = _plain(files.headers(spark, o.images)).join(sized(todo.select(F.col("image_path").alias("path"))), "path", "left_semi")
    _fitting(open_headers, c, "images").unpersist()

    fallbacks = todo.where("mask_path is null").count()
    lens = prepared(spark, o, c, listed_masks, fallbacks > 0)
    done = 0
    progress("REMAP_APPLY", done, open_, "images")
    rows = todo.orderBy("stem").toLocalIterator()
    while chunk := list(islice(rows, o.chunk)):
        applied(spark, o, lens, spark.createDataFrame(chunk, todo.schema))
        done += len(chunk)
        progress("REMAP_APPLY", done, open_, chunk[-1].stem)
    progress("DONE", 1, 1, f"processed={open_} skipped={total - open_}")
    out = {"processed": open_, "skipped": total - open_, "support_source": lens.origin, "effective_angle": lens.angle, "angle_source": "manual" if lens.origin == "manual-fov" else "mask-derived", "fallback_masks": fallbacks, "pinhole": runlog.pinhole_parameters(o.face_width)}
    fields = ("support_source", "effective_angle", "angle_source", "processed", "skipped", "fallback_masks")
    cameras = "\n".join(f"{k}: {v:g}" for k, v in out["pinhole"].items())
    row = spark.createDataFrame([(*(out[k] for k in fields), cameras)], "support_source string, effective_angle double, angle_source string, processed long, skipped long, fallback_masks long, pinhole string")
    write_named(runlog.report(row, o.label, time.monotonic() - began).select(F.lit("run_report.txt").alias("name"), F.col("report").cast("binary").alias("data")), root)
    items.unpersist()
    todo.unpersist()
    return out


def convert_stream(spark: SparkSession, o: Options, checkpoint: str, files_per_batch: int = 64, once: bool = True) -> StreamingQuery:
    """Convert images as they arrive in ``o.images``; the lens is prepared once, before the first batch.

    A batch whose files are there already is passed over, so one that was
    stopped before or after its files appeared is not made twice. Images of
    another size than the calibration fail the query. Masks are those that are
    there when a batch is made; the angle is that of the masks at the start.
    """
    c = one_calibration(spark, o.calibration)
    c.model
    encoder(o.format)
    lens = prepared(spark, o, c, _masks(spark, o))
    root = _root(o)

    def batch(paths_: DataFrame, _: int) -> None:
        images = _plain(paths_).persist()
        listed_masks = _masks(spark, o)
        items = masks.matched(images, images.limit(0) if listed_masks is None else listed_masks)
        todo = masks.pending(items, masks.expected_outputs(items, root, paths.WRITTEN[o.format], o.rig), existing(spark, root), o.force).persist()
        names = [r[0] for r in todo.select("image_path").collect()]  # of one batch
        if names:
            _fitting(files.headers(spark, names), c, "images").unpersist()
            applied(spark, o, lens, todo)
        todo.unpersist()
        images.unpersist()

    writer = arriving_paths(spark, o.images, files_per_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _fitting(headers: DataFrame, c: geo.Calibration, what: str) -> DataFrame:
    """The headers of files, kept, all of which can be used."""
    found = headers.persist()
    wrong = files.unfit(found, c.width, c.height).limit(5).collect()
    if wrong:
        raise ValueError(f"{what} that cannot be used: " + ", ".join(f"{r.path} ({r.why})" for r in wrong))
    return found


USAGE = """Images of one fisheye lens become five square pinhole images each: ahead, left, right, up and down.

Give the lens's calibration (XML: projection, width, height, f, cx, cy, k1 to k3, p1, p2, date), a directory of its images, and one of
these: a directory of masks (name or name_mask, white where a pixel is of use), a mask for the lens (--lens-mask), or the
field of view in degrees (--max-fov). Images of another size than the calibration are refused. A run that is repeated
makes what is missing; --force makes everything again. Afterwards set the printed camera and keep it fixed."""


def lens_label(calibration: str) -> str:
    """What a lens is called if nothing is said: the name of its calibration file without the ending."""
    return os.path.splitext(os.path.basename(calibration))[0]


def main(args: list[str] | None = None) -> int:
    import argparse

    p = argparse.ArgumentParser(description="Convert the images of one calibrated lens to five cube faces.")
    p.add_argument("--version", action="version", version=f"prismara {prismara.__version__}")
    p.add_argument("--usage", action="version", version=USAGE)
    for name in ("calibration", "images", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--label", help="directory of the lens below the output; by default the name of the calibration file")
    p.add_argument("--masks")
    p.add_argument("--lens-mask")
    p.add_argument("--max-fov", type=int)
    p.add_argument("--face-width", type=int, default=2100)
    p.add_argument("--rig", action="store_true")
    p.add_argument("--format", choices=list(paths.WRITTEN), default="png")
    p.add_argument("--force", action="store_true")
    got = vars(p.parse_args(args))
    got["label"] = got["label"] or lens_label(got["calibration"])
    if got["max_fov"] is not None and not 0 < got["max_fov"] <= 360:
        p.error("--max-fov must be a whole number of degrees from 1 to 360")
    spark = SparkSession.builder.getOrCreate()
    out = convert(spark, Options(**got | {k: os.path.abspath(got[k]) for k in ("images", "output", "masks", "lens_mask") if got[k]}))
    if "pinhole" in out:
        print("Set and keep fixed: " + ", ".join(f"{k}={v:g}" for k, v in out["pinhole"].items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
