"""Rasters, file lists and logs derived from the tables, which hold no images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions import logs
from prismara.functions.geometry import Calibration
from prismara.operators import masks

#: The example lens; fixed values.
LENS = Calibration("equisolid_fisheye", 3840, 3840, 1053.0661329976908, -5.9659420107747714, 0.96044694416563914, 0.079016247653362917, 0.048529911144215856, -0.019338483415952692, 0.0, 0.00026964144026548015, -5.8694221741946647e-05)
#: A lens of 8 x 8 whose pixels lie apart on the faces, so that weights do not depend on rounding.
EVEN_LENS = Calibration("equisolid_fisheye", 8, 8, 3.1, 0.113, -0.071, 0.02, 0.01, -0.004, 0.001, 0.0003, -0.0002, 0.01, 0.005)
ROOT, IMAGES, MASKS = "/out", "/data/images/", "/data/masks/"
PHASES = ("MASK_SUM", "RAYS", "REMAP_PRECOMPUTE", "REMAP_APPLY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id``, ``label``, ``v``, ``u``, ``val``: each embedding as a gray image of 8 x 8."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "e"))
    val = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("e").cast("double") * 220 + 128)).cast("int")
    return e.select("image_id", "label", F.expr("i div 8").cast("int").alias("v"), (F.col("i") % 8).cast("int").alias("u"), val.alias("val"))


def image_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id``, ``v``, ``u``, ``val`` (0 or 255): masks of some of those images."""
    e = table(spark, sf_dir, "embeddings").where("label <> 0").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("image_id", F.expr("i div 8").cast("int").alias("v"), (F.col("i") % 8).cast("int").alias("u"), F.when(F.col("e") > 0, 255).otherwise(0).alias("val"))


def lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lens_id``, ``kind``, ``model`` and parameters: a small lens for each user of ``events``, made of how many events there are and which; the model is one of the fisheyes'."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("lens_id")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    n, lo, hi = (F.col(c) for c in ("n", "lo", "hi"))
    model = F.element_at(F.array(F.lit("equisolid"), F.lit("equidistant")), (n % 2 + 1).cast("int"))
    given = {
        "width": (24 + n % 5).cast("int"), "height": (24 + hi % 3).cast("int"), "f": (24 + n % 5) * (36 + n % 7) / F.lit(100.0), "cx": (lo % 11 - 5) / F.lit(8.0) + 0.013, "cy": (hi % 7 - 3) / F.lit(8.0) + 0.0071,
        "k1": (60 + n % 30) / F.lit(1000.0), "k2": (30 + n % 20) / F.lit(1000.0), "k3": -(15 + n % 5) / F.lit(1000.0), "k4": (n % 2) / F.lit(1000.0), "p1": (n % 5 - 2) / F.lit(10000.0) + 0.00003, "p2": (lo % 5 - 2) / F.lit(10000.0) - 0.00005,
        "b1": (n % 4) / F.lit(100.0), "b2": (hi % 3) / F.lit(200.0),
    }
    return e.select("lens_id", (n % 4).alias("kind"), model.alias("model"), *(v.alias(k) for k, v in given.items()))


def any_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lenses by four models."""
    models = F.array(*map(F.lit, ("equisolid", "equidistant", "pinhole", "equirectangular")))
    return lenses(spark, sf_dir).withColumn("model", F.element_at(models, (F.col("kind") + 1).cast("int")))


def listed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".jpg", ".JPG", ".png", ".tif", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit(IMAGES), stem, ending).alias("path"), stem.alias("stem"), "doc_id")


def listed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, "_mask").otherwise(""))
    return table(spark, sf_dir, "labels").select(F.concat(F.lit(MASKS), stem, F.lit(".png")).alias("path"), stem.alias("stem"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.matched(listed_images(spark, sf_dir).drop("doc_id"), listed_masks(spark, sf_dir))


def existing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs of a third of the images, all but one of another third."""
    out = masks.expected_outputs(items(spark, sf_dir), ROOT, ".png")
    third = F.substring("stem", 5, 20).cast("long") % 3
    return out.where((third == 0) | ((third == 1) & ~((F.col("face") == "+Y") & (F.col("kind") == "mask")))).select("path")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run``, ``line_no``, ``line``: each event as a line of the log of one of ten runs."""
    i = F.col("event_id")
    phase = F.element_at(F.array(*map(F.lit, PHASES)), (i % 4 + 1).cast("int"))
    line = (
        F.when(i % 11 == 0, F.concat(F.lit("INFO: useful_pixel_mask source: "), F.col("event_type")))
        .when(i % 11 == 1, F.format_string("INFO: Mask-derived maximum angle: %d.5 deg", 60 + i % 40))
        .when(i % 11 == 2, F.format_string("INFO: Manual maximum angle: %d deg", 60 + i % 40))
        .when(i % 11 == 3, F.format_string("[PROGRESS] DONE 1/1: processed=%d skipped=%d", i % 97, i % 13))
        .when(i % 11 == 4, F.format_string("INFO: Resolved %d missing per-image mask(s)", i % 29))
        .when(i % 11 == 5, F.concat(F.lit("noise [PROGRESS] "), F.col("event_type")))
        .when(i % 55 == 6, F.lit("INFO: prismara: cameras of all faces, to be set and FIXED for alignment"))
        .when(i % 11 == 7, F.format_string("INFO: prismara:  f: %d px ", i % 1000))
        .otherwise(logs.progress_line(phase, i % 50, F.lit(50).cast("long"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))))
    )
    return table(spark, sf_dir, "events").select((i % 10).alias("run"), i.alias("line_no"), line.alias("line"))
