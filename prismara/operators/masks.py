"""Matching of images and masks, mask counts, and the angle that masks support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.functions import paths
from prismara.functions.geometry import FACES
from prismara.operators.ranks import ranked

THRESHOLD, BRIGHT, SAMPLES = 127, 5, 8


def duplicate_masks(masks: DataFrame) -> DataFrame:
    """The stems that more than one mask has once ``_mask`` is cut off; there must be none."""
    return masks.groupBy(paths.mask_base(F.col("stem")).alias("base")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def matched(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Every image with its mask, if there is one: ``image_path``, ``stem``, ``mask_path``, ``mask_base``, ``mask_suffix``, ``mask_source``.

    Both sides are ``path``, ``stem``. A mask belongs to the image of its
    stem without ``_mask``; two such masks for one image are an error.
    """
    per_base = masks.groupBy(paths.mask_base(F.col("stem")).alias("base")).agg(F.min("path").alias("mask_path"), F.min("stem").alias("mask_stem"), F.count(F.lit(1)).alias("n"))
    twice = F.raise_error(F.concat(F.lit("more than one mask for stem "), F.col("base"))).cast("string")
    one = per_base.select("base", F.when(F.col("n") > 1, twice).otherwise(F.col("mask_path")).alias("mask_path"), "mask_stem")
    found = F.col("mask_path").isNotNull()
    return images.join(one, F.col("stem") == F.col("base"), "left").select(
        F.col("path").alias("image_path"), "stem", "mask_path", F.col("stem").alias("mask_base"),
        F.when(found, paths.mask_suffix(F.col("mask_stem"))).otherwise(paths.MASK_SUFFIX).alias("mask_suffix"), F.when(found, "per-image-mask").otherwise("fallback-pending").alias("mask_source"),
    )


def with_fallback(items: DataFrame, fallback_path: str) -> DataFrame:
    """The same with ``fallback_path`` where a mask is missing."""
    source = F.when(F.col("mask_path").isNull(), "fallback-useful-pixel-mask").otherwise(F.col("mask_source"))
    return items.withColumns({"mask_source": source, "mask_path": F.coalesce("mask_path", F.lit(fallback_path))})


def counts(items: DataFrame) -> DataFrame:
    """How many images have a mask of their own and how many lack one."""
    return items.agg(F.count_if(F.col("mask_source") == "per-image-mask").alias("matched"), F.count_if(F.col("mask_source") != "per-image-mask").alias("missing"))


def support_source(has_masks: Column, has_lens_mask: Column, field_of_view: Column):
    """Where support comes from and, for a given field of view, half of it: masks before a lens mask before an angle; none is an error."""
    origin = F.when(has_masks, "mask-directory").when(has_lens_mask, "lens-only-mask").when(field_of_view.isNotNull(), "manual-fov")
    return F.coalesce(origin, F.raise_error(F.lit("support needs masks, a lens mask or a field of view")).cast("string")), F.when(~has_masks & ~has_lens_mask, field_of_view / 2)


def expected_outputs(items: DataFrame, root: str, image_ext: str, rig: bool = False) -> DataFrame:
    """``stem``, ``face``, ``kind``, ``path``: five faces of the image and five of the mask for each item."""
    faces = F.explode(F.array(*map(F.lit, FACES))).alias("face")
    each = items.select("stem", "mask_base", "mask_suffix", faces)
    image = paths.image_output(F.lit(root), F.col("stem"), F.col("face"), F.lit(image_ext), rig)
    mask = paths.mask_output(F.lit(root), F.col("mask_base"), F.col("face"), F.col("mask_suffix"))
    both = F.explode(F.array(F.struct(F.lit("image").alias("kind"), image.alias("path")), F.struct(F.lit("mask").alias("kind"), mask.alias("path")))).alias("o")
    return each.select("stem", "face", both).select("stem", "face", "o.kind", "o.path")


def pending(items: DataFrame, outputs: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The items of which an output is missing; all of them if forced."""
    if force:
        return items
    missing = outputs.join(existing.select("path").distinct(), "path", "left_anti").select("stem").distinct()
    return items.join(missing, "stem", "left_semi")


def mask_count(masks: DataFrame) -> DataFrame:
    """``v``, ``u``, ``n``: how many masks approve of each pixel; values above THRESHOLD do."""
    return masks.groupBy("v", "u").agg(F.count_if(F.col("val") > THRESHOLD).alias("n"))


def stored_count(n: Column):
    """As 16 bits hold it."""
    return F.pmod(n, F.lit(65536))


def derived_angle(count: DataFrame, angles: DataFrame) -> DataFrame:
    """``maxangle``: the largest polar angle of a pixel that a mask approves of; none is an error."""
    angle = F.max(F.when(F.col("n") > 0, F.col("theta")))
    return angles.join(count, ["v", "u"]).agg(F.coalesce(angle, F.raise_error(F.lit("no pixel is approved by a mask")).cast("double")).alias("maxangle"))


def even_sample(items: DataFrame, order: str, samples: int = SAMPLES) -> DataFrame:
    """Items evenly spaced in order, the first and the last among them; all, if there are no more than ``samples``; none, if ``samples`` is not positive."""
    placed = ranked(items, order, rank="_rank", total="_total")
    # The ith of m places is i * (n - 1) div max(1, m - 1), so a row is taken if one of them is its own.
    m = F.least(F.col("_total"), F.lit(max(0, samples)))
    ith = F.transform(F.expr(f"sequence(0, {max(1, samples) - 1})"), lambda i: F.when(i < m, F.floor(i * (F.col("_total") - 1) / F.greatest(F.lit(1), m - 1))))
    return placed.where(F.array_contains(F.array_compact(ith), F.col("_rank"))).select(*items.columns)


def bright_anywhere(pixels: DataFrame) -> DataFrame:
    """``v``, ``u``, ``bright``: whether the pixel is bright in any image."""
    return pixels.groupBy("v", "u").agg(F.bool_or(F.col("val") > BRIGHT).alias("bright"))
