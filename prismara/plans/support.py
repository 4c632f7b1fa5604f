"""Which source pixels are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions.geometry import Calibration
from prismara.operators import masks, morphology, rays


def support(spark: SparkSession, c: Calibration, maxangle: float | None = None, count: DataFrame | None = None) -> tuple[DataFrame, float]:
    """``v``, ``u``, ``val``: 255 where the polar angle is at most the largest one, and connected to the middle, grown by a pixel; and that angle.

    Masks do not cut out their own shape: with ``count`` the angle is the
    largest that any of them approves of, and everything inside is used.
    """
    angles = rays.with_angles(rays.with_quaternion(rays.rays(spark, c)))
    if count is not None:
        maxangle = masks.derived_angle(count, angles).first().maxangle
    if maxangle is None:
        raise ValueError("support needs mask counts or an angle")
    return morphology.center_component(angles.select("v", "u", "theta"), maxangle, c.width, c.height), maxangle


def supported_rays(spark: SparkSession, c: Calibration, support_: DataFrame) -> DataFrame:
    """The rays of used pixels; none is an error when they are read."""
    return rays.rays(spark, c).join(support_.where(F.col("val") > 0).select("v", "u"), ["v", "u"])
