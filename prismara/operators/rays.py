"""Ray fields and what is derived from them, pixel by pixel.

Functions without ``lens_`` take one lens, whose parameters are literals.
``lens_...`` take a table of lenses, a row each, whose rows choose the model;
results carry the key columns of the table. ``v`` and ``u`` are row and column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismara.functions import geometry as geo
from prismara.sources.grid import CARRIED, lens_pixels, pixels

LENS_KEY = ("lens_id",)


def once(value: Column) -> Column:
    """A column that is computed once for each row: the optimizer substitutes nothing across a generator.

    Without it, every use of a ray would compute the ray again, distortion and all.
    """
    return F.explode_outer(F.array(value))


def _of_row() -> dict[str, Column]:
    return dict(zip(geo.PARAMETERS, map(F.col, CARRIED), strict=True))


def _normalized(grid: DataFrame, p: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    x, y = geo.normalized(F.col("u"), F.col("v"), p)
    return grid.select(*keep, "v", "u", x.alias("xp"), y.alias("yp"))


def _undistorted(grid: DataFrame, p: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    keep = [*keep, "v", "u"]
    d = _normalized(grid, p, keep[:-2]).select("*", F.col("xp").alias("x"), F.col("yp").alias("y"))
    for _ in range(geo.STEPS):  # each in generated code, and each once
        step = once(geo.undistort_step(F.col("x"), F.col("y"), F.col("xp"), F.col("yp"), p))
        d = d.select(*keep, "xp", "yp", step.alias("d")).select(*keep, "xp", "yp", "d.x", "d.y")
    return d.select(*keep, "x", "y")


def normalized(spark: SparkSession, c: geo.Calibration) -> DataFrame:
    return _normalized(pixels(spark, c.width, c.height), c.columns(), ())


def undistorted(spark: SparkSession, c: geo.Calibration) -> DataFrame:
    return _undistorted(pixels(spark, c.width, c.height), c.columns(), ())


def rays(spark: SparkSession, c: geo.Calibration, model: str | None = None) -> DataFrame:
    """``v``, ``u``, ``x``, ``y``, ``z``: the unit ray of every pixel."""
    if model == "equirectangular":
        grid = pixels(spark, c.width, c.height)
        r = grid.select("v", "u", geo.equirectangular(F.col("u"), F.col("v"), F.lit(c.width), F.lit(c.height)).alias("r"))
    else:
        r = undistorted(spark, c).select("v", "u", once(geo.ray(model or c.model, F.col("x"), F.col("y"))).alias("r"))
    return r.select("v", "u", "r.x", "r.y", "r.z")


def lens_normalized(lenses: DataFrame, keys: Sequence[str] = LENS_KEY) -> DataFrame:
    return _normalized(lens_pixels(lenses, keys), _of_row(), keys)


def lens_undistorted(lenses: DataFrame, keys: Sequence[str] = LENS_KEY) -> DataFrame:
    return _undistorted(lens_pixels(lenses, keys), _of_row(), [*keys, *CARRIED]).drop(*CARRIED)


def lens_rays(lenses: DataFrame, keys: Sequence[str] = LENS_KEY, together: bool = False) -> DataFrame:
    """``keys``, ``v``, ``u``, ``x``, ``y``, ``z``: the unit ray of every pixel of every lens.

    ``lenses`` has a row for each lens: ``model`` (pinhole, equidistant,
    equisolid, equirectangular) and the parameters of ``geo.Calibration``;
    ``keys`` tell lenses apart. An unknown model fails the query; a lens whose
    size is null or not positive has no pixels. Further columns are not read.
    ``together`` as in :func:`lens_pixels`.
    """
    d = _undistorted(lens_pixels(lenses, keys, together=together), _of_row(), [*keys, "lens_model", *CARRIED])
    ray = geo.ray_by(*(F.col(c) for c in ("lens_model", "x", "y", "u", "v", "lens_width", "lens_height")))
    return d.select(*keys, "v", "u", once(ray).alias("r")).select(*keys, "v", "u", "r.x", "r.y", "r.z")


def with_quaternion(r: DataFrame) -> DataFrame:
    q = r.withColumn("_q", geo.quaternion(F.col("x"), F.col("y"), F.col("z")))
    return q.select(*r.columns, *(F.col(f"_q.{k}").alias(f"q{k}") for k in "wxyz"))


def with_angles(q: DataFrame) -> DataFrame:
    """Polar and azimuth angle in degrees, from the quaternion."""
    t = q.withColumn("_r", geo.turned(*(F.col(f"q{k}") for k in "wxyz")))
    return t.select(*q.columns, geo.polar_degrees(F.col("_r.z")).alias("theta"), geo.azimuth_degrees(F.col("_r.x"), F.col("_r.y")).alias("phi"))


def with_solid_angle(r: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``omega``: the area between neighbouring rays, by differences: central inside, one-sided at the edges.

    Windows run along single rows and single columns of one image.
    """

    def slope(axis: str, line: str, prefix: str, df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, line).orderBy(axis)
        columns = []
        for k in "xyz":
            before, after = F.lag(k).over(w), F.lead(k).over(w)
            span = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
            columns.append(((F.coalesce(after, F.col(k)) - F.coalesce(before, F.col(k))) / span).alias(prefix + k))
        return df.select("*", *columns)

    d = slope("v", "u", "_b", slope("u", "v", "_a", r))
    cross = [F.col(f"_a{p}") * F.col(f"_b{q}") - F.col(f"_a{q}") * F.col(f"_b{p}") for p, q in ("yz", "zx", "xy")]
    return d.select(*r.columns, F.sqrt(sum((c * c for c in cross[1:]), cross[0] * cross[0])).alias("omega"))


def solid_angle(r: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_solid_angle(r, keys).select(*keys, "v", "u", "omega")


def equirectangular_solid_angle(spark: SparkSession, width: int, height: int) -> DataFrame:
    return pixels(spark, width, height).select("v", "u", geo.equirectangular_solid_angle(F.col("v"), F.lit(width), F.lit(height)).alias("omega"))


def lens_equirectangular_solid_angle(lenses: DataFrame, keys: Sequence[str] = LENS_KEY) -> DataFrame:
    omega = geo.equirectangular_solid_angle(F.col("v"), F.col("lens_width"), F.col("lens_height"))
    return lens_pixels(lenses, keys).select(*keys, "v", "u", omega.alias("omega"))


def geometry(spark: SparkSession, c: geo.Calibration, model: str | None = None) -> DataFrame:
    """``v``, ``u``, ``omega`` and the quaternion: what a geometry file holds."""
    r = rays(spark, c, model)
    if model == "equirectangular":
        with_omega = r.withColumn("omega", geo.equirectangular_solid_angle(F.col("v"), F.lit(c.width), F.lit(c.height)))
    else:
        with_omega = with_solid_angle(r)
    return with_quaternion(with_omega).select("v", "u", "qw", "qx", "qy", "qz", "omega")


def lens_geometry(lenses: DataFrame, keys: Sequence[str] = LENS_KEY) -> DataFrame:
    """``keys``, ``v``, ``u``, the quaternion and ``omega`` of every pixel of every lens, each by its own model; see :func:`lens_rays`."""
    own = [*keys, "model", "width", "height"]
    r = with_solid_angle(lens_rays(lenses, own), own)
    exact = geo.equirectangular_solid_angle(F.col("v"), F.col("width"), F.col("height"))
    omega = F.when(F.col("model") == "equirectangular", exact).otherwise(F.col("omega"))
    return with_quaternion(r.withColumn("omega", omega)).select(*keys, "v", "u", "qw", "qx", "qy", "qz", "omega")
