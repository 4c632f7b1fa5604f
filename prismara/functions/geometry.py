"""Camera geometry as Column expressions.

Everything here stays inside whole-stage code generation, but for the
distortion inverse, whose eight steps are one higher-order function: chained
selects would be substituted into each other by the optimizer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 8
#: z of a ray below which it counts as opposite to +Z.
OPPOSITE = -1 + 1e-6
EPSILON = 2.0

#: The cube faces: viewing direction, and the directions in which columns and rows of the face grow.
#: There is none behind the camera. The suffix of a face's files names another axis than the face itself;
#: both are kept, and this table alone relates them.
FACES: dict[str, dict] = {
    "+Z": {"depth": (0, 0, 1), "col": (1, 0, 0), "row": (0, 1, 0), "suffix": "_dir_plusZ"},
    "-X": {"depth": (-1, 0, 0), "col": (0, 0, 1), "row": (0, 1, 0), "suffix": "_dir_minusY"},
    "+X": {"depth": (1, 0, 0), "col": (0, 0, -1), "row": (0, 1, 0), "suffix": "_dir_plusY"},
    "-Y": {"depth": (0, -1, 0), "col": (1, 0, 0), "row": (0, 0, 1), "suffix": "_dir_minusX"},
    "+Y": {"depth": (0, 1, 0), "col": (1, 0, 0), "row": (0, 0, -1), "suffix": "_dir_plusX"},
}

#: Projections of calibration files that can be converted, and the model each means.
PROJECTIONS = {"equidistant_fisheye": "equidistant", "equisolid_fisheye": "equisolid"}


@dataclass(frozen=True)
class Calibration:
    """One lens. Lengths are pixels; the coefficients that files lack are 0."""

    projection: str
    width: int
    height: int
    f: float
    cx: float = 0.0
    cy: float = 0.0
    k1: float = 0.0
    k2: float = 0.0
    k3: float = 0.0
    k4: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    b1: float = 0.0
    b2: float = 0.0

    @property
    def model(self) -> str:
        return model_of(self.projection)

    def scaled(self, size: int) -> Calibration:
        """The same square lens sampled with ``size`` pixels a side."""
        by = size / self.width
        return Calibration(**asdict(self) | {"width": size, "height": size, "f": self.f * by, "cx": self.cx * by, "cy": self.cy * by})

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in asdict(self).items() if k != "projection"}


#: Columns of a table of lenses, beside ``model`` and its keys.
PARAMETERS = tuple(f.name for f in fields(Calibration) if f.name != "projection")


def model_of(projection: str) -> str:
    """The model of a file's projection; others cannot be converted."""
    if projection not in PROJECTIONS:
        raise ValueError(f"unsupported projection {projection!r}; supported are {', '.join(PROJECTIONS)}")
    return PROJECTIONS[projection]


def normalized(u: Column, v: Column, p: Mapping[str, Column]) -> tuple[Column, Column]:
    """Image coordinates without distortion removed, in focal lengths from the principal point."""
    y = (v - (p["height"] * 0.5 + p["cy"])) / p["f"]
    return (u - (p["width"] * 0.5 + p["cx"]) - p["b2"] * y) / (p["f"] + p["b1"]), y


def undistort_step(a: Column, b: Column, x: Column, y: Column, p: Mapping[str, Column]) -> Column:
    """A struct ``x``, ``y``: one fixed-point step from ``a``, ``b`` towards what distortion turns into ``x``, ``y``."""
    r2 = a * a + b * b
    radial = F.lit(1.0) + r2 * (p["k1"] + r2 * (p["k2"] + r2 * (p["k3"] + r2 * p["k4"])))
    dx = p["p1"] * (r2 + 2 * a * a) + 2 * p["p2"] * a * b
    dy = p["p2"] * (r2 + 2 * b * b) + 2 * p["p1"] * a * b
    return F.struct(((x - dx) / radial).alias("x"), ((y - dy) / radial).alias("y"))


def undistorted(x: Column, y: Column, p: Mapping[str, Column], steps: int = STEPS) -> Column:
    """A struct ``x``, ``y``: the distortion inverted by exactly ``steps`` steps, as one expression.

    Its steps are interpreted; ``operators.rays.undistorted`` takes the same
    ones in generated code.
    """
    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda at, _: undistort_step(at["x"], at["y"], x, y, p))


def _ray(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def unit(x: Column, y: Column, z: Column) -> Column:
    """The direction of a vector."""
    n = F.sqrt(x * x + y * y + z * z)
    return _ray(x / n, y / n, z / n)


def _around(theta: Column, x: Column, y: Column) -> Column:
    phi = F.atan2(y, x)
    return _ray(F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta))


def pinhole(x: Column, y: Column) -> Column:
    return unit(x, y, F.lit(1.0))


def equidistant(x: Column, y: Column) -> Column:
    return _around(F.sqrt(x * x + y * y), x, y)


def equisolid(x: Column, y: Column) -> Column:
    """Beyond the circle that the model reaches, rays point straight back."""
    return _around(2 * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sqrt(x * x + y * y) / 2))), x, y)


def latitude(v: Column, height: Column) -> Column:
    return (v / height - 0.5) * math.pi


def equirectangular(u: Column, v: Column, width: Column, height: Column) -> Column:
    longitude, phi = (u / width - 0.5) * (2 * math.pi), latitude(v, height)
    return _ray(F.cos(phi) * F.sin(longitude), F.sin(phi), F.cos(phi) * F.cos(longitude))


MODELS = {"pinhole": pinhole, "equidistant": equidistant, "equisolid": equisolid}


def ray(model: str, x: Column, y: Column) -> Column:
    """The ray of undistorted coordinates; an unknown model is an error."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    return MODELS[model](x, y)


def ray_by(model: Column, x: Column, y: Column, u: Column, v: Column, width: Column, height: Column) -> Column:
    """The ray by the model that each row names; an unknown one fails the query."""
    unknown = F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(model, F.lit("null"))))
    out = F.when(model == "equirectangular", equirectangular(u, v, width, height))
    for name, of in MODELS.items():
        out = out.when(model == name, of(x, y))
    return out.otherwise(_ray(*(unknown.cast("double"),) * 3))


def model_column(projection: Column) -> Column:
    """``model_of`` as a column: the model of a file's projection; another fails the query."""
    out = F.raise_error(F.concat(F.lit("unsupported projection "), F.coalesce(projection, F.lit("null")))).cast("string")
    for name, model in PROJECTIONS.items():
        out = F.when(projection == name, model).otherwise(out)
    return out


def quaternion(x: Column, y: Column, z: Column) -> Column:
    """A struct ``w``, ``x``, ``y``, ``z``: the turn from +Z to a ray; half a turn around X where that is not unique."""
    n = F.greatest(F.sqrt((z + 1) * (z + 1) + x * x + y * y), F.lit(1e-12))
    behind = z < OPPOSITE
    part = lambda value, there: F.when(behind, F.lit(there)).otherwise(value / n)
    return F.struct(part(z + 1, 0.0).alias("w"), part(-y, 1.0).alias("x"), part(x, 0.0).alias("y"), F.lit(0.0).alias("z"))


def turned(w: Column, x: Column, y: Column, z: Column) -> Column:
    """The ray to which a quaternion turns +Z, not normalised."""
    return _ray(2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y))


def polar_degrees(z: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def azimuth_degrees(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def byte(x: Column) -> Column:
    """Limited to 0..255, then cut to a whole number, not rounded."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("int")


def azimuth_byte(degrees: Column) -> Column:
    return byte((degrees + 255) / 2)


def equirectangular_solid_angle(v: Column, width: Column, height: Column) -> Column:
    return F.cos(latitude(v, height)) * (2 * math.pi) / width * math.pi / height


def gaussian(distance: Column, epsilon: float = EPSILON) -> Column:
    return F.exp(-((distance * epsilon) * (distance * epsilon)))


def _dot(direction: tuple[int, int, int], x: Column, y: Column, z: Column) -> Column:
    """A signed axis of the ray; no arithmetic is left of the zeros."""
    axis = next(i for i, c in enumerate(direction) if c)
    return (x, y, z)[axis] if direction[axis] > 0 else -(x, y, z)[axis]


def on_face(face: str, x: Column, y: Column, z: Column) -> Column:
    """A struct ``a``, ``b``: where a ray meets the plane of a face, in half widths from its middle; null for rays that do not."""
    depth, col, row = (_dot(FACES[face][k], x, y, z) for k in ("depth", "col", "row"))
    return F.when(depth > 0, F.struct((col / depth).alias("a"), (row / depth).alias("b")))
