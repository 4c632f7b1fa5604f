"""Pixel grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions.geometry import PARAMETERS

#: Rows of a lens that are generated in one task.
BAND = 64


def pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """``v`` (down), ``u`` (right): a row for each pixel, generated where it is used."""
    return spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("v"), F.expr(f"cast(id % {width} as int)").alias("u"))


#: What a pixel carries of its lens, beside ``model``: columns of these names.
CARRIED = tuple(f"lens_{k}" for k in PARAMETERS)


def lens_pixels(lenses: DataFrame, keys: Sequence[str], band: int = BAND, together: bool = False) -> DataFrame:
    """``keys``, ``lens_model`` (null without models) and ``lens_`` with each parameter, ``v``, ``u``: a row for each pixel of each lens.

    Bands of rows are dealt over the tasks before pixels are generated, so
    that neither one large lens nor many lenses of one partition meet in a
    task; what is shuffled is a row for each band. With ``together``, for many
    small lenses, all bands of a lens have one task, so that grouping by
    ``keys`` and more shuffles no pixels.
    """
    model = F.col("model") if "model" in lenses.columns else F.lit(None).cast("string")
    some = lenses.select(*keys, model.alias("lens_model"), *(F.col(k).alias(c) for k, c in zip(PARAMETERS, CARRIED, strict=True))).where("lens_width > 0 and lens_height > 0")
    kept = some.columns
    bands = some.select("*", F.explode(F.expr(f"sequence(0, cast((lens_height - 1) div {band} as int))")).alias("_band"))
    # A stated number of partitions, since adaptive execution would put bands, which are small, into one.
    bands = bands.repartition(int(lenses.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *([] if together else ["_band"]))
    lines = bands.select(*kept, F.explode(F.expr(f"sequence(_band * {band}, least(cast(lens_height as int), (_band + 1) * {band}) - 1)")).alias("v"))
    return lines.select(*kept, "v", F.explode(F.expr("sequence(0, cast(lens_width as int) - 1)")).alias("u"))
