"""Pictures of mask counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gray value and colour of the corners of the palette; fixed values, linear between them.
PALETTE = [
    (0, (68, 1, 84)), (8, (72, 35, 116)), (16, (64, 67, 135)), (24, (52, 94, 141)), (32, (41, 121, 142)), (40, (32, 144, 140)),
    (48, (34, 167, 132)), (56, (68, 190, 112)), (64, (121, 209, 81)), (72, (189, 222, 38)), (80, (253, 231, 36)), (255, (253, 231, 36)),
]


def high_count(count: DataFrame) -> DataFrame:
    """``p99``: the count at place floor(0.99 n) in ascending order; if that is 0, the largest; if that is 0 too, 1.

    Counts are at most as many as masks, so they are counted themselves first and ranked after that.
    """
    from pyspark.sql import Window

    each = count.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    upto = F.sum("k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.select("n", total.alias("total"), upto.alias("upto"))
    p99 = F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.99), F.col("n")))
    return ranked.agg(F.when(p99 > 0, p99).otherwise(F.greatest(F.max("n"), F.lit(1))).alias("p99"))


def scaled(n: Column, p99: Column) -> Column:
    return F.least(F.lit(255), (n * 255 / p99).cast("int"))


def colour(gray: Column) -> Column:
    """A struct ``r``, ``g``, ``b``."""
    out = None
    for (x0, c0), (x1, c1) in reversed(list(zip(PALETTE, PALETTE[1:], strict=False))):
        t = (gray - x0) / (x1 - x0)
        here = F.struct(*((F.lit(a) + t * (b - a)).cast("int").alias(k) for k, a, b in zip("rgb", c0, c1, strict=True)))
        out = here if out is None else F.when(gray <= x1, here).otherwise(out)
    return out
