"""Lens calibration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismara.functions.geometry import Calibration

FIELDS: dict[str, T.DataType] = {"projection": T.StringType(), "width": T.IntegerType(), "height": T.IntegerType()}
FIELDS |= {k: T.DoubleType() for k in ("f", "cx", "cy", "k1", "k2", "k3", "p1", "p2")} | {"date": T.StringType()}


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """A row for each ``calibration`` element, at the root or below it; fields that are missing or cannot be read are null, others are left out."""
    schema = T.StructType([T.StructField(k, t) for k, t in FIELDS.items()])
    return spark.read.format("xml").option("rowTag", "calibration").schema(schema).load(path)


def required(calibrations: DataFrame) -> DataFrame:
    """The same rows; one that lacks a field fails the query and names it."""
    lacking = F.concat_ws(", ", *(F.when(F.col(k).isNull(), F.lit(k)) for k in FIELDS))
    message = F.concat(F.lit("calibration lacks "), lacking)
    return calibrations.withColumn("projection", F.when(lacking != "", F.raise_error(message).cast("string")).otherwise(F.col("projection")))


def one_calibration(spark: SparkSession, path: str) -> Calibration:
    """The calibration of one lens; a file without one is an error."""
    rows = required(read_calibrations(spark, path)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: {'no' if not rows else 'more than one'} calibration")
    return Calibration(**{k: rows[0][k] for k in FIELDS if k != "date"})


def summary(calibrations: DataFrame) -> DataFrame:
    """``summary``: projection, size and focal length on a line, with a question mark for what is missing."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return calibrations.select(F.concat(said("projection"), F.lit("  "), said("width"), F.lit("x"), said("height"), F.lit("  f="), said("f")).alias("summary"))
