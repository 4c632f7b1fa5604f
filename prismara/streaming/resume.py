"""Images as they arrive: the checkpoint remembers what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismara.functions import paths

SCHEMA = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def arriving(spark: SparkSession, directory: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of decoded images (see sources.images.IMAGE) of a directory."""
    raw = spark.readStream.format("image").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(directory)
    i = raw.where(paths.is_image(F.col("image.origin")) & (F.col("image.height") > 0))
    return i.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def arriving_paths(spark: SparkSession, directory: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of ``path``, ``stem``: image files as they arrive in a directory; their contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    listed = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(directory)
    return listed.where(paths.is_image(F.col("path"))).select("path", paths.stem(F.col("path")).alias("stem"))


def convert_arriving(spark: SparkSession, directory: str, checkpoint: str, convert_batch: Callable[[DataFrame], None], once: bool = True) -> StreamingQuery:
    """Hand each batch of new images to ``convert_batch``; those of earlier runs with this checkpoint are not handed again."""
    writer = arriving(spark, directory).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: convert_batch(df))
    return (writer.trigger(availableNow=True) if once else writer).start()
