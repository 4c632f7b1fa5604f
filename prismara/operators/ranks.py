"""Places in an order, without bringing all rows into one partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id counts rows of a partition in its lower bits.
_BITS = 33


def _checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="prismara-")
        spark.sparkContext.setCheckpointDir(found)


def ranked(df: DataFrame, *order: str, rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with ``rank``, the place of a row from 0 in the order of some columns, and ``total``, the number of rows.

    Rows are sorted by ranges, one for each partition. Partitions are counted,
    and the counts of those before it are added to a row's place within its
    own. The sorted rows are checkpointed, so that both are told of the same
    ranges; nothing runs before the result is asked for. Rows that tie in all
    of ``order`` have places of their own, in any order.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=False)
    counts = placed.groupBy(F.shiftright("_at", _BITS).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each partition: these windows are as long as there are tasks.
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias(total))
    out = placed.join(F.broadcast(starts), F.shiftright("_at", _BITS) == F.col("_part"))
    return out.select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).alias(rank), total)
