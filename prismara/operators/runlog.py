"""What a run's log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.functions import logs


def parsed(lines: DataFrame) -> DataFrame:
    """``line_no``, ``phase``, ``current``, ``total``, ``message``, ``fraction``: the progress lines."""
    p = lines.select("line_no", logs.progress(F.col("line")).alias("p")).where("p is not null").select("line_no", "p.*")
    return p.withColumn("fraction", logs.fraction(F.col("current"), F.col("total")))


def facts(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``line_no``, ``kind``, ``first``, ``second``, ``message``: what each line may say about its run."""
    k = lines.select(*keys, "line_no", "line", logs.kind(F.col("line")).alias("kind"))
    said = k.withColumn("_v", logs.values(F.col("line"), F.col("kind")))
    return said.select(*keys, "line_no", "kind", F.col("_v")[0].alias("first"), F.col("_v")[1].alias("second"), logs.message(F.col("line")).alias("message"))


def summary(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run: of every field the last line that gives it, and ``pinhole``: what it says of its cameras.

    A line gives the first field that fits it. From the first line that
    announces the cameras on, messages of lines that give no field are theirs,
    joined by line ends; null for runs that do not announce them.
    """
    k = facts(lines, keys)
    by = keys or ("_all",)
    if not keys:
        k = k.withColumn("_all", F.lit(0))

    def last(names: tuple[str, ...], value: Column) -> Column:
        return F.max_by(F.when(F.col("kind").isin(*names), value), F.when(F.col("kind").isin(*names), F.col("line_no")))

    angles = ("mask_angle", "manual_angle")
    fields = k.groupBy(*by).agg(
        last(("support_source",), logs.stripped(F.col("first"))).alias("support_source"), last(angles, F.col("first")).cast("double").alias("effective_angle"),
        last(angles, F.when(F.col("kind") == "mask_angle", "mask-derived").otherwise("manual")).alias("angle_source"),
        F.coalesce(last(("done",), F.col("first")).cast("long"), F.lit(0)).alias("processed"), F.coalesce(last(("done",), F.col("second")).cast("long"), F.lit(0)).alias("skipped"),
        F.coalesce(last(("fallback_masks",), F.col("first")).cast("long"), F.lit(0)).alias("fallback_masks"),
        F.min(F.when(F.col("kind") == "pinhole_start", F.col("line_no"))).alias("_from"),
    )
    other = k.where("kind is null or kind = 'pinhole_start'").where("message is not null").select(*by, "line_no", "message")
    behind = other.join(fields.where("_from is not null").select(*by, "_from"), [*by]).where("line_no > _from")
    pinhole = behind.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "message"))), lambda x: x["message"]), "\n").alias("pinhole"))
    return fields.join(pinhole, [*by], "left").drop("_from", *([] if keys else ["_all"]))


def report(summary_: DataFrame, lens: str, wall_seconds: float | None = None) -> DataFrame:
    """``report``: the text of a run report."""
    angle = F.format_string("%s maximum angle: %.4f deg", F.when(F.col("angle_source") == "mask-derived", "Mask-derived").otherwise("Manual"), F.col("effective_angle"))
    lines = [F.lit(f"Lens: {lens}"), F.lit(""), F.concat(F.lit("Support source: "), F.coalesce("support_source", F.lit("?"))), F.when(F.col("effective_angle").isNotNull(), angle), F.lit("")]
    lines += [F.concat(F.lit("Processed: "), F.col("processed").cast("string")), F.concat(F.lit("Skipped: "), F.col("skipped").cast("string")), F.when(F.col("fallback_masks") > 0, F.concat(F.lit("Fallback masks used: "), F.col("fallback_masks").cast("string")))]
    lines += [F.lit(f"Wall clock: {wall_seconds:.1f}s")] if wall_seconds is not None else []
    if "pinhole" in summary_.columns:
        said = F.concat(F.lit("\nOutput pinhole camera parameters (set and keep fixed):\n  "), F.regexp_replace("pinhole", "\n", "\n  "))
        lines.append(said)
    return summary_.select(F.concat_ws("\n", *lines, F.lit("")).alias("report"))


def pinhole_parameters(face_width: int) -> dict[str, float]:
    """The camera of every face: set these and keep them fixed."""
    return {"f": face_width / 2} | dict.fromkeys(("cx", "cy", "k1", "k2", "k3", "k4", "p1", "p2", "b1", "b2"), 0.0)
