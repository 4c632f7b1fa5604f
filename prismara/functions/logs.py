"""Progress lines and run logs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROGRESS = r"^\[PROGRESS\]\s+(\S+)\s+(\d+)/(\d+):\s+(.*)"
#: What a run says about itself: field and the expression that finds it. The first that fits a line counts.
#: The format of logs is given, so these and PROGRESS are fixed values.
STATE = {
    "support_source": r"useful_pixel_mask source:\s+(.+)",
    "mask_angle": r"Mask-derived maximum angle:\s+([\d.]+)\s+deg",
    "manual_angle": r"Manual maximum angle:\s+([\d.]+)\s+deg",
    "done": r"\[PROGRESS\]\s+DONE\s+\d+/\d+:\s+processed=(\d+)\s+skipped=(\d+)",
    "fallback_masks": r"Resolved (\d+) missing per-image mask",
}
#: What follows this line and fits none of STATE describes the cameras of the faces; a fixed value.
PINHOLE_START = r"set and FIXED for alignment"


def progress_line(phase: Column, current: Column, total: Column, message: Column) -> Column:
    return F.format_string("[PROGRESS] %s %d/%d: %s", phase, current, total, message)


def progress(line: Column) -> Column:
    """A struct ``phase``, ``current``, ``total``, ``message``; null for other lines."""
    part = lambda i: F.regexp_extract(line, PROGRESS, i)
    return F.when(line.rlike(PROGRESS), F.struct(part(1).alias("phase"), part(2).cast("long").alias("current"), part(3).cast("long").alias("total"), F.trim(part(4)).alias("message")))


def fraction(current: Column, total: Column) -> Column:
    return current / F.greatest(total, F.lit(1))


def kind(line: Column) -> Column:
    """The first field of STATE that a line gives, or ``pinhole_start``, or null."""
    out = F.when(line.rlike(PINHOLE_START), F.lit("pinhole_start"))
    for name, pattern in reversed(STATE.items()):
        out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def values(line: Column, kind_: Column) -> Column:
    """An array of the two values that a line of a kind gives; what it does not give is empty."""
    out = F.array(F.lit(""), F.lit(""))
    for name, pattern in STATE.items():
        second = F.regexp_extract(line, pattern, 2) if name == "done" else F.lit("")
        out = F.when(kind_ == name, F.array(F.regexp_extract(line, pattern, 1), second)).otherwise(out)
    return out


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def message(line: Column) -> Column:
    """What a log line says behind its level and logger; the whole line where it has no such parts; null for blank lines."""
    parts = F.split(line, ": ", 3)
    whole = stripped(line)
    return F.when(F.size(parts) >= 3, stripped(F.element_at(parts, -1))).otherwise(F.when(whole != "", whole))
