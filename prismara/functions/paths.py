"""Paths, names and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismara.functions.geometry import FACES

#: File types that are read, and the endings of those that are written.
READ = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
WRITTEN = {"png": ".png", "tiff": ".tif", "jpg": ".jpg"}
MASK_SUFFIX = "_mask"
#: Part of every cache key; a change of what recipes mean needs another.
RECIPE_VERSION = "1"


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """The last dot of a name and what follows it; empty for names that only begin or end with dots."""
    return F.regexp_extract(name(path), r"[^.].*?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.substring(name(path), F.lit(1), F.char_length(name(path)) - F.char_length(suffix(path)))


def is_image(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*READ)


def mask_base(stem_: Column) -> Column:
    """A stem without one ``_mask`` at its end."""
    return F.regexp_replace(stem_, f"{MASK_SUFFIX}$", "")


def mask_suffix(stem_: Column) -> Column:
    return F.when(F.endswith(stem_, F.lit(MASK_SUFFIX)), MASK_SUFFIX).otherwise("")


def face_suffix(face: Column) -> Column:
    return F.create_map(*(F.lit(x) for f, d in FACES.items() for x in (f, d["suffix"])))[face]


def face_of_suffix(suffix_: Column) -> Column:
    return F.create_map(*(F.lit(x) for f, d in FACES.items() for x in (d["suffix"], f)))[suffix_]


def extension(choice: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in WRITTEN.items() for x in kv))[choice]


def image_output(root: Column, stem_: Column, face: Column, ext: Column, rig: bool = False) -> Column:
    """A directory for each image, or for each face of a rig."""
    folder = F.ltrim(face_suffix(face), F.lit("_")) if rig else stem_
    return F.concat(root, F.lit("/images/"), folder, F.lit("/"), stem_, face_suffix(face), ext)


def mask_output(root: Column, base: Column, face: Column, mask_suffix_: Column) -> Column:
    return F.concat(root, F.lit("/masks/"), base, face_suffix(face), mask_suffix_, F.lit(".png"))


def cache_key(parts: dict[str, Column]) -> Column:
    """An md5 over everything that a recipe depends on, by name; numbers count with twelve decimals."""
    text = [F.concat(F.lit(f"{k}="), F.format_string("%.12f", v) if k in ("maxangle", "epsilon") or k.startswith("param_") else v.cast("string")) for k, v in parts.items()]
    return F.md5(F.concat_ws("|", *text, F.lit(f"version={RECIPE_VERSION}")).cast("binary"))


def is_positive_integer(text: Column) -> Column:
    """Whether a field holds a whole number above 0; single underscores between digits are allowed."""
    plain = F.regexp_replace(F.trim(text), "_", "")
    return F.coalesce(F.trim(text).rlike(r"^\+?\d+(_\d+)*$") & (plain.try_cast("decimal(38,0)") > 0), F.lit(False))
