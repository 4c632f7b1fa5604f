"""Dilation and erosion by squares of 3 x 3, and connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismara.operators.groups import whole

SEED_WINDOW = 21


def _spread(image: DataFrame, best, steps: int, keys: Sequence[str]) -> DataFrame:
    # A square is a row and a column, so windows along rows and along columns do; frames that end at the edge leave the outside out.
    if steps <= 0:
        return image
    for axis, line in (("u", "v"), ("v", "u")):
        image = image.withColumn("val", best("val").over(Window.partitionBy(*keys, line).orderBy(axis).rowsBetween(-steps, steps)))
    return image


def dilated(image: DataFrame, steps: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """``val`` grown by ``steps`` pixels in all eight directions; ``image`` has every pixel."""
    return _spread(image, F.max, steps, keys)


def eroded(image: DataFrame, steps: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """``val`` shrunk by ``steps`` pixels; the outside takes nothing away."""
    return _spread(image, F.min, steps, keys)


def runs(image: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``v``, ``first``, ``last``: the unbroken runs of foreground (``val`` > 0) of each row."""
    lit = image.where("val > 0")
    island = F.col("u") - F.row_number().over(Window.partitionBy(*keys, "v").orderBy("u"))
    return lit.withColumn("_i", island).groupBy(*keys, "v", "_i").agg(F.min("u").alias("first"), F.max("u").alias("last")).drop("_i")


#: Rows of an image whose runs are labelled together.
STRIP = 256


class _Sets:
    """Disjoint sets of numbers from 0; the smallest of a set stands for it."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


def _contacts(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of runs (``v``, first, last; by row and place) of which one follows in the row after the other's, where columns meet or are neighbours."""
    v, a, b, above = v.tolist(), a.tolist(), b.tolist(), 0
    for i in range(len(v)):
        while above < i and (v[above] < v[i] - 1 or v[above] == v[i] - 1 and b[above] < a[i] - 1):
            above += 1
        j = above
        while j < i and v[j] == v[i] - 1 and a[j] <= b[i] + 1:
            yield j, i
            j += 1


def _joined(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> _Sets:
    """Runs joined where they touch (see :func:`_contacts`)."""
    sets = _Sets(len(v))
    for j, i in _contacts(v, a, b):
        sets.join(j, i)
    return sets


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def labelled(image: DataFrame, keys: Sequence[str] = (), strip: int = STRIP) -> DataFrame:
    """``keys``, ``v``, ``first``, ``last``, ``component``: runs with their 8-connected component, named by its first run (``v`` << 32 | ``first``).

    Pixels are compressed to runs, and runs of ``strip`` rows are joined in one
    group. Where strips meet, the runs of each border tell which of their
    components touch; those contacts alone, no more than half a row's pixels a
    border, are joined for each image. Workers get many such groups at once.
    """
    r = runs(image, keys)
    by = [*keys] or ["_all"]
    if not keys:
        r = r.withColumn("_all", F.lit(0))
    code = lambda v, a: (v.astype(np.int64) << 32) | a

    def apart(rows: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        # Rows of different groups are farther from each other than neighbours.
        v, a, b = (np.asarray(rows.column(c)) for c in ("v", "first", "last"))
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        rank = np.cumsum(np.r_[0, np.where(np.diff(group) > 0, 2, np.minimum(2, np.diff(v.astype(np.int64))))])
        return v, a, b, group, rank

    def alone(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        v, a, b, _, rank = apart(rows, starts)
        part = code(v, a)[_joined(rank, a, b).roots()]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part)], names=[*rows.schema.names, "_part"])

    def touching(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, a, b, group, rank = apart(rows, starts)
        part = np.asarray(rows.column("_part"))
        pairs = {(int(group[i]), int(part[j]), int(part[i])) for j, i in _contacts(rank, a, b)}
        at, x, y = (np.array(c, np.int64) for c in zip(*sorted(pairs), strict=True)) if pairs else np.zeros((3, 0), np.int64)
        of = rows.select(by).take(pa.array(starts[at]))
        yield pa.RecordBatch.from_arrays([*of.columns, pa.array(x), pa.array(y)], names=[*by, "_part", "_other"])

    def together(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        x, y = (np.asarray(rows.column(c)) for c in ("_part", "_other"))
        every = np.stack([np.r_[group, group], np.r_[x, y]], 1)
        names, at = np.unique(every, axis=0, return_inverse=True)
        at, sets = at.ravel(), _Sets(len(names))
        for i, j in zip(at[: len(x)].tolist(), at[len(x) :].tolist(), strict=True):
            sets.join(i, j)
        of = rows.select(by).take(pa.array(starts[names[:, 0]]))
        yield pa.RecordBatch.from_arrays([*of.columns, pa.array(names[:, 1]), pa.array(names[sets.roots(), 1])], names=[*by, "_part", "component"])

    parts = whole(r.withColumn("_strip", F.expr(f"v div {strip}")), [*by, "_strip"], alone, f"{_fields(r)}_strip long, _part long", ["v", "first"])
    last, first = F.col("v") % strip == strip - 1, F.col("v") % strip == 0
    edges = parts.where(last | first).withColumn("_border", F.when(first, F.col("_strip")).otherwise(F.col("_strip") + 1))
    if strip == 1:  # a row is the last and the first of its strip
        edges = parts.withColumn("_border", F.explode(F.array("_strip", F.col("_strip") + 1)))
    some = _fields(r.select(*by))
    contacts = whole(edges, [*by, "_border"], touching, f"{some}_part long, _other long", ["v", "first"])
    names = whole(contacts, by, together, f"{some}_part long, component long")
    out = parts.join(names, [*by, "_part"], "left")
    return out.select(*keys, "v", "first", "last", F.coalesce("component", "_part").alias("component"))


def _filled(image: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``image`` with 255 in the chosen runs and 0 elsewhere."""
    lit = chosen.select(*keys, "v", F.explode(F.sequence("first", "last")).alias("u"), F.lit(255).alias("_in"))
    return image.select(*keys, "v", "u").join(lit, [*keys, "v", "u"], "left").select(*keys, "v", "u", F.coalesce("_in", F.lit(0)).alias("val"))


def _number(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def center_component(
    image: DataFrame, threshold: float | Column, width: int | Column, height: int | Column, value: str = "theta", dilation: int = 1, keys: Sequence[str] = (), strip: int = STRIP
) -> DataFrame:
    """255 where ``value`` is at most ``threshold`` and connected to the middle pixel, then dilated; all 0 if the middle is above it.

    ``keys`` tell images apart. Size and threshold may be columns among them.
    """
    fore = image.select(*keys, "v", "u", F.when(F.col(value) <= _number(threshold), 255).otherwise(0).alias("val"))
    parts = labelled(fore, keys, strip)
    middle = (F.col("v") == F.floor(_number(height) / 2)) & F.floor(_number(width) / 2).between(F.col("first"), F.col("last"))
    return dilated(_filled(fore, parts.join(parts.where(middle).select(*keys, "component"), [*keys, "component"], "left_semi"), keys), dilation, keys)


def seeded_components(image: DataFrame, width: int | Column, height: int | Column, window: int = SEED_WINDOW, keys: Sequence[str] = (), strip: int = STRIP) -> DataFrame:
    """255 in every component of ``val`` > 0 that reaches the middle window; see :func:`center_component`."""
    half = window // 2
    parts = labelled(image, keys, strip)
    v, u = F.floor(_number(height) / 2), F.floor(_number(width) / 2)
    near = F.col("v").between(v - half, v + half) & (F.col("first") <= u + half) & (F.col("last") >= u - half)
    return _filled(image, parts.join(parts.where(near).select(*keys, "component").distinct(), [*keys, "component"], "left_semi"), keys)
