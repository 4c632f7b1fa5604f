"""Projection of rays onto cube faces, and the recipes that turn source pixels into face pixels.

A recipe depends on the lens alone and serves all its images. For each pixel
of a face it holds the nine nearest source pixels and their weights. Points
are dealt into square tiles with a margin; a tile finds the neighbours of its
own targets and solves for their weights in bounded memory; workers take many
small tiles at once.
Targets whose ninth neighbour may lie beyond the margin are done again with a
wider one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.functions import geometry as geo
from prismara.operators.groups import whole

NEIGHBOURS, PAD, RIDGE = 9, 10, 1e-10
#: Side of a tile in face pixels, and its margins one after the other.
TILE, MARGINS = 64, (8, 32, 128, 512)
#: Targets whose weights are solved for together, and distances that are all computed where a tile has so few.
TOGETHER, FEW = 20_000, 1 << 18
#: Farther than this from all points, the Gaussian is 0 in double precision, and so are all weights.
REACH = 13.66


def projected(rays: DataFrame, faces: tuple[str, ...] = tuple(geo.FACES), keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``v``, ``u``, ``face``, ``a``, ``b``: where rays meet faces, in half widths; a ray meets up to three."""
    hits = F.array(*(F.struct(F.lit(f).alias("face"), geo.on_face(f, F.col("x"), F.col("y"), F.col("z")).alias("at")) for f in faces))
    return rays.select(*keys, "v", "u", F.explode(hits).alias("h")).where("h.at is not null").select(*keys, "v", "u", "h.face", "h.at.a", "h.at.b")


def ties(projected_: DataFrame, face_width: int, pad: int = PAD, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``face``, ``u``, ``v``, ``px``, ``py``: source pixels that fall on a face or within ``pad`` pixels of it."""
    half = face_width / 2
    p = projected_.select(*keys, "face", "u", "v", (F.col("a") * half + half).alias("px"), (F.col("b") * half + half).alias("py"))
    inside = [cond for c in ("px", "py") for cond in (F.col(c) + pad >= 0, F.col(c) - pad < face_width)]
    return p.where(inside[0] & inside[1] & inside[2] & inside[3])


def tie_counts(ties_: DataFrame, keys: Sequence[str] = (), lenses: DataFrame | None = None) -> DataFrame:
    """``keys``, ``face``, ``n``: for every face, also those without; of all ``lenses``, if given, else of those that have ties."""
    counted = ties_.groupBy(*keys, "face").agg(F.count(F.lit(1)).alias("n"))
    if keys:
        every = (counted if lenses is None else lenses).select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, geo.FACES))).alias("face"))
    else:
        every = ties_.sparkSession.createDataFrame([(f,) for f in geo.FACES], "face string")
    return every.join(counted, [*keys, "face"], "left").select(*keys, "face", F.coalesce("n", F.lit(0)).alias("n"))


def nearest(px: np.ndarray, py: np.ndarray, row: np.ndarray, col: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """For each target the places of its ``k`` nearest points and their squared distances; of those that agree to nine decimals the first."""
    d2 = (px[None, :] - col[:, None]) ** 2 + (py[None, :] - row[:, None]) ** 2
    key = np.round(d2, 9)
    some = 2 * k
    if len(px) <= some:
        first = np.argsort(key, 1, kind="stable")[:, :k]
    else:
        near = np.sort(np.argpartition(key, some - 1, 1)[:, :some], 1)
        values = np.take_along_axis(key, near, 1)
        at = np.argsort(values, 1, kind="stable")
        first = np.take_along_axis(near, at[:, :k], 1)
        tied = np.take_along_axis(values, at[:, k - 1 : k], 1)[:, 0] >= values.max(1)  # others may be as near as the kth
        if tied.any():
            first[tied] = np.argsort(key[tied], 1, kind="stable")[:, :k]
    return first, np.take_along_axis(d2, first, 1)


def searched(px: np.ndarray, py: np.ndarray, row: np.ndarray, col: np.ndarray, margin: float, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """The same among many points, block by block of targets, with a margin that suits how densely points lie and grows where it has to.

    A target with fewer than ``k`` points in sight of the last margin has
    infinite distances, but for the first if a point is in sight.
    """
    by_row = np.argsort(py, kind="stable")
    sorted_rows = py[by_row]
    at, d2 = np.zeros((len(row), k), np.int64), np.full((len(row), k), np.inf)
    area = max(1.0, np.ptp(px) * np.ptp(py)) if len(px) else 1.0
    m = min(margin, float(np.sqrt(4 * k * area / (np.pi * max(1, len(px))))))
    open_ = np.arange(len(row))
    while len(open_):
        side = max(1, int(m))
        key = (row[open_] // side).astype(np.int64) * (1 << 32) + col[open_] // side
        order = np.argsort(key, kind="stable")
        for block in np.split(open_[order], np.flatnonzero(np.diff(key[order])) + 1):
            r, c = row[block], col[block]
            band = by_row[np.searchsorted(sorted_rows, r.min() - m) : np.searchsorted(sorted_rows, r.max() + m, "right")]
            seen = np.sort(band[(px[band] >= c.min() - m) & (px[band] <= c.max() + m)])
            if len(seen) >= k:
                first, d2[block] = nearest(px[seen], py[seen], r, c, k)
                at[block] = seen[first]
            elif len(seen):
                d2[block, 0] = nearest(px[seen], py[seen], r, c, 1)[1][:, 0]
        open_ = open_[d2[open_, -1] > m * m]
        if m >= margin or len(px) < k:
            break
        m = min(margin, 2 * m)
    return at, d2


def solved(px: np.ndarray, py: np.ndarray, d2: np.ndarray, epsilon: float = geo.EPSILON) -> np.ndarray:
    """Gaussian weights of neighbours (``px``, ``py``: targets x k) that add up to 1, or are all 0."""
    apart2 = (px[:, :, None] - px[:, None, :]) ** 2 + (py[:, :, None] - py[:, None, :]) ** 2
    kernel = np.exp(-(epsilon**2) * apart2) + np.eye(px.shape[1]) * RIDGE
    w = np.linalg.solve(kernel, np.exp(-(epsilon**2) * d2)[..., None])[..., 0]
    total = w.sum(1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total != 0)


def recipe(ties_: DataFrame, face_width: int, width: int | Column, everywhere: bool = False, margins: tuple[int, ...] = MARGINS, keys: Sequence[str] = (), rounds: list[DataFrame] | None = None, solve: bool = True) -> DataFrame:
    """``keys``, ``face``, ``row``, ``col``, ``src``, ``d2``, ``w``: neighbours (``v`` * ``width`` + ``u``), squared distances, weights.

    Without ``solve``, ``px`` and ``py`` of the neighbours in place of ``w``.

    Targets whose weights are all 0 are left out unless ``everywhere``; then
    margins grow until every target is served. A face with fewer points than
    neighbours is an error. ``keys`` tell lenses apart; ``width`` may be a
    column among them. What is persisted is added to ``rounds``, to be freed
    when the recipe is written.
    """
    target = [*keys, "face", "row", "col"]
    scarce = ties_.groupBy(*keys, "face").count().where(F.col("count") < NEIGHBOURS).select("face").distinct().collect()
    if scarce:
        raise ValueError(f"fewer than {NEIGHBOURS} source pixels meet {', '.join(sorted(r.face for r in scarce))}")
    of_lens = "".join(f"`{k}` {ties_.schema[k].dataType.simpleString()}, " for k in keys)
    found_ = ("d2", "w") if solve else ("d2", "px", "py")
    schema = f"{of_lens}face string, row int, col int, src array<long>, {''.join(f'{c} array<double>, ' for c in found_)}done boolean"
    points = ties_.select(*keys, "face", (F.col("v").cast("long") * width + F.col("u")).alias("src"), "px", "py")
    reach = [*margins, *([face_width + 2 * PAD] * everywhere)] if margins[-1] < face_width else [m for m in margins if m < face_width] + [face_width + 2 * PAD]

    def attempt(margin: int, left: DataFrame | None, last: bool) -> DataFrame:
        side = TILE if margin < 64 else max(TILE, ceil(face_width / 8))

        def tiles(c: str) -> Column:
            at = lambda x: F.greatest(F.lit(0), F.least(F.lit((face_width - 1) // side), F.floor(x / side))).cast("int")
            # Tiles that a point reaches have a task, also where it lies beyond the margin that is searched first.
            far = max(margin, ceil(REACH))
            return F.explode(F.sequence(at(F.col(c) - far), at(F.col(c) + far)))

        def done(table: pa.Table | pa.RecordBatch, wanted: pa.Table | None = None) -> tuple[np.ndarray, ...]:
            """Of a tile: the targets that are served (``row``, ``col``), their neighbours (``src``, ``px``, ``py``, ``d2``), and the targets left over."""
            tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
            src, px, py = (np.asarray(table.column(c)) for c in ("src", "px", "py"))
            if wanted is None:
                col, row = (x.ravel() for x in np.meshgrid(np.arange(tx * side, min(face_width, (tx + 1) * side)), np.arange(ty * side, min(face_width, (ty + 1) * side))))
            else:
                row, col = np.asarray(wanted.column("row")), np.asarray(wanted.column("col"))
            by_src = np.argsort(src, kind="stable")
            src, px, py = src[by_src], px[by_src], py[by_src]
            if NEIGHBOURS <= len(px) <= FEW // len(row):
                at, d2 = nearest(px, py, row, col)
            else:
                at, d2 = searched(px, py, row, col, np.inf if last else margin)
            served = np.isfinite(d2[:, -1]) & (last | (d2[:, -1] <= margin**2))
            dark = d2[:, 0] > REACH**2 if margin >= REACH else np.zeros(len(row), bool)
            use = served if everywhere else served & ~dark
            open_ = np.zeros(len(row), bool) if last else ~served if everywhere else ~served & ~dark
            at = at[use]
            return row[use], col[use], src[at], px[at], py[at], d2[use], row[open_], col[open_]

        def packed(of: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            """The recipes of tiles: ``of`` has a row for each."""
            row, col, src, px, py, d2, row_left, col_left = (np.concatenate(x) for x in zip(*found, strict=True))
            values = {"d2": d2, "px": px, "py": py}
            if solve:
                values["w"] = np.concatenate([solved(px[i], py[i], d2[i]) for i in np.array_split(np.arange(len(row)), max(1, len(row) // 20_000))])
            n, m = len(row), len(row_left)
            tile_of = np.concatenate([np.repeat(np.arange(len(found)), [len(f[k]) for f in found]) for k in (0, 6)])
            lists = lambda x, t: pa.concat_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), t), NEIGHBOURS).cast(pa.list_(t)), pa.nulls(m, pa.list_(t))])
            names = [*keys, "face"]
            columns = [*of.select(names).take(pa.array(tile_of)).columns, pa.array(np.r_[row, row_left], pa.int32()), pa.array(np.r_[col, col_left], pa.int32()), lists(src, pa.int64()), *(lists(values[c], pa.float64()) for c in found_), pa.array([True] * n + [False] * m)]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "row", "col", "src", *found_, "done"])

        def alone(points_: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found, since, waiting = [], 0, 0
            for k in range(len(starts) - 1):
                found.append(done(points_.slice(starts[k], starts[k + 1] - starts[k])))
                waiting += len(found[-1][0]) + len(found[-1][6])
                if waiting >= TOGETHER or k == len(starts) - 2:
                    yield packed(points_.take(pa.array(starts[since : k + 1])), found)
                    found, since, waiting = [], k + 1, 0

        def together(points_: pa.Table, wanted_: pa.Table) -> pa.Table:
            if points_.num_rows and wanted_.num_rows:
                return pa.Table.from_batches([packed(points_.slice(0, 1).combine_chunks().to_batches()[0], [done(points_, wanted_)])])
            return pa.schema([*(points_.schema.field(k) for k in keys), ("face", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("src", pa.list_(pa.int64())), *((c, pa.list_(pa.float64())) for c in found_), ("done", pa.bool_())]).empty_table()

        dealt = points.select(*keys, "face", "src", "px", "py", tiles("px").alias("tx")).select("*", tiles("py").alias("ty"))
        if left is None:
            return whole(dealt, tile, alone, schema)
        wanted = left.toDF(*target).select(*target, F.floor(F.col("col") / side).cast("int").alias("tx"), F.floor(F.col("row") / side).cast("int").alias("ty"))
        return dealt.groupBy(*tile).cogroup(wanted.groupBy(*tile)).applyInArrow(together, schema)

    tile = [*keys, "face", "tx", "ty"]
    parts, left = [], None
    if everywhere and len(reach) > 1:
        # Tiles that no point reaches have no task in the first round, so all targets are named. In the last round every point reaches all tiles.
        spark = ties_.sparkSession
        targets = spark.range(face_width * face_width).select(F.expr(f"cast(id div {face_width} as int)").alias("row"), F.expr(f"cast(id % {face_width} as int)").alias("col"))
        left = points.select(*keys, "face").distinct().crossJoin(targets)
    for i, margin in enumerate(reach):
        last = i == len(reach) - 1
        got = attempt(margin, left, last)
        if i or not last or rounds is not None:  # else it is read once
            got = got.persist()
        if rounds is not None:
            rounds.append(got)
        parts.append(got.where("done").drop("done"))
        if last:
            break
        again = got.where("not done").select(*target)
        if everywhere:
            again = left.join(got.where("done").select(*target), target, "left_anti")
        if again.isEmpty():
            break
        left = again
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def eliminated(rows: Column, n: int) -> Column:
    """The last column of a system of ``n`` equations (an array of arrays of ``n`` + 1) after Gauss-Jordan elimination, pivots in order.

    A step leaves the column of its pivot out, which no later one reads.
    """

    def step(a: Column, k: Column) -> Column:
        pivot = F.element_at(a, k)
        scaled = F.transform(F.slice(pivot, 2, n), lambda z: z / F.get(pivot, F.lit(0)))
        others = lambda s: F.transform(a, lambda r, i: F.when(i + 1 == k, s).otherwise(F.transform(s, lambda p, j: F.get(r, j + 1) - F.get(r, F.lit(0)) * p)))
        return bound(scaled, others)

    return F.transform(F.aggregate(F.sequence(F.lit(1), F.lit(n)), rows, step), lambda r: F.get(r, F.lit(0)))


def column_weights(points: Column, n: int = NEIGHBOURS, epsilon: float = geo.EPSILON) -> Column:
    """What ``solved`` computes, as a column of an array of ``n`` structs ``px``, ``py``, ``d2``: weights that add up to 1, or are all 0."""
    e = epsilon * epsilon

    def row(of: Column, p: Column, i: Column) -> Column:
        apart = F.transform(of, lambda q, j: F.exp(-e * ((p["px"] - q["px"]) * (p["px"] - q["px"]) + (p["py"] - q["py"]) * (p["py"] - q["py"]))) + F.when(i == j, RIDGE).otherwise(0.0))
        return F.concat(apart, F.array(F.exp(-e * p["d2"])))

    w = eliminated(bound(points, lambda of: F.transform(of, lambda p, i: row(of, p, i))), n)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, z: a + z)
    return bound(w, lambda x: bound(total(x), lambda t: F.transform(x, lambda z: F.coalesce(F.try_divide(z, t), F.lit(0.0)))))


def recipe_by_columns(neighbours: DataFrame, ties_: DataFrame | None, width: int | Column | None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``face``, ``row``, ``col``, ``src``, ``w``: weights of known neighbours (see :func:`recipe`), by joins and column functions alone.

    Neighbours that hold ``px`` and ``py`` stay where they are, and nothing is
    shuffled; those of others are looked up among ``ties_``.
    """
    target = [*keys, "face", "row", "col"]
    if "px" in neighbours.columns:
        placed = neighbours.select(*target, "src", F.arrays_zip("px", "py", "d2").alias("n"))
    else:
        points = ties_.select(*keys, "face", (F.col("v").cast("long") * width + F.col("u")).alias("src"), "px", "py")
        each = neighbours.select(*target, F.posexplode(F.arrays_zip("src", "d2")).alias("k", "n")).select(*target, "k", "n.src", "n.d2")
        # Points grow with the lenses: merged, so that no side passes through the driver.
        placed = each.join(points.hint("merge"), [*keys, "face", "src"]).groupBy(*target).agg(F.array_sort(F.collect_list(F.struct("k", "src", "px", "py", "d2"))).alias("n")).select(*target, "n.src", "n")
    return placed.where(F.col("n")[0]["d2"] <= REACH**2).select(*target, "src", column_weights(F.col("n")).alias("w"))
