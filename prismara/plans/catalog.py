"""The registered queries and their SQL.

Each query applies one operator to a generated pixel grid or to a fixture made
of a whole table. Computed doubles are rounded to six places on both sides;
adding zero turns a negative zero into a positive one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions import geometry as geo
from prismara.functions import paths
from prismara.operators import coverage, faces, masks, morphology, rays, remap, runlog
from prismara.plans import fixtures as fx
from prismara.sources import grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SMALL, MIDDLE, FACE_SMALL, FACE, ANGLE, NARROW = 8, 64, 4, 8, 100.0, 70.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# SQL of the parts that several queries share. A source of lenses is a SELECT of ``fixtures.lenses``' columns.


def _one(c: geo.Calibration) -> str:
    """One lens with fixed parameters."""
    given = ", ".join(f"{getattr(c, k)!r}{'::DOUBLE' if isinstance(getattr(c, k), float) else ''} AS {k}" for k in geo.PARAMETERS)
    return f"SELECT 0 AS lens_id, '{c.model}' AS model, {given}"


_LENSES = """SELECT lens_id, n % 4 AS kind, (['equisolid', 'equidistant'])[n % 2 + 1] AS model, (24 + n % 5)::INTEGER AS width, (24 + hi % 3)::INTEGER AS height, (24 + n % 5) * (36 + n % 7) / 100.0::DOUBLE AS f,
  (lo % 11 - 5) / 8.0::DOUBLE + 0.013::DOUBLE AS cx, (hi % 7 - 3) / 8.0::DOUBLE + 0.0071::DOUBLE AS cy, (60 + n % 30) / 1000.0::DOUBLE AS k1, (30 + n % 20) / 1000.0::DOUBLE AS k2, -(15 + n % 5) / 1000.0::DOUBLE AS k3, (n % 2) / 1000.0::DOUBLE AS k4,
  (n % 5 - 2) / 10000.0::DOUBLE + 0.00003::DOUBLE AS p1, (lo % 5 - 2) / 10000.0::DOUBLE - 0.00005::DOUBLE AS p2, (n % 4) / 100.0::DOUBLE AS b1, (hi % 3) / 200.0::DOUBLE AS b2
FROM (SELECT user_id AS lens_id, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id)"""


def _with_model(model: str) -> str:
    return f"SELECT * REPLACE ({model} AS model) FROM ({_LENSES})"


_ANY_MODEL = _with_model("(['equisolid', 'equidistant', 'pinhole', 'equirectangular'])[kind + 1]")


def _grid(lens: str) -> str:
    return f"SELECT *, unnest(range(width))::INTEGER AS u FROM (SELECT *, unnest(range(height))::INTEGER AS v FROM ({lens}))"


def _norm(lens: str) -> str:
    return f"SELECT *, (u - (width * 0.5::DOUBLE + cx) - b2 * yp) / (f + b1) AS xp FROM (SELECT *, (v - (height * 0.5::DOUBLE + cy)) / f AS yp FROM ({_grid(lens)}))"


def _undistorted(lens: str) -> str:
    sql = f"SELECT *, xp AS x, yp AS y FROM ({_norm(lens)})"
    for _ in range(geo.STEPS):
        sql = f"SELECT * EXCLUDE (x, y, r2, d), (xp - (p1 * (r2 + 2 * x * x) + 2 * p2 * x * y)) / d AS x, (yp - (p2 * (r2 + 2 * y * y) + 2 * p1 * x * y)) / d AS y FROM (SELECT *, 1 + r2 * (k1 + r2 * (k2 + r2 * (k3 + r2 * k4))) AS d FROM (SELECT *, x * x + y * y AS r2 FROM ({sql})))"
    return sql


def _rays(lens: str) -> str:
    """The ray of every pixel by the model of its lens."""
    return f"""SELECT lens_id, model, width, height, v, u, CASE model WHEN 'pinhole' THEN x / n WHEN 'equirectangular' THEN cos(p) * sin(l) ELSE sin(t) * cos(a) END AS x,
  CASE model WHEN 'pinhole' THEN y / n WHEN 'equirectangular' THEN sin(p) ELSE sin(t) * sin(a) END AS y, CASE model WHEN 'pinhole' THEN 1 / n WHEN 'equirectangular' THEN cos(p) * cos(l) ELSE cos(t) END AS z
FROM (SELECT *, sqrt(x * x + y * y + 1) AS n, atan2(y, x) AS a, CASE WHEN model = 'equidistant' THEN sqrt(x * x + y * y) ELSE 2 * asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sqrt(x * x + y * y) / 2))) END AS t,
  2 * pi() * (u / width::DOUBLE - 0.5::DOUBLE) AS l, pi() * (v / height::DOUBLE - 0.5::DOUBLE) AS p FROM ({_undistorted(lens)}))"""


def _quat(source: str) -> str:
    return f"SELECT * EXCLUDE (n), CASE WHEN z < {geo.OPPOSITE!r}::DOUBLE THEN 0 ELSE (z + 1) / n END AS qw, CASE WHEN z < {geo.OPPOSITE!r}::DOUBLE THEN 1 ELSE -y / n END AS qx, CASE WHEN z < {geo.OPPOSITE!r}::DOUBLE THEN 0 ELSE x / n END AS qy, 0.0::DOUBLE AS qz FROM (SELECT *, greatest(sqrt((z + 1) * (z + 1) + x * x + y * y), 1e-12::DOUBLE) AS n FROM ({source}))"


def _angles(lens: str) -> str:
    return f"SELECT lens_id, width, height, v, u, x, y, z, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 1 - 2 * (qx * qx + qy * qy))))) AS theta, degrees(atan2(2 * (qy * qz - qw * qx), 2 * (qx * qz + qw * qy))) AS phi FROM ({_quat(_rays(lens))})"


def _projected(lens: str) -> str:
    parts = []
    for face, d in geo.FACES.items():
        depth, col, row = (next(("-" if s < 0 else "") + a for a, s in zip("xyz", d[k], strict=True) if s) for k in ("depth", "col", "row"))
        parts.append(f"SELECT lens_id, width, v, u, '{face}' AS face, ({col}) / ({depth}) AS a, ({row}) / ({depth}) AS b FROM s WHERE {depth} > 0")
    return f"(WITH s AS MATERIALIZED (SELECT * FROM ({_angles(lens)}) WHERE theta <= {ANGLE}) {' UNION ALL '.join(parts)})"


def _ties(lens: str, width: int) -> str:
    p = f"SELECT lens_id, width, face, u, v, a * {width / 2}::DOUBLE + {width / 2}::DOUBLE AS px, b * {width / 2}::DOUBLE + {width / 2}::DOUBLE AS py FROM {_projected(lens)}"
    return f"SELECT * FROM ({p}) WHERE px + {faces.PAD} >= 0 AND px - {faces.PAD} < {width} AND py + {faces.PAD} >= 0 AND py - {faces.PAD} < {width}"


def _near(lens: str, width: int) -> str:
    """The nine nearest source pixels of every face pixel, by comparing all."""
    return f"""WITH t AS MATERIALIZED ({_ties(lens, width)}),
g AS (SELECT lens_id, face, (i // {width})::INTEGER AS row, (i % {width})::INTEGER AS col FROM range({width * width}) x(i), (SELECT DISTINCT lens_id, face FROM t)),
d AS (SELECT g.lens_id, g.face, row, col, v::BIGINT * width + u AS src, px, py, (px - col) * (px - col) + (py - row) * (py - row) AS d2 FROM g JOIN t ON t.face = g.face AND t.lens_id = g.lens_id),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lens_id, face, row, col ORDER BY round(d2, 9), src) AS k FROM d) WHERE k <= {faces.NEIGHBOURS})"""


def _solved() -> str:
    """Common table expressions after ``near``: ``w`` with the true weights of every neighbour, by elimination of one pivot after the other."""
    n, e = faces.NEIGHBOURS, geo.EPSILON**2
    kernel = f"exp(-{e} * ((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]))) + CASE WHEN i = j THEN {faces.RIDGE!r}::DOUBLE ELSE 0 END"
    ctes = [
        f"lists AS (SELECT lens_id, face, row, col, list(src ORDER BY k) AS src, list(px ORDER BY k) AS x, list(py ORDER BY k) AS y, list(d2 ORDER BY k) AS d FROM near GROUP BY ALL HAVING min(d2) <= {faces.REACH**2!r}::DOUBLE)",
        f"a0 AS MATERIALIZED (SELECT lens_id, face, row, col, src, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j: CASE WHEN j = {n + 1} THEN exp(-{e} * d[i]) ELSE {kernel} END)) AS a FROM lists)",
    ]
    for k in range(1, n + 1):
        step = f"list_transform(a, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda z: z / r[{k}]) ELSE list_transform(r, lambda z, j: z - r[{k}] / a[{k}][{k}] * a[{k}][j]) END)"
        ctes.append(f"a{k} AS MATERIALIZED (SELECT * REPLACE ({step} AS a) FROM a{k - 1})")
    ctes.append(f"s AS (SELECT lens_id, face, row, col, src, list_transform(a, lambda r: r[{n + 1}]) AS w FROM a{n})")
    ctes.append("w AS (SELECT lens_id, face, row, col, unnest(src) AS src, unnest(list_transform(w, lambda z: CASE WHEN list_sum(w) = 0 THEN 0 ELSE z / list_sum(w) END)) AS w FROM s)")
    return ",\n".join(ctes)


def _listed() -> str:
    return f"SELECT '{fx.IMAGES}doc_' || doc_id || (['.jpg', '.JPG', '.png', '.tif', '.txt'])[doc_id % 5 + 1] AS path, 'doc_' || doc_id AS stem FROM documents"


def _items() -> str:
    m = f"SELECT 'doc_' || doc_id AS base, '{fx.MASKS}doc_' || doc_id || CASE WHEN quality = 1 THEN '_mask' ELSE '' END || '.png' AS mask_path, CASE WHEN quality = 1 THEN '_mask' ELSE '' END AS suffix FROM labels"
    return f"SELECT path AS image_path, stem, mask_path, stem AS mask_base, coalesce(suffix, '_mask') AS mask_suffix, CASE WHEN mask_path IS NULL THEN 'fallback-pending' ELSE 'per-image-mask' END AS mask_source FROM ({_listed()}) LEFT JOIN ({m}) ON base = stem"


def _outputs(rig: bool = False) -> str:
    f = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{d['suffix']}')" for k, d in geo.FACES.items()) + ") f(face, suffix)"
    folder = "ltrim(suffix, '_')" if rig else "stem"
    return f"SELECT stem, face, 'image' AS kind, '{fx.ROOT}/images/' || {folder} || '/' || stem || suffix || '.png' AS path FROM ({_items()}), ({f}) UNION ALL SELECT stem, face, 'mask', '{fx.ROOT}/masks/' || mask_base || suffix || mask_suffix || '.png' FROM ({_items()}), ({f})"


_PIXELS = "SELECT vec_id AS image_id, label, ((i - 1) // 8)::INTEGER AS v, ((i - 1) % 8)::INTEGER AS u, embedding[i]::DOUBLE AS e FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
_IMAGES = f"SELECT image_id, label, v, u, trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, e * 220 + 128)))::INTEGER AS val FROM ({_PIXELS})"
_MASKS = f"SELECT image_id, v, u, CASE WHEN e > 0 THEN 255 ELSE 0 END AS val FROM ({_PIXELS}) WHERE label <> 0"
_COUNT = f"SELECT v, u, count(*) FILTER (val > 127) AS n FROM ({_MASKS}) GROUP BY v, u"
_LOG = """SELECT event_id % 10 AS run, event_id AS line_no, CASE event_id % 11
  WHEN 0 THEN 'INFO: useful_pixel_mask source: ' || event_type
  WHEN 1 THEN 'INFO: Mask-derived maximum angle: ' || (60 + event_id % 40) || '.5 deg'
  WHEN 2 THEN 'INFO: Manual maximum angle: ' || (60 + event_id % 40) || ' deg'
  WHEN 3 THEN '[PROGRESS] DONE 1/1: processed=' || (event_id % 97) || ' skipped=' || (event_id % 13)
  WHEN 4 THEN 'INFO: Resolved ' || (event_id % 29) || ' missing per-image mask(s)'
  WHEN 5 THEN 'noise [PROGRESS] ' || event_type
  WHEN 7 THEN 'INFO: prismara:  f: ' || (event_id % 1000) || ' px '
  ELSE CASE WHEN event_id % 55 = 6 THEN 'INFO: prismara: cameras of all faces, to be set and FIXED for alignment' ELSE '[PROGRESS] ' || (['MASK_SUM', 'RAYS', 'REMAP_PRECOMPUTE', 'REMAP_APPLY'])[event_id % 4 + 1] || ' ' || (event_id % 50) || '/50:  ' || event_type || ' ' END END AS line FROM events"""

_SMALL = fx.LENS.scaled(SMALL)
_SMALL_SQL = _one(_SMALL)
_ID = rays.LENS_KEY


# Geometry, over a table of lenses.


@query(f"SELECT lens_id, v, u FROM ({_grid(_LENSES)})")
def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.lens_pixels(fx.lenses(spark, sf_dir), _ID).select("lens_id", "v", "u")


@query(f"SELECT lens_id, v, u, {_r('xp', 'xp')}, {_r('yp', 'yp')} FROM ({_norm(_LENSES)})")
def normalized_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.lens_normalized(fx.lenses(spark, sf_dir)), "xp", "yp")


@query(f"SELECT lens_id, v, u, {_r('x', 'x')}, {_r('y', 'y')} FROM ({_undistorted(_LENSES)})")
def undistort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.lens_undistorted(fx.lenses(spark, sf_dir)), "x", "y")


_XYZ = ", ".join(_r(k, k) for k in "xyz")


def _rays_by(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return rounded(rays.lens_rays(fx.lenses(spark, sf_dir).withColumn("model", F.lit(model))), *"xyz")


@query(f"SELECT lens_id, v, u, {_XYZ} FROM ({_rays(_with_model("'equisolid'"))})")
def rays_equisolid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays_by(spark, sf_dir, "equisolid")


@query(f"SELECT lens_id, v, u, {_XYZ} FROM ({_rays(_with_model("'equidistant'"))})")
def rays_equidistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays_by(spark, sf_dir, "equidistant")


@query(f"SELECT lens_id, v, u, {_XYZ} FROM ({_rays(_with_model("'pinhole'"))})")
def rays_pinhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays_by(spark, sf_dir, "pinhole")


@query(f"SELECT lens_id, v, u, {_XYZ} FROM ({_rays(_with_model("'equirectangular'"))})")
def rays_equirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays_by(spark, sf_dir, "equirectangular")


@query(f"SELECT lens_id, v, u, {_XYZ} FROM ({_rays(_ANY_MODEL)})")
def rays_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lens by the model its row names, all four among them."""
    return rounded(rays.lens_rays(fx.any_lenses(spark, sf_dir)), *"xyz")


@query(f"SELECT lens_id, v, u, {', '.join(_r(f'q{k}', f'q{k}') for k in 'wxyz')} FROM ({_quat(_rays(_LENSES))})")
def quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [f"q{k}" for k in "wxyz"]
    return rounded(rays.with_quaternion(rays.lens_rays(fx.lenses(spark, sf_dir))).select("lens_id", "v", "u", *q), *q)


@query(f"SELECT lens_id, v, u, {_r('x / n', 'x')}, {_r('y / n', 'y')}, {_r('z / n', 'z')} FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (SELECT lens_id, v, u, 2 * (qx * qz + qw * qy) AS x, 2 * (qy * qz - qw * qx) AS y, 1 - 2 * (qx * qx + qy * qy) AS z FROM ({_quat(_rays(_LENSES))})))")
def quat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = rays.with_quaternion(rays.lens_rays(fx.lenses(spark, sf_dir))).select("lens_id", "v", "u", geo.turned(*(F.col(f"q{k}") for k in "wxyz")).alias("r"))
    return rounded(q.select("lens_id", "v", "u", geo.unit(F.col("r.x"), F.col("r.y"), F.col("r.z")).alias("r")).select("lens_id", "v", "u", "r.*"), *"xyz")


def _lens_angles(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = _ID, together: bool = False) -> DataFrame:
    return rays.with_angles(rays.with_quaternion(rays.lens_rays(fx.lenses(spark, sf_dir), keys, together)))


@query(f"SELECT lens_id, v, u, {_r('theta', 'theta')}, {_r('phi', 'phi')} FROM ({_angles(_LENSES)})")
def polar_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lens_angles(spark, sf_dir).select("lens_id", "v", "u", "theta", "phi"), "theta", "phi")


@query(f"SELECT lens_id, v, u, trunc(greatest(0, least(255, round(theta, 6))))::INTEGER AS theta_byte, trunc(greatest(0, least(255, round((phi + 255) / 2, 6))))::INTEGER AS phi_byte FROM ({_angles(_LENSES)})")
def angle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens_angles(spark, sf_dir).select("lens_id", "v", "u", geo.byte(F.round("theta", 6)).alias("theta_byte"), geo.byte(F.round((F.col("phi") + 255) / 2, 6)).alias("phi_byte"))


def _slopes(axis: str, line: str, prefix: str, source: str) -> str:
    w = f"OVER (PARTITION BY lens_id, {line} ORDER BY {axis})"
    return f"SELECT *, {', '.join(f'(coalesce(lead({k}) {w}, {k}) - coalesce(lag({k}) {w}, {k})) / CASE WHEN lag({k}) {w} IS NULL OR lead({k}) {w} IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS {prefix}_{k}' for k in 'xyz')} FROM ({source})"


def _omega(lens: str) -> str:
    return f"SELECT *, sqrt(power(a_y * b_z - a_z * b_y, 2) + power(a_z * b_x - a_x * b_z, 2) + power(a_x * b_y - a_y * b_x, 2)) AS omega FROM ({_slopes('v', 'u', 'b', _slopes('u', 'v', 'a', _rays(lens)))})"


_EQUIRECT_OMEGA = "2 * pi() / width * pi() / height * cos(pi() * (v / height::DOUBLE - 0.5::DOUBLE))"


@query(f"SELECT lens_id, v, u, {_r('omega', 'omega')} FROM ({_omega(_LENSES)})")
def solid_angle_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.solid_angle(rays.lens_rays(fx.lenses(spark, sf_dir)), _ID), "omega")


@query(f"SELECT lens_id, v, u, {_r(_EQUIRECT_OMEGA, 'omega')} FROM ({_grid(_LENSES)})")
def solid_angle_equirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rays.lens_equirectangular_solid_angle(fx.lenses(spark, sf_dir)), "omega")


@query(f"SELECT lens_id, v, u, {', '.join(_r(f'q{k}', f'q{k}') for k in 'wxyz')}, {_r(f"CASE WHEN model = 'equirectangular' THEN {_EQUIRECT_OMEGA} ELSE omega END", 'omega')} FROM ({_quat(_omega(_ANY_MODEL))})")
def geometry_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a geometry file holds, of all lenses, each by the model its row names."""
    return rounded(rays.lens_geometry(fx.any_lenses(spark, sf_dir)), "qw", "qx", "qy", "qz", "omega")


@query(f"SELECT event_id, {_r('exp(-power(2 * value / 100, 2))', 'k')} FROM events")
def gaussian_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.table(spark, sf_dir, "events").select("event_id", geo.gaussian(F.col("value") / 100).alias("k")), "k")


@query("SELECT event_id, trunc(greatest(0, least(255, round(value * 3 - 20, 6))))::INTEGER AS byte FROM events")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", geo.byte(F.round(F.col("value") * 3 - 20, 6)).alias("byte"))


# Names, matching, resumption.


@query(f"SELECT stem, regexp_replace(stem, '_mask$', '') AS base, CASE WHEN stem LIKE '%\\_mask' ESCAPE '\\' THEN '_mask' ELSE '' END AS suffix FROM (SELECT 'doc_' || doc_id || CASE WHEN quality = 1 THEN '_mask' ELSE '' END AS stem FROM labels)")
def mask_stem_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.listed_masks(spark, sf_dir).select("stem", paths.mask_base(F.col("stem")).alias("base"), paths.mask_suffix(F.col("stem")).alias("suffix"))


@query(f"SELECT path, stem FROM ({_listed()}) WHERE path NOT LIKE '%.txt'")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.sources.images import only_images

    return only_images(fx.listed_images(spark, sf_dir))


@query(_items())
def image_mask_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.items(spark, sf_dir)


@query(f"SELECT image_path, stem, coalesce(mask_path, '/out/fallback.png') AS mask_path, mask_base, mask_suffix, CASE WHEN mask_path IS NULL THEN 'fallback-useful-pixel-mask' ELSE mask_source END AS mask_source FROM ({_items()})")
def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.with_fallback(fx.items(spark, sf_dir), "/out/fallback.png")


@query(f"SELECT count(*) FILTER (mask_path IS NOT NULL) AS matched, count(*) FILTER (mask_path IS NULL) AS missing FROM ({_items()})")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.counts(fx.items(spark, sf_dir))


@query("SELECT base, count(*) AS n FROM (SELECT 'lens_' || (doc_id % 7) AS base FROM labels) GROUP BY base HAVING count(*) > 1")
def duplicate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("lens_"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("quality") == 1, "_mask").otherwise(""))
    return masks.duplicate_masks(fx.table(spark, sf_dir, "labels").select(stem.alias("stem")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'mask-directory' WHEN doc_id % 3 = 1 THEN 'lens-only-mask' ELSE 'manual-fov' END AS origin, CASE WHEN doc_id % 3 = 2 THEN (100 + doc_id % 100) / 2.0::DOUBLE END AS maxangle FROM documents")
def support_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    origin, angle = masks.support_source(i == 0, i <= 1, 100 + F.col("doc_id") % 100)
    return fx.table(spark, sf_dir, "documents").select("doc_id", origin.alias("origin"), angle.alias("maxangle"))


@query(_outputs())
def expected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.expected_outputs(fx.items(spark, sf_dir), fx.ROOT, ".png")


@query(_outputs(rig=True))
def expected_outputs_rig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.expected_outputs(fx.items(spark, sf_dir), fx.ROOT, ".png", rig=True)


@query(f"SELECT * FROM ({_items()}) WHERE substr(stem, 5)::BIGINT % 3 <> 0")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.items(spark, sf_dir)
    return masks.pending(items, masks.expected_outputs(items, fx.ROOT, ".png"), fx.existing_outputs(spark, sf_dir))


@query(f"SELECT doc_id, md5('width=' || {MIDDLE} || '|model=equisolid|maxangle=' || printf('%.12f', 60 + doc_id % 40 + 0.5::DOUBLE) || '|face=+Z|version={paths.RECIPE_VERSION}') AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"width": F.lit(MIDDLE), "model": F.lit("equisolid"), "maxangle": (60 + F.col("doc_id") % 40 + F.lit(0.5)), "face": F.lit("+Z")}
    return fx.table(spark, sf_dir, "documents").select("doc_id", paths.cache_key(parts).alias("key"))


@query(f"SELECT path, regexp_extract(path, '(_dir_(plus|minus)[XYZ])', 1) AS suffix, face FROM ({_outputs()})")
def face_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face of every output file, told from its name alone."""
    out = masks.expected_outputs(fx.items(spark, sf_dir), fx.ROOT, ".png").select("path", F.regexp_extract("path", "_dir_(plus|minus)[XYZ]", 0).alias("suffix"))
    return out.withColumn("face", paths.face_of_suffix(F.col("suffix")))


@query("SELECT doc_id, (['.png', '.tif', '.jpg'])[doc_id % 3 + 1] AS ext FROM documents")
def output_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.element_at(F.array(*map(F.lit, ("png", "tiff", "jpg"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", paths.extension(choice).alias("ext"))


@query("SELECT event_id, regexp_full_match(trim(event_type || (event_id % 5)), '\\+?\\d+') AS word, event_id % 5 > 0 AS number FROM events")
def positive_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("event_id") % 5).cast("string")
    return fx.table(spark, sf_dir, "events").select("event_id", paths.is_positive_integer(F.concat("event_type", i)).alias("word"), paths.is_positive_integer(F.concat(F.lit(" +"), i, F.lit(" "))).alias("number"))


@query("SELECT 'doc_' || doc_id AS path, 8 + (doc_id % 3)::INTEGER AS width, 8 AS height FROM documents WHERE doc_id % 3 <> 0")
def shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.sources.images import wrong_shapes

    d = fx.table(spark, sf_dir, "documents")
    return wrong_shapes(d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 3 + 8).cast("int").alias("width"), F.lit(8).alias("height")), 8, 8)


# Masks.


@query(_COUNT)
def mask_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_count(fx.image_masks(spark, sf_dir))


@query(f"SELECT v, u, (n * 1000) % 65536 AS stored FROM ({_COUNT})")
def mask_count_16bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_count(spark, sf_dir).select("v", "u", masks.stored_count(F.col("n") * 1000).alias("stored"))


@query(f"SELECT {_r('max(theta)', 'maxangle')} FROM ({_angles(_SMALL_SQL)}) JOIN ({_COUNT}) USING (v, u) WHERE n > 0")
def derived_maxangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = rays.with_angles(rays.with_quaternion(rays.rays(spark, _SMALL)))
    return rounded(masks.derived_angle(mask_count(spark, sf_dir), angles), "maxangle")


@query(f"SELECT v, u, bool_or(val > 5) AS bright FROM ({_IMAGES}) GROUP BY v, u")
def bright_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.bright_anywhere(fx.images(spark, sf_dir))


@query(f"WITH l AS (SELECT path, stem, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM ({_listed()}) WHERE path NOT LIKE '%.txt') SELECT path, stem FROM l WHERE i IN (SELECT k * (n - 1) // greatest(1, least(8, n) - 1) FROM range(8) t(k) WHERE k < n)")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.even_sample(ext_filter(spark, sf_dir), "path")


@query(f"WITH c AS ({_COUNT}), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM c), p AS (SELECT max(n) FILTER (i = floor(k * 0.99)) AS p, max(n) AS m FROM s) SELECT v, u, n, p99, least(255, trunc(n * 255 / p99::DOUBLE))::INTEGER AS gray FROM c, (SELECT CASE WHEN p > 0 THEN p ELSE greatest(m, 1) END AS p99 FROM p)")
def coverage_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mask_count(spark, sf_dir)
    return c.crossJoin(F.broadcast(coverage.high_count(c))).select("v", "u", "n", "p99", coverage.scaled(F.col("n"), F.col("p99")).alias("gray"))


@query(f"WITH i AS MATERIALIZED ({_IMAGES}), k AS (SELECT * FROM (VALUES " + ", ".join(f"({x}, {r}, {g}, {b}, {n})" for (x, (r, g, b)), n in zip(coverage.PALETTE, range(99), strict=False)) + ") k(x, r, g, b, i)) SELECT image_id, v, u, " + ", ".join(f"trunc(lo.{c} + (s.val - lo.x)::DOUBLE / (hi.x - lo.x) * (hi.{c} - lo.{c}))::INTEGER AS {c}" for c in "rgb") + " FROM i s JOIN k lo ON (lo.x < s.val OR lo.i = 0) JOIN k hi ON hi.i = lo.i + 1 AND s.val <= hi.x AND (s.val > lo.x OR s.val = 0)")
def coverage_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of all images in the colours of the coverage view."""
    return fx.images(spark, sf_dir).select("image_id", "v", "u", coverage.colour(F.col("val")).alias("c")).select("image_id", "v", "u", "c.*")


_SQUARE = "SELECT a.image_id, a.v, a.u, {f}(b.val) AS val FROM m a JOIN m b ON a.image_id = b.image_id AND b.v BETWEEN a.v - 1 AND a.v + 1 AND b.u BETWEEN a.u - 1 AND a.u + 1 GROUP BY ALL"


@query(f"WITH m AS ({_MASKS}) {_SQUARE.format(f='max')}")
def dilate3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.dilated(fx.image_masks(spark, sf_dir), 1, ["image_id"])


@query(f"WITH m AS ({_MASKS}) {_SQUARE.format(f='min')}")
def erode3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.eroded(fx.image_masks(spark, sf_dir), 1, ["image_id"])


def _flood(fore: str, seeds: str, grow: int) -> str:
    """255 in the foreground of each lens that seeds reach, grown by some pixels."""
    return f"""WITH RECURSIVE fore AS MATERIALIZED ({fore}),
reach(lens_id, v, u) AS (SELECT lens_id, v, u FROM fore WHERE lit AND {seeds} UNION SELECT f.lens_id, f.v, f.u FROM reach r JOIN fore f ON f.lens_id = r.lens_id AND f.lit AND f.v BETWEEN r.v - 1 AND r.v + 1 AND f.u BETWEEN r.u - 1 AND r.u + 1),
grown AS (SELECT DISTINCT lens_id, v + y.i AS v, u + x.i AS u FROM reach, range(-{grow}, {grow + 1}) y(i), range(-{grow}, {grow + 1}) x(i))
SELECT fore.lens_id, fore.v, fore.u, CASE WHEN grown.v IS NULL THEN 0 ELSE 255 END AS val FROM fore LEFT JOIN grown ON grown.lens_id = fore.lens_id AND grown.v = fore.v AND grown.u = fore.u"""


_SIZED = ("lens_id", "width", "height")


@query(_flood(f"SELECT lens_id, width, height, v, u, round(theta, 6) <= {NARROW} AS lit FROM ({_angles(_LENSES)})", "v = height // 2 AND u = width // 2", 1))
def center_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each lens sees within an angle; strips of eight rows, so that components of a lens go over several tasks."""
    angles = _lens_angles(spark, sf_dir, _SIZED).select(*_SIZED, "v", "u", F.round("theta", 6).alias("theta"))
    return morphology.center_component(angles, NARROW, F.col("width"), F.col("height"), keys=_SIZED, strip=8).drop("width", "height")


_DOTS = f"SELECT lens_id, width, height, v, u, ((u * 7 + v * 13 + u * v + lens_id) % 5 < 2) AS lit FROM ({_grid(_LENSES)})"
_WINDOW = 7


@query(_flood(_DOTS, f"v BETWEEN height // 2 - {_WINDOW // 2} AND height // 2 + {_WINDOW // 2} AND u BETWEEN width // 2 - {_WINDOW // 2} AND width // 2 + {_WINDOW // 2}", 0))
def seed_window_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = (F.col("u") * 7 + F.col("v") * 13 + F.col("u") * F.col("v") + F.col("lens_id")) % 5 < 2
    image = grid.lens_pixels(fx.lenses(spark, sf_dir), _ID).select("lens_id", F.col("lens_width").alias("width"), F.col("lens_height").alias("height"), "v", "u", F.when(lit, 255).otherwise(0).alias("val"))
    return morphology.seeded_components(image, F.col("width"), F.col("height"), _WINDOW, _SIZED, strip=8).drop("width", "height")


# Faces and recipes.


def _some_ties(spark: SparkSession, c: geo.Calibration, width: int) -> DataFrame:
    """Of one lens."""
    inside = rays.with_angles(rays.with_quaternion(rays.rays(spark, c))).where(F.col("theta") <= ANGLE)
    return faces.ties(faces.projected(inside), width)


_WIDE = ("lens_id", "width")


def _lens_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.projected(_lens_angles(spark, sf_dir, _WIDE, together=True).where(F.col("theta") <= ANGLE), keys=_WIDE)


def _lens_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.ties(_lens_projected(spark, sf_dir), FACE, keys=_WIDE)


def _lens_recipes(spark: SparkSession, sf_dir: str, everywhere: bool = False, solve: bool = True) -> DataFrame:
    return faces.recipe(_lens_ties(spark, sf_dir), FACE, F.col("width"), everywhere=everywhere, keys=_WIDE, solve=solve)


@query(f"SELECT lens_id, v, u, face, {_r('atan(a)', 'a')}, {_r('atan(b)', 'b')} FROM {_projected(_LENSES)}")
def face_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles from the middle of the face: distances grow without bound where a ray runs along it."""
    return rounded(_lens_projected(spark, sf_dir).drop("width").withColumns({"a": F.atan("a"), "b": F.atan("b")}), "a", "b")


@query(f"SELECT lens_id, face, u, v, {_r('px', 'px')}, {_r('py', 'py')} FROM ({_ties(_LENSES, FACE)})")
def face_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lens_ties(spark, sf_dir).drop("width"), "px", "py")


@query(f"SELECT lens_id, face, coalesce(n, 0) AS n FROM (SELECT lens_id, unnest({list(geo.FACES)!r}) AS face FROM ({_LENSES})) LEFT JOIN (SELECT lens_id, face, count(*) AS n FROM ({_ties(_LENSES, FACE)}) GROUP BY ALL) USING (lens_id, face)")
def ties_per_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.tie_counts(_lens_ties(spark, sf_dir), _ID, fx.lenses(spark, sf_dir))


@query(f"{_near(_LENSES, FACE)} SELECT lens_id, face, row, col, k::INTEGER AS k, src, {_r('d2', 'd2')} FROM near")
def knn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lens_recipes(spark, sf_dir, everywhere=True)
    return rounded(r.select("lens_id", "face", "row", "col", F.posexplode(F.arrays_zip("src", "d2")).alias("k", "n")).select("lens_id", "face", "row", "col", (F.col("k") + 1).alias("k"), "n.src", "n.d2"), "d2")


@query(f"{_near(_LENSES, FACE)}, {_solved()} SELECT lens_id, face, row, col, src, {_r('w', 'w')} FROM w")
def rbf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true weights of the recipes of all lenses."""
    r = _lens_recipes(spark, sf_dir)
    return rounded(r.select("lens_id", "face", "row", "col", F.explode(F.arrays_zip("src", "w")).alias("n")).select("lens_id", "face", "row", "col", "n.src", "n.w"), "w")


@query(SQL["rbf_weights"])
def rbf_weights_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same weights, solved without Python: nine pivots in higher-order functions."""
    r = faces.recipe_by_columns(_lens_recipes(spark, sf_dir, solve=False), None, None, _WIDE)
    return rounded(r.select("lens_id", "face", "row", "col", F.explode(F.arrays_zip("src", "w")).alias("n")).select("lens_id", "face", "row", "col", "n.src", "n.w"), "w")


@query("SELECT vec_id, i::INTEGER AS i, round(CASE WHEN s = 0 THEN 0 ELSE embedding[i]::DOUBLE / s END, 6) + 0.0 AS w FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def weights_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = remap.normalized_weights(F.col("embedding").cast("array<double>"))
    return rounded(fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(w).alias("i", "w")).withColumn("i", F.col("i") + 1), "w")


def _inverse(spark: SparkSession) -> DataFrame:
    """A recipe with inverse distances instead of solved weights, which SQL can follow."""
    r = faces.recipe(_some_ties(spark, _SMALL, FACE_SMALL), FACE_SMALL, SMALL, everywhere=True)
    return r.withColumn("w", remap.normalized_weights(F.transform("d2", lambda x: F.lit(1.0) / (x + 0.01))))


_APPLIED = _near(_SMALL_SQL, FACE_SMALL) + """, w AS (SELECT face, row, col, src, 1 / (d2 + 0.01::DOUBLE) / sum(1 / (d2 + 0.01::DOUBLE)) OVER (PARTITION BY face, row, col) AS w FROM near),
p AS ({pixels}), sums AS (SELECT image_id, face, row, col, round(sum(w * val), 6) AS val FROM p JOIN w ON w.src = p.v * 8 + p.u GROUP BY ALL)"""


def _rounded_sums(pixels: DataFrame, recipe: DataFrame) -> DataFrame:
    return remap.remapped(pixels.select("image_id", (F.col("v") * SMALL + F.col("u")).cast("long").alias("src"), "val"), recipe, ("val",)).withColumn("val", F.round("val", 6))


@query(f"{_APPLIED.format(pixels=_IMAGES)} SELECT image_id, face, row, col, trunc(greatest(0, least(255, val)))::INTEGER AS val FROM sums")
def remap_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remap.colours(_rounded_sums(fx.images(spark, sf_dir), _inverse(spark)), ("val",))


@query(f"{_APPLIED.format(pixels=_MASKS)} SELECT image_id, face, row, col, CASE WHEN trunc(greatest(0, least(255, val))) > 127 THEN 255 ELSE 0 END AS val FROM sums")
def remap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remap.mask(_rounded_sums(fx.image_masks(spark, sf_dir), _inverse(spark)))


@query(f"""{_near(_one(fx.EVEN_LENS), FACE)}, {_solved()}, p AS ({_IMAGES}),
sums AS (SELECT label, image_id, face, row, col, round(sum(w * val), 6) AS val FROM p JOIN w ON w.src = p.v * {SMALL} + p.u GROUP BY ALL)
SELECT label, face, count(*) AS pixels, {_r("avg(trunc(greatest(0, least(255, val))))", "mean")} FROM sums GROUP BY label, face""")
def face_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path with true weights: ``label``, ``face``, ``pixels``, ``mean`` of all images."""
    r = faces.recipe(_some_ties(spark, fx.EVEN_LENS, FACE), FACE, SMALL)
    pixels = fx.images(spark, sf_dir).select("image_id", "label", (F.col("v") * SMALL + F.col("u")).cast("long").alias("src"), "val")
    sums = remap.remapped(pixels, r, ("val",), ("image_id", "label")).withColumn("val", F.round("val", 6))
    out = remap.colours(sums, ("val",))
    return rounded(out.groupBy("label", "face").agg(F.count(F.lit(1)).alias("pixels"), F.avg("val").alias("mean")), "mean")


# Logs.

_PARSED = rf"SELECT line_no, regexp_extract(line, '{runlog.logs.PROGRESS}', 1) AS phase, regexp_extract(line, '{runlog.logs.PROGRESS}', 2)::BIGINT AS current, regexp_extract(line, '{runlog.logs.PROGRESS}', 3)::BIGINT AS total, trim(regexp_extract(line, '{runlog.logs.PROGRESS}', 4)) AS message FROM ({_LOG}) WHERE regexp_matches(line, '{runlog.logs.PROGRESS}')"


@query(f"SELECT *, {_r('current / greatest(total, 1)::DOUBLE', 'fraction')} FROM ({_PARSED})")
def progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlog.parsed(fx.log_lines(spark, sf_dir).drop("run")), "fraction")


def _last(n: tuple[int, ...], value: str) -> str:
    return f"arg_max({value}, line_no) FILTER (line_no % 11 IN ({', '.join(map(str, n))}))"


@query(f"""WITH l AS MATERIALIZED ({_LOG}),
said AS (SELECT run, line_no, line, line_no % 11 IN (0, 1, 2, 3, 4) AS given, line LIKE '%set and FIXED for alignment%' AS announced FROM l),
begun AS (SELECT *, coalesce(bool_or(announced) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS on_ FROM said),
cameras AS (SELECT run, string_agg(trim(CASE WHEN line LIKE '%: %: %' THEN regexp_extract(line, '^.*?: .*?: (.*)$', 1) ELSE line END), chr(10) ORDER BY line_no) AS pinhole FROM begun WHERE on_ AND NOT given GROUP BY run),
fields AS (SELECT run, {_last((0,), "trim(regexp_extract(line, 'source:\\s+(.+)', 1))")} AS support_source, {_last((1, 2), "nullif(regexp_extract(line, 'angle:\\s+([0-9.]+)', 1), '')::DOUBLE")} AS effective_angle,
  {_last((1, 2), "CASE WHEN line LIKE '%Mask%' THEN 'mask-derived' ELSE 'manual' END")} AS angle_source, coalesce({_last((3,), "nullif(regexp_extract(line, 'processed=(\\d+)', 1), '')::BIGINT")}, 0) AS processed,
  coalesce({_last((3,), "nullif(regexp_extract(line, 'skipped=(\\d+)', 1), '')::BIGINT")}, 0) AS skipped, coalesce({_last((4,), "nullif(regexp_extract(line, 'Resolved (\\d+)', 1), '')::BIGINT")}, 0) AS fallback_masks FROM l GROUP BY run)
SELECT fields.*, pinhole FROM fields LEFT JOIN cameras USING (run)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run says of itself, its cameras among it."""
    return runlog.summary(fx.log_lines(spark, sf_dir), ("run",))
