"""Every registered query of the geometry engine against its SQL, and what SQL cannot follow against NumPy."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismara.functions import geometry as geo
from prismara.functions import paths
from prismara.operators import coverage, faces, morphology, rays, remap, runlog
from prismara.plans import catalog, fixtures
from prismara.sources import images

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels events".split()


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if value is None or pd.isna(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)) else str(value)


def compare(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(str(tuple(map(plain, r))) for r in df[columns].astype(object).itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tables, name):
    compare(catalog.QUERIES[name](spark, SF).toPandas(), tables.sql(catalog.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert {r.face for r in rows} == set(geo.FACES) and all(0 <= r.mean <= 255 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())


def some_ties(spark, size, width):
    return catalog._some_ties(spark, fixtures.LENS.scaled(size), width)


@pytest.mark.parametrize("margins", [faces.MARGINS, (1, 2, 5, 20)])
def test_weights_against_a_plain_solution(spark, margins):
    ties = some_ties(spark, 40, 16)
    t = ties.toPandas()
    got = {(r.face, r.row, r.col): (r.src, r.w) for r in faces.recipe(ties, 16, 40, margins=margins).collect()}
    for face in geo.FACES:
        p = t[t.face == face]
        src = (p.v.astype(int) * 40 + p.u).to_numpy()
        at = np.stack([p.py, p.px], 1)
        for row in range(16):
            for col in range(16):
                d2 = ((at - [row, col]) ** 2).sum(1)
                near = np.lexsort((src, np.round(d2, 9)))[:9]
                if d2[near[0]] > faces.REACH**2:
                    assert (face, row, col) not in got
                    continue
                apart = ((at[near][:, None] - at[near][None]) ** 2).sum(2)
                w = np.linalg.solve(np.exp(-4 * apart) + 1e-10 * np.eye(9), np.exp(-4 * d2[near]))
                have = got[face, row, col]
                assert list(have[0]) == list(src[near])
                np.testing.assert_allclose(have[1], w / w.sum() if w.sum() else w, atol=1e-6)


def test_constant_images_stay_constant(spark):
    r = faces.recipe(some_ties(spark, 40, 16), 16, 40)
    px = spark.range(1600).select(F.lit(1).alias("image_id"), F.col("id").alias("src"), F.lit(100).alias("val"))
    low, high = remap.colours(remap.remapped(px, r, ("val",)), ("val",)).agg(F.min("val"), F.max("val")).first()
    assert {low, high} <= {99, 100}


@pytest.mark.parametrize("threads", [1, 5])
def test_whole_images_equal_the_join(spark, tmp_path, threads):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, 40, 3), dtype=np.uint8)
    r = faces.recipe(some_ties(spark, 40, 16), 16, 40).persist()
    remap.write_packed(r, 16, str(tmp_path / "recipe"))
    files = remap.packed_files(spark.read.parquet(str(tmp_path / "recipe")))
    assert set(files) == set(geo.FACES)
    image = spark.createDataFrame([("a", 40, 40, 3, bytearray(x.tobytes()))], images.IMAGE)
    both = image.withColumn("is_mask", F.lit(False)).unionAll(image.withColumn("is_mask", F.lit(True)))
    got = {(i.face, i.is_mask): np.frombuffer(i.data, np.uint8).reshape(16, 16, -1) for i in remap.remapped_images(both, files, 16, threads).collect()}
    assert len(got) == 10
    for face in ("+Z", "-X"):
        px = images.exploded(image).select(F.col("path").alias("image_id"), (F.col("v") * 40 + F.col("u")).cast("long").alias("src"), "b", "g", "r")
        joined = remap.remapped(px, r.where(F.col("face") == face), ("b", "g", "r")).toPandas()
        want = np.zeros((16, 16, 3))
        want[joined.row, joined.col] = joined[["b", "g", "r"]]
        want = np.clip(want, 0, 255)
        assert np.abs(got[face, False] - want).max() <= 1
        near = np.abs(want[:, :, 0] - 128) > 1
        assert (got[face, True][near, 0] == np.where(want[near, 0] > 127, 255, 0)).all()


def test_too_few_points_are_an_error(spark):
    with pytest.raises(ValueError, match="fewer than 9"):
        faces.recipe(some_ties(spark, 40, 16).where("face = '+Z'").limit(5), 16, 40)


def test_solid_angles_add_up_to_the_sphere(spark):
    total = rays.equirectangular_solid_angle(spark, 128, 64).agg(F.sum("omega")).first()[0]
    assert total == pytest.approx(4 * math.pi, rel=1e-2)


def test_one_expression_equals_the_steps(spark):
    c = fixtures.LENS.scaled(30)
    one = rays.normalized(spark, c).select("v", "u", geo.undistorted(F.col("xp"), F.col("yp"), c.columns()).alias("d")).select("v", "u", "d.*")
    assert one.exceptAll(rays.undistorted(spark, c)).count() == 0


def test_gradient_equals_numpy(spark):
    r = rays.rays(spark, fixtures.LENS.scaled(20)).orderBy("v", "u").toPandas()
    x = r[["x", "y", "z"]].to_numpy().reshape(20, 20, 3)
    want = np.linalg.norm(np.cross(np.gradient(x, axis=1), np.gradient(x, axis=0)), axis=-1)
    got = rays.solid_angle(rays.rays(spark, fixtures.LENS.scaled(20))).orderBy("v", "u").toPandas().omega.to_numpy().reshape(20, 20)
    np.testing.assert_allclose(got, want, atol=1e-12)


def picture(spark, text):
    lines = text.split()
    return spark.createDataFrame([(v, u, 255 * (c == "#")) for v, line in enumerate(lines) for u, c in enumerate(line)], "v int, u int, val int")


def drawn(df):
    p = df.toPandas().pivot(index="v", columns="u", values="val").to_numpy()
    return [" ".join("#" if c else "." for c in line).replace(" ", "") for line in p]


@pytest.mark.parametrize(
    ("image", "want"),
    [
        (".....  .###. .###. .###. .....", "..... .###. .###. .###. ....."), ("#...# .#.#. ..#.. ..... ##...", "#...# .#.#. ..#.. ..... ....."), ("..... ..... ..#.. ..... .....", "..... ..... ..#.. ..... ....."),
        ("##### ##### ##.## ##### #####", "..... ..... ..... ..... ....."), ("..... ..... ..... ..... .....", "..... ..... ..... ..... ....."), ("##### ##### ##### ##### #####", "##### ##### ##### ##### #####"), ("#.#.# .#.#. #.#.# ..... #####", "#.#.# .#.#. #.#.# ..... ....."),
    ],
)
def test_center_component(spark, image, want):
    p = picture(spark, image)
    theta = p.select("v", "u", F.when(F.col("val") > 0, 50).otherwise(150).alias("theta"))
    assert drawn(morphology.center_component(theta, 100, 5, 5, dilation=0)) == want.split()


def test_seed_window_and_squares(spark):
    p = picture(spark, "#.... ..... ..... ..... ....#")
    assert drawn(morphology.seeded_components(p, 5, 5, 3)) == ["....."] * 5
    assert drawn(morphology.seeded_components(p, 5, 5, 5)) == drawn(p)
    assert drawn(morphology.dilated(p)) == ["##...", "##...", ".....", "...##", "...##"]
    assert drawn(morphology.eroded(picture(spark, "##### ##### ##.## ##### #####"))) == ["#####", "#...#", "#...#", "#...#", "#####"]


def test_names(spark):
    df = spark.createDataFrame([("/a/b.c.JPG",), ("x",), (".jpg",), ("d/e_mask.png",), ("_mask_mask.tif",)], "p string")
    got = [tuple(r) for r in df.select(paths.stem(F.col("p")), paths.suffix(F.col("p")), paths.is_image(F.col("p")), paths.mask_base(paths.stem(F.col("p")))).collect()]
    assert got == [("b.c", ".JPG", True, "b.c"), ("x", "", False, "x"), (".jpg", "", False, ".jpg"), ("e_mask", ".png", True, "e"), ("_mask_mask", ".tif", True, "_mask")]
    numbers = spark.createDataFrame([("5", True), (" +7 ", True), ("1_000", True), ("0", False), ("-3", False), ("", False), (None, False), ("1__0", False), ("x", False), ("1.5", False)], "t string, ok boolean")
    assert numbers.where(paths.is_positive_integer(F.col("t")) != F.col("ok")).count() == 0


def test_images_survive_writing(spark, tmp_path):
    rng = np.random.default_rng(2)
    colour, gray = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8), rng.integers(0, 256, (7, 5), dtype=np.uint8)
    for name, data in (("c.png", images.png(colour)), ("g.png", images.png(gray)), ("c.tif", images.tiff(colour)), ("g.tif", images.tiff(gray))):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.data, np.uint8).reshape(7, 5, -1) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert (got["c.png"] == colour).all() and (got["c.tif"] == colour).all() and (got["g.png"][..., 0] == gray).all() and (got["g.tif"][..., 0] == gray).all()


def test_stream_hands_each_image_once(spark, tmp_path):
    from prismara.streaming.resume import convert_arriving

    (tmp_path / "in").mkdir()
    seen = []
    run = lambda: convert_arriving(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect())).awaitTermination()
    (tmp_path / "in/a.png").write_bytes(images.png(np.zeros((4, 4), np.uint8)))
    run()
    (tmp_path / "in/b.png").write_bytes(images.png(np.zeros((4, 4), np.uint8)))
    run()
    assert seen == ["a.png", "b.png"]


def test_report_and_palette(spark):
    lines = spark.createDataFrame([(1, "x useful_pixel_mask source: mask-directory "), (2, "Mask-derived maximum angle: 98.25 deg"), (3, "[PROGRESS] DONE 4/4: processed=3 skipped=1"), (4, "Resolved 2 missing per-image mask(s)")], "line_no int, line string")
    text = runlog.report(runlog.summary(lines), "L", 2.0).first().report
    assert "Support source: mask-directory\nMask-derived maximum angle: 98.2500 deg" in text and "Processed: 3\nSkipped: 1\nFallback masks used: 2\nWall clock: 2.0s" in text
    c = spark.range(1).select(coverage.colour(F.lit(255)).alias("c")).first().c
    assert (c.r, c.g, c.b) == (253, 231, 36)
