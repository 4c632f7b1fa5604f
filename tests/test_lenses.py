"""Tables of lenses, components over strips, ranks without a global window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.functions import geometry as geo
from prismara.operators import faces, masks, morphology, ranks, rays
from prismara.plans import catalog, fixtures
from prismara.sources import grid


def lens_rows(spark, *rows):
    names = ["lens_id", "model", *geo.PARAMETERS, "extra"]
    types = ["lens_id string", "model string", "width int", "height int", *(f"{k} double" for k in geo.PARAMETERS[2:]), "extra int"]
    assert len(names) == len(types)
    return spark.createDataFrame([(*r, 1) for r in rows], ", ".join(types))


def row(name, model, c):
    return (name, model, *(getattr(c, k) for k in geo.PARAMETERS))


def test_a_table_of_lenses_gives_what_each_lens_gives(spark):
    one, two = fixtures.LENS.scaled(20), geo.Calibration("equidistant_fisheye", 9, 130, 40.0, 0.3, -0.2, 0.01, b1=0.5, b2=0.1)
    table = lens_rows(spark, row("a", "equisolid", one), row("b", "equidistant", two), row("c", "pinhole", two), row("d", "equirectangular", two), row("none", "pinhole", geo.Calibration("x", 0, 5, 1.0)))
    got = {k: g.sort_values(["v", "u"]).reset_index(drop=True) for k, g in rays.lens_geometry(table).toPandas().groupby("lens_id")}
    assert set(got) == set("abcd")
    for name, c, model in (("a", one, None), ("b", two, None), ("c", two, "pinhole"), ("d", two, "equirectangular")):
        want = rays.geometry(spark, c, model).toPandas().sort_values(["v", "u"]).reset_index(drop=True)
        assert len(want) == c.width * c.height
        np.testing.assert_allclose(got[name][list(want.columns)], want, rtol=1e-12, atol=1e-15)
    with pytest.raises(Exception, match="unknown model fisheye"):
        rays.lens_rays(lens_rows(spark, row("x", "fisheye", one))).collect()
    assert rays.lens_rays(table.limit(0)).count() == 0


def test_grids_of_lenses_are_dealt_by_bands(spark):
    table = lens_rows(spark, row("a", "pinhole", geo.Calibration("x", 3, 300, 1.0)))
    px = grid.lens_pixels(table, ["lens_id"], band=16)
    assert px.select("v", "u").distinct().count() == px.count() == 900
    assert px.select(F.spark_partition_id()).distinct().count() > 1


def test_recipes_of_many_lenses_equal_those_of_each(spark):
    some = [fixtures.LENS.scaled(24), fixtures.LENS.scaled(32)]
    table = lens_rows(spark, *(row(str(c.width), "equisolid", c) for c in some))
    keys = ("lens_id", "width")
    inside = rays.with_angles(rays.with_quaternion(rays.lens_rays(table, keys))).where("theta <= 100")
    got = faces.recipe(faces.ties(faces.projected(inside, keys=keys), 8, keys=keys), 8, F.col("width"), keys=keys)
    for c in some:
        want = {(r.face, r.row, r.col): (r.src, r.w) for r in faces.recipe(catalog._some_ties(spark, c, 8), 8, c.width).collect()}
        have = {(r.face, r.row, r.col): (r.src, r.w) for r in got.where(F.col("width") == c.width).collect()}
        assert set(want) == set(have)
        for k, (src, w) in want.items():
            assert have[k][0] == src
            np.testing.assert_allclose(have[k][1], w, atol=1e-9)


def flooded(x):
    label, n = np.zeros(x.shape, int), 0
    for v, u in zip(*np.nonzero(x), strict=True):
        if label[v, u]:
            continue
        n += 1
        todo = [(v, u)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < x.shape[0] and 0 <= b < x.shape[1] and x[a, b] and not label[a, b]:
                label[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


@pytest.mark.parametrize("strip", [1, 2, 3, 7, 1000])
def test_components_do_not_depend_on_strips(spark, strip):
    r = np.random.default_rng(4)
    spiral = np.zeros((21, 21), int)
    spiral[::2] = 1
    spiral[1::4, -1] = spiral[3::4, 0] = 1
    pictures = {0: (r.random((30, 25)) < 0.4).astype(int), 1: (r.random((30, 25)) < 0.6).astype(int), 2: spiral, 3: np.zeros((4, 4), int), 4: np.ones((9, 9), int)}
    rows = [(k, int(v), int(u), int(x[v, u]) * 255) for k, x in pictures.items() for v, u in np.ndindex(x.shape)]
    image = spark.createDataFrame(rows, "image_id int, v int, u int, val int")
    got = morphology.labelled(image, ["image_id"], strip).collect()
    for k, x in pictures.items():
        mine = np.zeros(x.shape, np.int64)
        for q in got:
            if q.image_id == k:
                mine[q.v, q.first : q.last + 1] = q.component + 1
        want = flooded(x)
        assert (mine > 0).tolist() == (x > 0).tolist()
        pairs = set(zip(mine[x > 0].tolist(), want[x > 0].tolist(), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == want.max()
        for a, n in pairs:  # a component is named by its first run
            v, u = np.argwhere(want == n)[0]
            assert a - 1 == (int(v) << 32 | int(u))
    alone = morphology.labelled(image.where("image_id = 1").drop("image_id"), strip=strip)
    assert alone.columns == ["v", "first", "last", "component"]
    assert morphology.labelled(image.limit(0), ["image_id"], strip).count() == 0


def test_ranks_without_a_global_window(spark):
    r = random.Random(1)
    names = [f"n{r.randrange(300):04}" for _ in range(1000)] + [None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(7)
    got = ranks.ranked(df, "name", "i").orderBy("rank").collect()
    assert [x.rank for x in got] == list(range(1001)) and {x.total for x in got} == {1001}
    assert [(x.name, x.i) for x in got] == sorted(((n, i) for i, n in enumerate(names)), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert ranks.ranked(df.limit(0), "name").count() == 0
    plan = masks.even_sample(df, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 100])
def test_even_samples(spark, n):
    df = spark.createDataFrame([(f"{i:03}",) for i in range(n)], "p string")
    for samples in (0, 1, 2, 8):
        m = min(samples, n)
        want = sorted({i * (n - 1) // max(1, m - 1) for i in range(m)})
        assert sorted(int(r.p) for r in masks.even_sample(df, "p", samples).collect()) == want
