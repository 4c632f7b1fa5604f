"""Verified recipes and small pictures of a conversion."""

import os

import numpy as np
import pytest

from prismara.operators import coverage, remap
from prismara.plans import preview
from prismara.plans.convert import Options, convert
from prismara.sources import decode
from test_convert import FACE, SIZE, calibration, lens  # noqa: F401


def test_sizes_keep_their_shape():
    assert [preview.fitted(*x) for x in ((100, 80, 120), (240, 240, 120), (300, 100, 120), (100, 300, 120), (3840, 2160, 280), (5000, 3, 120))] == [(100, 80), (120, 120), (120, 40), (40, 120), (280, 158), (120, 1)]


def test_areas_are_averaged():
    x = np.random.default_rng(1).integers(0, 256, (60, 90, 3)).astype(np.uint8)
    small = preview.thumbnail(x, 30)
    assert small.shape == (20, 30, 3)
    assert (small == np.rint(x.reshape(20, 3, 30, 3, 3).mean((1, 3)))).all()
    assert abs(preview.thumbnail(x[:, :, 0], 37).mean() - x[:, :, 0].mean()) < 1
    assert preview.thumbnail(x, 90) is x


def test_coverage_has_the_colours_of_the_columns(spark):
    from pyspark.sql import functions as F

    count = np.arange(100).reshape(10, 10).astype(np.uint16)
    got = preview.coloured(count)
    gray = np.minimum(255, count.astype(int) * 255 // 99)
    want = {r.g: (r.c.b, r.c.g, r.c.r) for r in spark.range(256).select(F.col("id").alias("g"), coverage.colour(F.col("id").cast("int")).alias("c")).collect()}
    assert all(tuple(map(int, got[v, u])) == want[int(gray[v, u])] for v, u in np.ndindex(10, 10))
    assert (preview.coloured(np.zeros((3, 3), np.uint16)) == want[0]).all()


@pytest.mark.parametrize("format_", ["png", "jpg"])
def test_views_of_a_conversion(spark, lens, format_):  # noqa: F811
    root, xml = lens
    o = Options(xml, "L", str(root / "images"), str(root / "out"), masks=str(root / "masks"), face_width=130, format=format_)
    before = preview.previews(spark, o).collect()
    assert [(r.view, r.data) for r in sorted(before, key=lambda r: preview.VIEWS.index(r.view))] == [(v, None) for v in preview.VIEWS]
    convert(spark, o)
    got = {}
    for r in preview.previews(spark, o).collect():
        got.setdefault(r.view, []).append(r)
    faces = sorted(got["Cube faces"], key=lambda r: r.place)
    assert [r.name for r in faces] == [f"a_dir_{s}.{format_}" for s in ("plusZ", "minusY", "plusY", "minusX", "plusX")] and faces[0].text == "dir_plusZ (+Z face)"
    for r in (*faces, *got["Useful pixel mask"], *got["Mask coverage"], *got["Fallback mask"]):
        x = decode.png(bytes(r.data))
        side = 120 if r.view == "Cube faces" else SIZE
        assert (r.width, r.height) == (side, side) == x.shape[1::-1]
    assert decode.png(bytes(got["Mask coverage"][0].data)).ndim == 3
    assert got["Run summary"][0].data is None and "Processed: 2" in got["Run summary"][0].text and "f: 65" in got["Run summary"][0].text


def test_a_damaged_recipe_is_a_miss(spark, lens, monkeypatch):  # noqa: F811
    root, xml = lens
    o = Options(xml, "L", str(root / "images"), str(root / "out"), masks=str(root / "masks"), face_width=FACE, force=True)
    made = []
    real = remap.write_packed
    monkeypatch.setattr(remap, "write_packed", lambda *a: (made.append(1), real(*a)))
    convert(spark, o)
    want = {p: p.read_bytes() for p in (root / "out/L").rglob("*dir_*.png")}
    convert(spark, o)
    assert len(made) == 1  # the second run reads what is there
    (kept,) = (root / "out/L/recipes").iterdir()
    parts = sorted(kept.glob("face=*/*.parquet"))
    cut, flip = (lambda p: p.write_bytes(p.read_bytes()[:-9])), (lambda p: p.write_bytes(p.read_bytes()[:200] + b"x" + p.read_bytes()[201:]))
    for damage in (flip, lambda p: p.unlink(), lambda p: (kept / "face=+X/other.parquet").write_bytes(p.read_bytes()), lambda p: [q.write_bytes(b"no") for q in (kept / remap.MANIFEST).glob("*.parquet")]):
        remap.write_manifest(spark, str(kept))
        assert remap.verified(spark, str(kept))
        before = parts[0].read_bytes()
        damage(parts[0])
        assert not remap.verified(spark, str(kept))
        parts[0].write_bytes(before)
        (kept / "face=+X/other.parquet").unlink(missing_ok=True)
    remap.write_manifest(spark, str(kept))
    for damage in (cut,):
        damage(parts[0])
        assert not remap.verified(spark, str(kept))
        spark.catalog.clearCache()
        convert(spark, o)
        assert remap.verified(spark, str(kept))
        parts = sorted(kept.glob("face=*/*.parquet"))
    assert len(made) == 2
    assert {p: p.read_bytes() for p in (root / "out/L").rglob("*dir_*.png")} == want
    assert not [f for d, _, fs in os.walk(root / "out") for f in fs if "_writing" in os.path.join(d, f)]
