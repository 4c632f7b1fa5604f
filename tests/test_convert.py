"""The whole conversion of a small lens, from files to files."""

import os

import numpy as np
import pytest

from prismara.functions import geometry as geo
from prismara.plans.convert import Options, convert, lens_label, main
from prismara.plans.fixtures import LENS
from prismara.sources import images, raw
from prismara.sources.calibration import read_calibrations, summary
from test_formats import turned_jpeg

SIZE, FACE = 48, 20


def calibration(path, **changes):
    c = LENS.scaled(SIZE)
    fields = {k: getattr(c, k) for k in ("projection", "width", "height", "f", "cx", "cy", "k1", "k2", "k3", "p1", "p2")} | {"date": "2026-01-01T00:00:00Z", "other": 1} | changes
    path.write_text("<document><calibration>" + "".join(f"<{k}>{v}</{k}>" for k, v in fields.items() if v is not None) + "</calibration></document>")
    return str(path)


@pytest.fixture
def lens(tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "masks").mkdir()
    rng = np.random.default_rng(3)
    for name in ("a", "b"):
        (tmp_path / f"images/{name}.png").write_bytes(images.png(rng.integers(0, 256, (SIZE, SIZE, 3), dtype=np.uint8)))
    v, u = np.indices((SIZE, SIZE))
    disc = ((v - SIZE // 2) ** 2 + (u - SIZE // 2) ** 2 < 22**2).astype(np.uint8) * 255
    (tmp_path / "masks/a_mask.png").write_bytes(images.png(disc))
    (tmp_path / "images/note.txt").write_text("no image")
    return tmp_path, calibration(tmp_path / "lens.xml")


def test_convert_and_resume(spark, lens):
    root, xml = lens
    o = Options(xml, "L", str(root / "images"), str(root / "out"), masks=str(root / "masks"), face_width=FACE)
    out = convert(spark, o)
    assert (out["processed"], out["skipped"], out["fallback_masks"], out["support_source"]) == (2, 0, 1, "mask-directory")
    names = {os.path.relpath(os.path.join(d, f), root / "out/L") for d, _, fs in os.walk(root / "out/L") for f in fs}
    for d in geo.FACES.values():
        s = d["suffix"]
        assert {f"images/a/a{s}.png", f"images/b/b{s}.png", f"masks/a{s}_mask.png", f"masks/b{s}_mask.png"} <= names
    assert not [n for n in names if "_writing" in n]
    assert {"run_report.txt", "bonusdata/geometry.raw", "bonusdata/polar.png", "bonusdata/azimuth.png", "bonusdata/useful_pixels.png", "bonusdata/fallback_mask.png", "bonusdata/validpixelcount_16bit.tif"} <= names
    face = images.read_images(spark, f"{root}/out/L/images/a/a_dir_plusZ.png").first()
    assert (face.height, face.width, face.channels) == (FACE, FACE, 3) and np.frombuffer(face.data, np.uint8).std() > 10
    mask = images.read_images(spark, f"{root}/out/L/masks/a_dir_plusZ_mask.png").first()
    assert set(np.frombuffer(mask.data, np.uint8)) <= {0, 255}
    g = raw.read_raw(spark, f"{root}/out/L/bonusdata/geometry.raw", SIZE, SIZE).agg({"omega": "min", "qw": "max", "*": "count"}).first()
    assert g["count(1)"] == SIZE * SIZE and g["min(omega)"] >= 0 and g["max(qw)"] <= 1
    os.remove(root / "out/L/masks/b_dir_plusX_mask.png")
    again = convert(spark, o)
    assert (again["processed"], again["skipped"]) == (1, 1)
    assert os.path.exists(root / "out/L/masks/b_dir_plusX_mask.png")
    assert convert(spark, o) == {"processed": 0, "skipped": 2}  # nothing is read or computed


def test_errors(spark, lens):
    root, xml = lens
    o = dict(label="L", images=str(root / "images"), output=str(root / "out"), face_width=FACE)
    with pytest.raises(ValueError, match="support needs"):
        convert(spark, Options(xml, **o))
    with pytest.raises(ValueError, match="unsupported projection"):
        convert(spark, Options(calibration(root / "p.xml", projection="frame"), max_fov=180, **o))
    with pytest.raises(Exception, match="calibration lacks k2"):
        convert(spark, Options(calibration(root / "k.xml", k2=None), max_fov=180, **o))
    with pytest.raises(ValueError, match="other size"):
        convert(spark, Options(calibration(root / "w.xml", width=99), max_fov=180, **o))
    (root / "masks/a.png").write_bytes((root / "masks/a_mask.png").read_bytes())
    with pytest.raises(ValueError, match="more than one mask"):
        convert(spark, Options(xml, masks=str(root / "masks"), **o))


def test_formats_and_chunks(spark, lens, capsys):
    """JPEG output of a deep and a turned image, one image at a time."""
    root, xml = lens
    rng = np.random.default_rng(8)
    smooth = np.repeat(np.repeat(rng.integers(0, 256, (6, 6, 3)), 8, 0), 8, 1).astype(np.uint8)
    (root / "images/a.png").write_bytes(images.png(smooth.astype(np.uint16) * 256 + 9))
    (root / "images/b.png").unlink()
    (root / "images/b.jpg").write_bytes(turned_jpeg(np.ascontiguousarray(smooth.swapaxes(0, 1)), 5))
    o = dict(images=str(root / "images"), masks=str(root / "masks"), face_width=FACE, chunk=1)
    out = convert(spark, Options(xml, "J", output=str(root / "out"), format="jpg", **o))
    assert out["processed"] == 2
    said = capsys.readouterr().out
    assert "[PROGRESS] REMAP_APPLY 0/2: images\n[PROGRESS] REMAP_APPLY 1/2: a\n[PROGRESS] REMAP_APPLY 2/2: b\n[PROGRESS] DONE 1/1: processed=2 skipped=0" in said
    convert(spark, Options(xml, "P", output=str(root / "out"), format="png", **o))
    read = lambda p: {r.path.rpartition("/")[2][:1] + r.path.rpartition("_")[2][:-4]: np.frombuffer(r.data, np.uint8).astype(int) for r in images.read_images(spark, [str(x) for x in (root / "out").glob(p)]).collect()}
    jpg, png = read("J/images/*/*.jpg"), read("P/images/*/*.png")
    assert set(jpg) == set(png) and len(jpg) == 10
    for k in jpg:
        assert np.abs(jpg[k] - png[k]).mean() < 2, k
        assert np.abs(png[k] - png[("b" if k[0] == "a" else "a") + k[1:]]).mean() < 2  # both hold the same picture


def test_command_line(spark, lens, capsys):
    root, xml = lens
    args = ["--calibration", xml, "--label", "M", "--images", str(root / "images"), "--output", str(root / "out"), "--max-fov", "180", "--face-width", str(FACE), "--rig", "--format", "tiff"]
    assert main(args) == 0
    assert "Set and keep fixed: f=10, cx=0" in capsys.readouterr().out
    assert (root / "out/M/images/dir_plusZ/a_dir_plusZ.tif").exists()
    assert main(args) == 0 and "processed=0 skipped=2" in capsys.readouterr().out
    for bad in (["--max-fov", "0"], ["--format", "gif"], ["--version"], ["--usage"]):
        with pytest.raises(SystemExit):
            main([*args, *bad])
    said = capsys.readouterr().out
    assert "prismara 0" in said and "keep it fixed" in said
    assert lens_label("/a/b/back.lens.xml") == "back.lens"


def test_calibrations_are_summed_up(spark, tmp_path):
    calibration(tmp_path / "one.xml")
    (tmp_path / "two.xml").write_text("<calibration><width>5</width><f>x</f></calibration>")
    (tmp_path / "three.xml").write_text("<other/>")
    got = sorted(r.summary for r in summary(read_calibrations(spark, str(tmp_path))).collect())
    assert got == ["?  5x?  f=?", f"equisolid_fisheye  {SIZE}x{SIZE}  f={LENS.scaled(SIZE).f}"]


def test_image_files_are_counted(spark, lens):
    root, _ = lens
    assert images.image_count(spark, str(root / "images")) == 2


def test_approved_counts_masks(spark, lens):
    root, _ = lens
    (root / "masks/b_mask.png").write_bytes(images.png(np.full((SIZE, SIZE), 200, np.uint8)))
    got = images.approved(images.read_images(spark, str(root / "masks")), 127).toPandas()
    n = np.zeros((SIZE, SIZE), int)
    n[got.v, got.u] = got.n
    v, u = np.indices((SIZE, SIZE))
    assert len(got) == SIZE * SIZE and (n == 1 + ((v - SIZE // 2) ** 2 + (u - SIZE // 2) ** 2 < 22**2)).all()
