"""Image files: the JPEG coder, deep and turned sources, headers, and the sink of named files."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.sources import decode, images, jpeg, sink


def picture(height, width, channels=3, seed=1):
    """Smooth and noisy parts, and an edge."""
    rng = np.random.default_rng(seed)
    v, u = np.indices((height, width))
    x = np.stack([(v * 3 + u) % 256, 128 + 100 * np.sin(u / 9), np.where(u > width // 2, 250, 5)], 2)[:, :, :channels]
    x[: height // 3] = rng.integers(0, 256, (height // 3, width, channels))
    return x.astype(np.uint8) if channels == 3 else x[:, :, 0].astype(np.uint8)


@pytest.mark.parametrize(("height", "width"), [(64, 64), (1, 1), (7, 300), (129, 65), (700, 900)])
def test_jpeg_files_come_back_nearly_as_they_were(spark, tmp_path, height, width):
    for channels in (1, 3):
        x = picture(height, width, channels)
        (tmp_path / f"{channels}.jpg").write_bytes(jpeg.encode(x))
    for r in images.read_images(spark, str(tmp_path)).collect():
        channels = int(r.path[-5])
        x = picture(height, width, channels).reshape(height, width, -1).astype(int)
        got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels).astype(int)
        assert got.shape == (height, width, channels)
        assert np.abs(got - x).mean() < 2


def test_jpeg_of_flat_and_extreme_images(spark, tmp_path):
    for name, x in {"black": np.zeros((33, 40, 3), np.uint8), "white": np.full((33, 40, 3), 255, np.uint8), "board": (np.indices((40, 40)).sum(0) % 2 * 255).astype(np.uint8)}.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(x))
        r = images.read_images(spark, f"{tmp_path}/{name}.jpg").first()
        assert np.abs(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1).astype(int) - x.reshape(r.height, r.width, -1)).max() <= 2
    with pytest.raises(ValueError, match="cannot be"):
        jpeg.encode(np.zeros((0, 4), np.uint8))


def test_huffman_codes_are_prefix_free_and_short():
    rng = np.random.default_rng(3)
    for counts in (np.r_[1, np.zeros(255, int)], (1.7 ** np.arange(60)).astype(np.int64), rng.integers(0, 1000, 256), np.zeros(256, int)):
        sizes, order = jpeg.huffman(counts)
        code, length = jpeg.codes(sizes, order)
        assert sorted(order) == np.flatnonzero(counts).tolist() and sum(sizes) == len(order)
        words = [f"{code[s]:0{length[s]}b}" for s in order]
        assert all(len(w) <= 16 and "0" in w for w in words)
        assert not any(a != b and b.startswith(a) for a in words for b in words)


def filtered(pixels, kinds):
    """A PNG file whose lines are filtered in given ways, pixel by pixel."""
    height, width = pixels.shape[:2]
    raw = np.ascontiguousarray(pixels.astype(">u2") if pixels.dtype == np.uint16 else pixels).reshape(height, -1).view(np.uint8).reshape(height, -1).astype(int)
    step = raw.shape[1] // width
    out = bytearray()
    for y in range(height):
        out.append(kinds[y % len(kinds)])
        for i in range(raw.shape[1]):
            a = raw[y, i - step] if i >= step else 0
            b = raw[y - 1, i] if y else 0
            c = raw[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda z: (abs(p - z), (a, b, c).index(z)))
            out.append(int(raw[y, i] - (0, a, b, (a + b) // 2, paeth)[kinds[y % len(kinds)]]) % 256)
    samples = pixels.shape[2] if pixels.ndim == 3 else 1
    head = struct.pack(">IIBBBBB", width, height, 8 * pixels.dtype.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[samples], 0, 0, 0)
    block = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(bytes(out))
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"tEXt", b"x\0y") + block(b"IDAT", packed[:7]) + block(b"IDAT", packed[7:]) + block(b"IEND", b"")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_of_all_filters(kind, samples, monkeypatch):
    monkeypatch.setattr(decode, "BAND", 5)
    x = np.random.default_rng(samples).integers(0, np.iinfo(kind).max + 1, (23, 17, samples)).astype(kind)
    high = (x >> 8 if kind == np.uint16 else x).astype(np.uint8)
    want = high[:, :, 0] if samples < 3 else high[:, :, 2::-1]
    for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 4, 2, 3, 1), (1, 2, 2, 1, 0, 4)):
        assert (decode.decoded(filtered(x if samples > 1 else x[:, :, 0], kinds)) == want).all(), kinds


def test_png_that_cannot_be_decoded():
    x = np.zeros((4, 4), np.uint16)
    good = images.png(x)
    for bad, why in ((b"no", "not a TIFF"), (good[:24] + b"\x04" + good[25:], "4 bits"), (good[:28] + b"\x01" + good[29:], "interlaced"), (filtered(x, (0,)).replace(struct.pack(">II", 4, 4), struct.pack(">II", 4, 5)), "missing lines")):
        with pytest.raises(ValueError, match=why):
            decode.decoded(bad)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("differences", [1, 2])
@pytest.mark.parametrize("compression", [1, 8])
def test_tiff_in_strips(order, differences, compression):
    x = np.random.default_rng(9).integers(0, 65536, (11, 6, 3)).astype(np.uint16)
    strips = []
    for top in range(0, 11, 4):
        part = x[top : top + 4]
        if differences == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
        data = part.astype(f"{order}u2").tobytes()
        strips.append(zlib.compress(data) if compression == 8 else data)
    start = 8
    at = [start + sum(map(len, strips[:i])) for i in range(len(strips))]
    after = start + sum(map(len, strips))
    lists = struct.pack(f"{order}3I3I3H", *at, *map(len, strips), 16, 16, 16)
    tags = [(256, 4, 1, 6), (257, 4, 1, 11), (258, 3, 3, after + 24), (259, 3, 1, compression), (262, 3, 1, 2), (273, 4, 3, after), (277, 3, 1, 3), (278, 4, 1, 4), (279, 4, 3, after + 12), (317, 3, 1, differences)]
    body = b"".join(struct.pack(f"{order}HHI", *t[:3]) + (struct.pack(f"{order}HH", t[3], 0) if t[1] == 3 and t[2] == 1 else struct.pack(f"{order}I", t[3])) for t in tags)
    file = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", after + len(lists)) + b"".join(strips) + lists + struct.pack(f"{order}H", len(tags)) + body + bytes(4)
    assert (decode.decoded(file) == (x >> 8)[:, :, ::-1]).all()
    assert (decode.decoded(images.tiff(x[:, :, 0])) == x[:, :, 0] >> 8).all()


def test_orientations_put_corners_where_they_belong():
    x = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)
    want = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    for k, rows in want.items():
        assert decode.upright(x, k).tolist() == rows


def turned_jpeg(pixels, orientation, padding=0):
    """A JPEG file with an orientation tag, and a long comment before its size."""
    data = jpeg.encode(pixels)
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0" + bytes((orientation,)) + b"\0\0\0\0\0\0"
    comments = b"".join(b"\xff\xfe" + struct.pack(">H", 60_002) + bytes(60_000) for _ in range(padding))
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + comments + data[2:]


def test_deep_and_turned_files_are_read_as_they_are_meant(spark, tmp_path):
    x = picture(24, 40)
    deep = x.astype(np.uint16) * 256 + 77
    made = {"plain.png": images.png(x), "deep.png": images.png(deep), "deep.tif": images.tiff(deep), "gray.png": images.png(deep[:, :, 0]), "turned.jpg": turned_jpeg(np.ascontiguousarray(x.swapaxes(0, 1)[:, ::-1]), 8, padding=3)}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "note.txt").write_text("no image")
    heads = images.headers(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r for r in heads.collect()}
    assert {(r.width, r.height) for r in got.values()} == {(40, 24)} and got["turned.jpg"].orientation == 8 and got["deep.tif"].bits == 16
    assert images.unfit(heads, 40, 24).count() == 0
    read = {r.path.rpartition("/")[2]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in images.read_any(spark, heads).collect()}
    assert set(read) == set(made)
    for name in ("plain.png", "deep.png", "deep.tif"):
        assert (read[name] == x).all()
    assert (read["gray.png"][:, :, 0] == x[:, :, 0]).all()
    assert np.abs(read["turned.jpg"].astype(int) - decode.upright(x.swapaxes(0, 1)[:, ::-1], 8)).mean() < 2
    assert images.read_any(spark, heads.limit(0)).count() == 0


def test_headers_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "none.jpg").write_bytes(b"not an image")
    (tmp_path / "cut.png").write_bytes(images.png(np.zeros((4, 4), np.uint8))[:20])
    (tmp_path / "other.png").write_bytes(images.png(np.zeros((4, 5), np.uint8)))
    got = {r.path.rpartition("/")[2]: r.why.split(" ")[0] for r in images.unfit(images.headers(spark, str(tmp_path)), 4, 4).collect()}
    assert got == {"none.jpg": "no", "cut.png": "no", "other.png": "other"}


# The sink


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def test_named_files_appear_and_are_replaced(spark, tmp_path):
    for text in ("one", "two"):
        df = spark.range(40).repartition(5).select(F.concat(F.lit("d/"), F.col("id") % 4, F.lit("/"), F.col("id"), F.lit(".txt")).alias("name"), F.when(F.col("id") > 0, F.lit(text)).cast("binary").alias("data"), F.lit(1).alias("other"))
        sink.write_named(df, str(tmp_path / "out"))
        assert listed(tmp_path / "out") == sorted(f"d/{i % 4}/{i}.txt" for i in range(40))
        assert (tmp_path / "out/d/3/7.txt").read_text() == text and (tmp_path / "out/d/0/0.txt").read_text() == ""
    sink.write_named(df.limit(0), f"file://{tmp_path}/none")
    assert listed(tmp_path / "none") == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 37, F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.lit("x")).cast("binary")
    df = spark.range(0, 40, 1, 8).select(F.concat(F.lit("f"), F.col("id")).alias("name"), bad.alias("data"))
    with pytest.raises(Exception, match="stopped"):
        sink.write_named(df, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []
    for name in ("../x", "/x", None):
        with pytest.raises(Exception, match="does not name"):
            sink.write_named(spark.createDataFrame([(name, bytearray(b"x"))], "name string, data binary"), str(tmp_path / "out"))
    assert listed(tmp_path) == []


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """Two attempts of one task: only the one whose message reaches the driver makes its file."""
    import pyarrow as pa

    w = sink.NamedFilesWriter(str(tmp_path))
    batch = lambda x: iter([pa.RecordBatch.from_pydict({"name": ["a/b"], "data": [x]})])
    w.write(batch(b"lost"))
    w.commit([w.write(batch(b"kept")), None])
    assert listed(tmp_path) == ["a/b"] and (tmp_path / "a/b").read_bytes() == b"kept"


@pytest.mark.parametrize("there", [False, True])
def test_attempts_that_go_on_after_a_failure_leave_nothing(tmp_path, there):
    import pyarrow as pa

    w = sink.NamedFilesWriter(str(tmp_path), *(["_writing-x"] if there else []))
    (tmp_path / w.hidden).mkdir()
    batch = lambda name: pa.RecordBatch.from_pydict({"name": [name], "data": [b"x"]})

    def goes_on():
        yield batch("a/b")
        w.abort([])
        yield batch("c/d")

    with pytest.raises(OSError):
        w.write(goes_on())
    if there:
        with pytest.raises(OSError):
            w.write(iter([batch("late")]))
    assert list(tmp_path.iterdir()) == []


def test_a_folder_is_removed_while_files_are_added(tmp_path, monkeypatch):
    from pyarrow import fs

    class Busy:
        """The first two tries meet a file that was added after the folder was listed."""

        def __init__(self):
            self.real, self.tries = fs.LocalFileSystem(), 0

        def delete_dir(self, path):
            self.tries += 1
            if self.tries < 3:
                raise OSError("not empty")
            self.real.delete_dir(path)

        def __getattr__(self, name):
            return getattr(self.real, name)

    w, busy = sink.NamedFilesWriter(str(tmp_path)), Busy()
    (tmp_path / w.hidden / "a").mkdir(parents=True)
    monkeypatch.setattr(sink, "file_system", lambda path: (busy, path))
    w.abort([])
    assert list(tmp_path.iterdir()) == [] and busy.tries == 3


# Geometry files


@pytest.mark.parametrize("strip", [1, 7, 64])
@pytest.mark.parametrize("model", [None, "pinhole", "equidistant", "equirectangular"])
def test_geometry_files_come_back(spark, tmp_path, strip, model):
    from prismara.functions.geometry import Calibration
    from prismara.operators import rays
    from prismara.sources import raw

    c = Calibration("equisolid_fisheye", 12, 20, 7.0, 0.3, -0.2, 0.01)
    path = raw.export_geometry(spark, c, str(tmp_path), model, strip)
    assert os.path.basename(path) == raw.raw_name(c, model) and listed(tmp_path) == [os.path.basename(path)]
    assert os.path.getsize(path) == 5 * 4 * 12 * 20
    want = rays.geometry(spark, c, model).toPandas().sort_values(["v", "u"])
    got = raw.read_raw(spark, path, 12, 20, strip=5)
    assert got.rdd.getNumPartitions() == 4
    rows = got.toPandas().sort_values(["v", "u"])
    assert len(rows) == 240 and (rows[["v", "u"]].to_numpy() == want[["v", "u"]].to_numpy()).all()
    np.testing.assert_allclose(rows[raw.BANDS], want[raw.BANDS], rtol=1e-6, atol=1e-7)
    some = raw.read_raw(spark, f"file://{tmp_path}", 12, 20, ["qy"])
    assert some.columns == ["path", "v", "u", "qy"]
    np.testing.assert_allclose(some.toPandas().sort_values(["v", "u"]).qy, want.qy, rtol=1e-6, atol=1e-7)


def test_geometry_files_that_are_not_whole(spark, tmp_path):
    from prismara.functions.geometry import Calibration
    from prismara.operators import rays
    from prismara.sources import raw

    g = rays.geometry(spark, Calibration("equisolid_fisheye", 6, 9, 7.0))
    for bad in (g.where("v <> 4"), g.where("v > 3"), g.unionAll(g.where("v = 0 and u = 0")), g.withColumn("v", F.col("v") + 1), g.limit(0)):
        with pytest.raises(Exception, match="every pixel once"):
            raw.write_raw(bad, str(tmp_path / "g.raw"), 6, 9, strip=3)
        assert listed(tmp_path) == []
    raw.write_raw(g, str(tmp_path / "g.raw"), 6, 9)
    for width, bands, why in ((7, raw.BANDS, "another size"), (6, ["qq"], "bands are")):
        with pytest.raises(Exception, match=why):
            raw.read_raw(spark, str(tmp_path / "g.raw"), width, 9, bands).collect()
