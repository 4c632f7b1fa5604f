"""Decoding of files that Spark's image reader cannot take: PNG and TIFF of 16 bits a sample, and images that are stored turned.

Files are taken apart in workers, an image at a time. Samples of 16 bits keep
their high byte.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Samples of a pixel by the colour type of a PNG file: gray, colour, gray and colour with alpha.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Rows of a PNG file that are unfiltered together.
BAND = 256


def _unfiltered(kinds: np.ndarray, data: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes of a PNG file as they were before each was filtered in its way; ``step``: bytes of a pixel."""
    height, width = data.shape
    out = np.zeros((height + 1, width), np.uint8)
    for top in range(0, height, BAND):
        some = slice(top, min(height, top + BAND))
        if (kinds[some] > 2).any():
            out[some.start + 1 : some.stop + 1] = _wavefront(kinds[some], data[some], out[top], step)
            continue
        for y in range(some.start, some.stop):
            if kinds[y] == 1:
                out[y + 1] = np.cumsum(data[y].reshape(-1, step), 0, np.uint8).ravel()
            else:
                out[y + 1] = data[y] + out[y] if kinds[y] == 2 else data[y]
    return out[1:]


def _wavefront(kinds: np.ndarray, data: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The same for lines of any filters: a pixel depends on three before it, so all pixels of a diagonal are taken at once."""
    height, n = len(data), data.shape[1] // step
    raw = data.reshape(height, n, step).astype(np.int16)
    done = np.zeros((height + 1, n + 1, step), np.int16)  # a line above and a pixel to the left
    done[0, 1:] = above.reshape(n, step)
    kind = kinds[:, None]
    for t in range(n + height - 1):
        y = np.arange(max(0, t - n + 1), min(height, t + 1))
        x = t - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        k = kind[y]
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, nearest, 0))))
        done[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return done[1:, 1:].astype(np.uint8).reshape(height, -1)


def _colours(samples: np.ndarray) -> np.ndarray:
    """Bytes as gray or blue-green-red; alpha is left out."""
    return samples[:, :, 0] if samples.shape[2] < 3 else np.ascontiguousarray(samples[:, :, 2::-1])


def png(data: bytes) -> np.ndarray:
    """Pixels of a PNG file of 8 or 16 bits a sample, gray or blue-green-red bytes; interlaced files and palettes are refused."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + length
    if not head:
        raise ValueError("a PNG file without a header")
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or colour not in SAMPLES or interlaced:
        raise ValueError(f"a PNG file of {bits} bits, colour type {colour}{', interlaced' if interlaced else ''} cannot be decoded")
    step = SAMPLES[colour] * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != height * (1 + width * step):
        raise ValueError("a PNG file with missing lines")
    lines = lines.reshape(height, -1)
    if lines[:, 0].max(initial=0) > 4:
        raise ValueError("a PNG file with an unknown filter")
    plain = _unfiltered(lines[:, 0], lines[:, 1:], step).reshape(height, width, SAMPLES[colour], bits // 8)
    return _colours(plain[:, :, :, 0])


def _entries(data: bytes) -> tuple[str, dict[int, list[int]]]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF file")
    start = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, start)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, start + 2 + 12 * i)
        form, size = {3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
        if form:
            place = start + 10 + 12 * i
            if count * size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            out[tag] = list(struct.unpack_from(f"{order}{count}{form}", data, place))
    return order, out


def tiff(data: bytes, deep: bool = False) -> np.ndarray:
    """Pixels of a TIFF file in strips of 8 or 16 bits a sample, uncompressed or deflated, with or without differences between neighbours.

    ``deep`` returns the samples of a gray file as they are.
    """
    order, tags = _entries(data)
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    compression, photometric, differences = one(259, 1), one(262, 1), one(317, 1)
    if bits not in (8, 16) or compression not in (1, 8, 32946) or differences not in (1, 2) or one(284, 1) != 1 or photometric > 2 or 273 not in tags or 279 not in tags:
        raise ValueError(f"a TIFF file of {bits} bits, compression {compression}, colour space {photometric} cannot be decoded")
    size = bits // 8
    strips, rows = [], one(278, height)
    for i, (at, length) in enumerate(zip(tags[273], tags[279], strict=True)):
        body = data[at : at + length]
        if compression != 1:
            body = zlib.decompress(body)
        high = min(rows, height - i * rows)
        need = high * width * samples * size
        if len(body) < need:
            raise ValueError("a TIFF file with missing rows")
        strip = np.frombuffer(body, f"{order}u{size}", high * width * samples).reshape(high, width, samples)
        strips.append(np.cumsum(strip, 1, strip.dtype.newbyteorder("=")) if differences == 2 else strip)
    pixels = np.concatenate(strips)
    if deep:
        return pixels[:, :, 0]
    out = (pixels >> 8 if size == 2 else pixels).astype(np.uint8)
    return _colours(255 - out if photometric == 0 else out)


def decoded(data: bytes) -> np.ndarray:
    return png(data) if data[:4] == b"\x89PNG" else tiff(data)


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels of an image that is stored in one of eight orientations, as it is meant to be seen."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return np.ascontiguousarray(pixels)
