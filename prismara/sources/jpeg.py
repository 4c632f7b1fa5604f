"""A baseline JPEG coder over arrays, for workers that have no image library.

Blocks of 8 x 8 are transformed and rounded, coefficients are put in order of
frequency, and runs of zeros and sizes are Huffman-coded with tables made from
the image's own counts. Colours are not subsampled. All steps take a band of
blocks at a time; only the rounded coefficients are held for a whole image.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np

#: Blocks that are coded together.
BAND = 8192
_END, _ZEROS = 0x00, 0xF0  # no more coefficients; sixteen zeros


def _basis() -> np.ndarray:
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return (np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def _by_frequency() -> np.ndarray:
    """Places of a block, diagonal by diagonal, each the other way round than the last."""
    places = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(places, key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


BASIS, ORDER = _basis(), _by_frequency()
#: Luma and colour differences of red, green and blue; fixed values.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]], np.float32)


def coefficients(pixels: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Blocks x channels x 64 rounded coefficients of an image (gray or blue-green-red), edges repeated to whole blocks."""
    height, width = pixels.shape[:2]
    wide = np.pad(pixels, ((0, -height % 8), (0, -width % 8)) + ((0, 0),) * (pixels.ndim - 2), "edge")
    channels = 3 if pixels.ndim == 3 else 1
    rows, cols = wide.shape[0] // 8, wide.shape[1] // 8
    out = np.empty((rows * cols, channels, 64), np.int16)
    band = max(1, BAND // cols)
    for top in range(0, rows, band):
        part = wide[8 * top : 8 * (top + band)]
        if channels == 3:
            planes = part[:, :, ::-1].astype(np.float32) @ TO_YCC.T
            planes[:, :, 0] -= 128
        else:
            planes = part[:, :, None].astype(np.float32) - 128
        n = part.shape[0] // 8
        blocks = planes.reshape(n, 8, cols, 8, channels).transpose(0, 2, 4, 1, 3).reshape(-1, 8, 8)
        flat = (BASIS @ blocks @ BASIS.T).reshape(-1, 64)[:, ORDER]
        out[top * cols : (top + n) * cols] = np.rint(flat / steps).astype(np.int16).reshape(-1, channels, 64)
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits the size of each number has."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def symbols(blocks: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is coded for some blocks after those with mean values ``before``: table (0: means of luma, 1: rest of luma, 2 and 3: of colours), symbol, bits behind it and their number."""
    n, channels, _ = blocks.shape
    wide = np.zeros((n, channels, 65), np.int64)
    wide[:, :, :64] = blocks
    wide[:, :, 0] = np.diff(np.concatenate([before[None, :], blocks[:, :, 0]]).astype(np.int64), axis=0)
    wide = wide.reshape(-1, 65)
    there = wide != 0
    there[:, 0] = True
    there[:, 64] = ~there[:, 63]  # the end is said where zeros are left
    block, place = np.nonzero(there)
    value = wide[block, place]
    size = _bits(value)
    gap = np.where(place == 0, 0, place - np.r_[0, place[:-1]] - 1)
    last = place == 64
    symbol = np.where(place == 0, size, np.where(last, _END, (gap % 16) << 4 | size))
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    table = (place > 0) + 2 * (block % channels > 0)
    # Sixteen zeros have a symbol of their own, before the one that follows them.
    more = np.where(last | (place == 0), 0, gap // 16)
    at = np.repeat(np.arange(len(place)), more + 1)
    final = np.r_[at[1:] != at[:-1], True][: len(at)]
    return table[at], np.where(final, symbol[at], _ZEROS), np.where(final, extra[at], 0), np.where(final, size[at], 0)


def huffman(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """How many codes there are of 1 to 16 bits, and the symbols in order of their codes. No code consists of ones alone."""
    used = np.flatnonzero(counts)
    weights = {int(s): int(counts[s]) for s in used}
    while True:
        # A symbol that is never coded takes the longest code, which would be all ones.
        heap = [(w, s, (s,)) for s, w in weights.items()] + [(0, 256, (256,))]
        length = dict.fromkeys([*weights, 256], 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                length[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(length.values()) <= 16:
            break
        weights = {s: (w + 1) // 2 for s, w in weights.items()}
    order = sorted(weights, key=lambda s: (length[s], s))
    return [sum(length[s] == k for s in order) for k in range(1, 17)], order


def codes(sizes: list[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """By symbol, its code and how long that is."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = value = 0
    for k, n in enumerate(sizes, 1):
        for s in order[at : at + n]:
            code[s], length[s] = value, k
            value += 1
        at += n
        value <<= 1
    return code, length


def _written(value: np.ndarray, length: np.ndarray, left: tuple[int, int]) -> tuple[bytes, tuple[int, int]]:
    """Whole bytes of numbers of so many bits each (32 at most), after bits that were left over; and what is left over now."""
    value, length = np.r_[left[0], value], np.r_[left[1], length]
    end = np.cumsum(length)
    start = end - length
    word = start // 32
    window = value.astype(np.uint64) << (64 - start % 32 - length).astype(np.uint64)
    n = int(end[-1] // 32) + 2
    # Bits of different numbers never meet, so adding is joining; sums of 32-bit words are exact in double precision.
    high = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = (high + low).astype(">u4").view(np.uint8)
    whole, rest = divmod(int(end[-1]), 8)
    return data[:whole].tobytes(), (int(data[whole]) >> (8 - rest), rest)


def encode(pixels: np.ndarray, steps: np.ndarray | int = 1) -> bytes:
    """An image of bytes, gray or blue-green-red, as a JPEG file. ``steps`` rounds coefficients, in order of frequency; 1 is the best quality."""
    height, width = pixels.shape[:2]
    if not 0 < height < 65536 or not 0 < width < 65536:
        raise ValueError(f"JPEG files cannot be {width} x {height}")
    steps = np.broadcast_to(np.asarray(steps, np.float32), 64)
    blocks = coefficients(pixels, steps)
    channels = blocks.shape[1]

    def bands() -> Iterator[tuple[np.ndarray, ...]]:
        before = np.zeros(channels, np.int16)
        for at in range(0, len(blocks), BAND):
            part = blocks[at : at + BAND]
            yield symbols(part, before)
            before = part[-1, :, 0]

    counts = np.zeros((4, 256), np.int64)
    for table, symbol, _, _ in bands():
        counts += np.bincount(table * 256 + symbol, minlength=1024).reshape(4, 256)
    tables = [huffman(c) for c in counts[: 4 if channels == 3 else 2]]
    code, length = (np.stack(x) for x in zip(*(codes(*t) for t in tables), strict=True))

    def segment(kind: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data

    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x101, 0, 1, 1, 0, 0)), segment(0xDB, b"\0" + steps.astype(np.uint8).tobytes())]
    parts = [(i + 1, int(i > 0)) for i in range(channels)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes((i, 0x11, 0)) for i, _ in parts)))
    for k, (sizes, order) in enumerate(tables):
        out.append(segment(0xC4, bytes((k % 2 << 4 | k // 2,)) + bytes(sizes) + bytes(order)))
    out.append(segment(0xDA, bytes((channels,)) + b"".join(bytes((i, t << 4 | t)) for i, t in parts) + bytes((0, 63, 0))))
    left = (0, 0)
    for table, symbol, extra, size in bands():
        data, left = _written(code[table, symbol] << size | extra, length[table, symbol] + size, left)
        out.append(data.replace(b"\xff", b"\xff\0"))
    fill = -left[1] % 8
    if left[1]:
        out.append(bytes((left[0] << fill | (1 << fill) - 1,)).replace(b"\xff", b"\xff\0"))
    return b"".join([*out, b"\xff\xd9"])
