"""Periodic runs of words: harmonic grid, suffix array, reversed array, range minima.

A run of period p and length 2p or more holds two neighbouring points jp and
(j+1)p of the grid of p. From these two, words agree forwards to the run's
end and backwards to its start, so for each p and j two queries for the
longest common extension find every run. A query is a range minimum over the
common prefixes of neighbours in the suffix array (backwards: in that of the
reversed words). The grids of all periods have n (1 + 1/2 + 1/3 + ...) points.

Texts are independent. A task takes several short ones at a time as one
sequence in which each has symbols of its own, so that no extension leaves its
text; a long text is taken alone, as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs are reported from this length on, whatever their period.
LEAST = 12
#: Short texts are taken together up to so many words.
TOGETHER = 1 << 16
#: Points of grids that are looked at together.
POINTS = 1 << 20

Change = Callable[[int | None, list[bytes]], list[bytes]]


class Extensions:
    """Longest common extensions in a sequence of whole numbers from 0: suffix array, common prefixes and their range minima."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        counts = np.bincount(symbols)
        first = np.cumsum(counts) - counts
        rank = first[symbols].astype(np.int64)
        # Ranks by the first 1, 2, 4, ... symbols; only places that share a rank are sorted again.
        levels, step = [rank.astype(np.int32)], 1
        open_ = np.flatnonzero(counts[symbols] > 1)
        while len(open_):
            behind = np.full(len(open_), -1, np.int64)
            inside = open_ + step < n
            behind[inside] = rank[open_[inside] + step]
            key = rank[open_] * (n + 1) + behind + 1
            order = np.argsort(key)
            key, at = key[order], open_[order]
            old = rank[at]
            place = np.arange(len(at))
            group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
            new = np.r_[True, key[1:] != key[:-1]]
            part = np.maximum.accumulate(np.where(new, place, 0))
            rank[at] = old + part - group
            levels.append(rank.astype(np.int32))
            alone = new & np.r_[new[1:], True]
            open_ = np.sort(at[~alone])
            step *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        # Common prefixes of neighbours, by the ranks of ever shorter prefixes.
        common = np.zeros(n, np.int32)
        if n:
            a, b = suffixes[:-1].copy(), suffixes[1:].copy()
            for level in range(len(levels) - 1, -1, -1):
                inside = (a < n) & (b < n)
                same = np.zeros(n - 1, bool)
                same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
                a[same] += 1 << level
                b[same] += 1 << level
            common[1:] = a - suffixes[:-1]
        self.minima = [common]
        width = 1
        while 2 * width <= n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: n - 2 * width + 1], last[width : n - width + 1]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from each ``i`` on equal those from its ``j`` on; ``i`` and ``j`` differ."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            m = level == k
            table = self.minima[k]
            out[m] = np.minimum(table[low[m]], table[high[m] - (1 << int(k))])
        return out


def grid(lengths: np.ndarray, points: int = POINTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of all grids: text, period, and the multiple of the period that is the first of two neighbouring points."""
    half = lengths // 2
    text = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    number = (lengths[text] - 1) // period
    ends = np.cumsum(number)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + points, "right")))
        n = number[at:stop]
        of = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield text[of], period[of], j * period[of]
        at = stop


def runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text (symbols from 0) its runs as rows of start, length and smallest period, by start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum())
    none = np.zeros((0, 3), np.int64)
    if n < 2:
        return [none for _ in texts]
    base = np.cumsum(lengths) - lengths
    sizes = np.array([int(t.max()) + 1 if len(t) else 0 for t in texts], np.int64)
    symbols = np.concatenate(texts).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, lengths)
    forward = backward = None
    found = []
    for text, period, point in grid(lengths):
        i = base[text] + point
        # Where the two words differ, the forward extension is empty; a run always has points whose words agree.
        met = symbols[i] == symbols[i + period]
        i, p, text = i[met], period[met], text[met]
        if not len(i):
            continue
        if forward is None:
            forward, backward = Extensions(symbols), Extensions(symbols[::-1])
        ahead = forward.common(i, i + p)
        back = np.zeros(len(i), np.int64)
        some = i > 0
        back[some] = backward.common(n - i[some], n - i[some] - p[some])
        length = ahead + back + p
        good = (length >= 2 * p) & (length >= least)
        found.append(np.stack([i[good] - back[good], length[good], p[good], text[good]]))
    if not found:
        return [none for _ in texts]
    start, length, p, text = np.concatenate(found, 1)
    # A run of period p is met again with multiples of p, as the same stretch; the smallest stays.
    order = np.lexsort((p, length, start))
    start, length, p, text = start[order], length[order], p[order], text[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, p, text = start[new], length[new], p[new], text[new]
    order = np.lexsort((p, start))
    rows = np.stack([start - base[text], length, p], 1)[order]
    return np.split(rows, np.searchsorted(text[order], np.arange(1, len(texts))))


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def _symbols(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change: Change | None = None, with_output: bool = False) -> DataFrame:
    """The periodic runs of every text's words, and the text without their repetitions.

    Words are stretches without a space or one of U+0009 to U+000D, upper and
    lower case told apart. A run is a stretch of consecutive words with
    smallest period q and a length of at least ``least`` and 2q that no
    neighbouring word extends. ``change(id, words)``, if given, returns the
    words to take in place of a text's own.

    Columns: ``id_col``, ``n_words``, ``n_runs``; of the longest run (ties: the
    smallest start, then period) ``start``, ``length``, ``period`` and
    ``exponent_milli`` (1000 lengths by periods, cut), null without runs;
    ``runs_sha256`` of the lines "start,length,period" of all runs by start and
    period, and ``collapsed_sha256`` of the words that no run contains behind
    its first q, joined by spaces. ``with_output`` adds ``runs`` (array of
    structs) and ``collapsed`` (text).

    There is one row for each input row: repeated and null ids are kept as they
    are, and null, empty and blank texts have no words and no runs. Other
    columns of the input are not read. A text is one value, so it is taken in
    one task, whole, with memory in proportion to n log n for its n words.
    """
    kind = docs.schema[id_col].dataType
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_output:
        fields += [("runs", pa.list_(struct)), ("collapsed", pa.string())]
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    out_schema = pa.schema(fields)

    def row(i: int | None, words: list[bytes], found: np.ndarray) -> tuple:
        best: tuple = (None,) * 4
        if len(found):
            start, length, period = map(int, found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]])
            best = start, length, period, 1000 * length // period
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found.tolist())
        left = b" ".join([w for w, stays in zip(words, collapsed(len(words), found).tolist(), strict=True) if stays] if len(found) else words)
        out = (i, len(words), len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        if with_output:
            out += ([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], left.decode())
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple[int | None, list[bytes]]] = []
            size = 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (t.as_py() or b"").split()
                if change:
                    words = change(i, words)
                if held and size + len(words) > TOGETHER:
                    rows += [row(*h, f) for h, f in zip(held, runs([_symbols(w) for _, w in held], least), strict=True)]
                    held, size = [], 0
                held.append((i, words))
                size += len(words)
            rows += [row(*h, f) for h, f in zip(held, runs([_symbols(w) for _, w in held], least), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out_schema)], schema=out_schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(work, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *(c for c in out.columns if c != "id"))
