"""Language-model scoring with a probabilistic suffix tree.

The symbols are the bytes of a text's words (A-Z lower-cased) with one space
between them and an end behind them; tokens, for the plain base score, are the
words and the end. A pass over the training texts counts words and runs of
symbols; both are summed over all data.

A context of up to ``DEPTH`` symbols becomes a state if it is met
``LEAST_COUNT`` times and if what follows it diverges enough from what follows
its longest proper suffix; so the states grow with the corpus. Next-symbol
distributions are smoothed with the parent's. A symbol is scored at the longest
suffix of what stands before it that is a state.

Contexts of up to ``BASE`` symbols, of which there are at most 256 ** BASE, are
collected and broadcast. All longer ones with the same last ``BASE`` + 1
symbols meet in one task, which finds the states below and the probability of
any run of ``DEPTH`` + 1 symbols.

Runs and words travel packed, in rows of a bucket: runs in ranges of those last
symbols that hold about equally many, words by their hash. Only runs and words
of a share of all (``HEAD_RUNS``, ``HEAD_SHARE``) are broadcast; what documents
have of others goes to the buckets, and sums for each document come back.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.llm.shared import discard, stored
from prismara.llm.text import space_words

#: A run of DEPTH + 1 symbols fills 64 bits.
DEPTH, BASE = 7, 2
#: A context is a state if it is met so often; a share of all symbols can be asked for besides.
LEAST_COUNT, LEAST_SHARE = 2, 0.0
#: Least divergence of a context from its suffix, in nats for each symbol that follows it, and in nats for each symbol of the corpus.
LEAST_NATS, LEAST_TOTAL = 0.02, 0.0
#: Shares of all symbols and tokens. There are at most 1 / HEAD_SHARE such words, of 1 / HEAD_SHARE mean tokens' bytes together.
HEAD_RUNS, HEAD_SHARE = 4e-8, 1e-6
#: A bucket of runs has about so many symbols.
BUCKET = 2_000_000
#: Symbols that no word has: before a text, behind it, between words.
BEFORE, END, SPACE = 0x0D, 0x0A, 0x20
SYMBOLS = 255  # all bytes but BEFORE
#: Words and symbols that a task keeps before it hands them on, symbols it scores together, and numbers it sends in one row.
HELD, HELD_SYMBOLS, BLOCK, SENT = 250_000, 5_000_000, 1_000_000, 600_000
END_TOKEN = b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str | Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 7."""
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def symbols(texts: list[list[bytes]]) -> np.ndarray:
    """The symbols of texts, given as words, each with ``DEPTH`` times BEFORE in front."""
    front, end = bytes([BEFORE]) * DEPTH, bytes([END])
    return np.frombuffer(b"".join([front + b" ".join(w) + end for w in texts]), np.uint8)


def runs(stream: np.ndarray) -> np.ndarray:
    """For each symbol of the texts: it and the ``DEPTH`` before it, the symbol in the lowest byte."""
    padded = np.concatenate([np.zeros(7 - DEPTH, np.uint8), stream])
    code = np.ndarray((max(0, len(padded) - 7),), ">u8", padded.tobytes(), strides=(1,)).astype(np.int64)
    code = code[stream[DEPTH:] != BEFORE]
    return code if DEPTH == 7 else code & ((1 << 8 * (DEPTH + 1)) - 1)


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress well."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _rising(x: np.ndarray) -> bytes:
    """The same for numbers in order."""
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _risen(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b), dtype=np.uint64)


def _words_by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of words by their hash, and the places of their words."""
    at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(at, kind="stable")
    first = _starts(at[order])
    for a, b in zip(first, [*first[1:], len(order)], strict=False):
        yield int(at[order[a]]), order[a:b]


#: Rows of counts: those of words (joined by spaces) by bucket, of short runs at -1 and below, of texts at ENDS.
COUNTS = "bucket int, keys binary, n binary"
ENDS, RUN_PARTS = -100, 16


def _rows(rows: list[tuple], names: tuple[str, ...] = ("bucket", "keys", "n"), kinds: tuple = (pa.int32(), pa.binary(), pa.binary())) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=list(names))


def counted(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """COUNTS of the words, of the runs of ``BASE`` + 1 symbols and of the ends of the training texts, each bucket in one row (runs and ends: in one row of each task)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[list[bytes]] = []
        size = ends = 0

        def met() -> tuple[np.ndarray, np.ndarray]:
            c, n = np.unique((runs(symbols(waiting)) & ((1 << 8 * (BASE + 1)) - 1)).astype(np.int32), return_counts=True)
            return _merged(np.r_[codes, c], np.r_[counts, n])

        def out() -> Iterator[pa.RecordBatch]:
            key, n = list(words), np.fromiter(words.values(), np.int64, len(words))
            if rows := [(b, b" ".join([key[i] for i in at]), _packed(n[at])) for b, at in _words_by_bucket(key, buckets)]:
                yield _rows(rows)

        for batch in batches:
            for t in batch.column(0):
                w = space_words(t.as_py())
                words.update(w)
                ends += 1
                waiting.append(w)
                size += sum(map(len, w)) + len(w) + DEPTH + 1
                if size >= BLOCK:
                    codes, counts = met()
                    waiting, size = [], 0
                if len(words) > HELD:
                    yield from out()
                    words = Counter()
        if waiting:
            codes, counts = met()
        yield from out()
        part = codes % RUN_PARTS
        rows = [(-1 - i, _rising(codes[part == i].astype(np.uint64)), _packed(counts[part == i])) for i in range(RUN_PARTS) if (part == i).any()]
        if ends:
            yield _rows([*rows, (ENDS, b"", _packed(np.array([ends])))])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, Counter()
        codes, counts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def out() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if now == ENDS:
                yield _rows([(now, b"", _packed(np.array([ends])))])
            elif now < 0:
                yield _rows([(now, _rising(codes.astype(np.uint64)), _packed(counts))])
            else:
                yield _rows([(now, b" ".join(words), _packed(np.fromiter(words.values(), np.int64, len(words))))])

        for batch in batches:
            for bucket, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from out()
                    now, words, codes, counts, ends = bucket, Counter(), codes[:0], counts[:0], 0
                n = _unpacked(n).astype(np.int64)
                if bucket == ENDS:
                    ends += int(n.sum())
                elif bucket < 0:
                    codes, counts = _merged(np.r_[codes, _risen(keys).astype(np.int64)], np.r_[counts, n])
                else:
                    for w, m in zip(keys.split(), n.tolist(), strict=True):
                        words[w] += m
        yield from out()

    train = docs.where(~held_out(id_col)).select(F.col(text_col).cast("binary").alias("t"))
    return train.mapInArrow(work, COUNTS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(together, COUNTS)


def totals(counts: DataFrame) -> tuple[int, int]:
    """How many tokens there are, and how many kinds of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [_unpacked(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], names=["tokens", "kinds"])

    each = counts.where(f"bucket >= 0 or bucket = {ENDS}").select("bucket", "n").mapInArrow(work, "tokens long, kinds long")
    got = each.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    return got.tokens, got.kinds


def frequent(counts: DataFrame, least: float) -> dict[bytes, int]:
    """The words met ``least`` times, with the end if there is a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = _unpacked(n).astype(np.int64)
                at = np.flatnonzero(n >= least) if bucket >= 0 else np.arange(len(n))
                words = keys.split() if bucket >= 0 else [END_TOKEN]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.binary()), pa.array(n[at])], names=["word", "n"])

    got = counts.where(f"bucket >= 0 or bucket = {ENDS}").select("bucket", "keys", "n").mapInArrow(work, "word binary, n long").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


@dataclass(frozen=True)
class Tree:
    """The states by number: ``states`` (length, context; the root first), and what follows them: ``at`` (state), ``next`` and ``n``, by state."""

    lengths: np.ndarray
    contexts: np.ndarray
    at: np.ndarray
    next: np.ndarray
    n: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """``child[state, older symbol]``, with a row for no state behind the others, and ``log10[state, symbol]``."""
        count = len(self.lengths)
        number = {(int(k), int(c)): i for i, (k, c) in enumerate(zip(self.lengths, self.contexts, strict=True))}
        child = np.full((count + 1, 256), count, np.int32)
        p = np.zeros((count, 256))
        edges = np.searchsorted(self.at, np.arange(count + 1))
        for i in range(count):  # parents come first
            k, c = int(self.lengths[i]), int(self.contexts[i])
            nxt, n = self.next[edges[i] : edges[i + 1]], self.n[edges[i] : edges[i + 1]]
            if k:
                parent = number[k - 1, c & ((1 << 8 * (k - 1)) - 1)]
                child[parent, c >> 8 * (k - 1)] = i
                weight = max(1, len(nxt))
                p[i] = p[parent] * weight
            else:
                weight = SYMBOLS
                p[i] = 1
                p[i, BEFORE] = 0
            p[i, nxt] += n
            p[i] /= n.sum() + weight
        with np.errstate(divide="ignore"):
            return child, np.log10(p)


def turned(codes: np.ndarray) -> np.ndarray:
    """Runs with the context's symbols in the other order, the latest in the highest byte, or back: in order, a context's extensions follow each other."""
    codes = codes.view(np.uint64)
    return (codes.byteswap() << np.uint64(8)) | (codes & np.uint64(255))


def _starts(contexts: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.zeros(0, int)


def _shorter(codes: np.ndarray) -> np.ndarray:
    """Turned contexts, each with a symbol behind it, without their oldest symbol."""
    return (codes >> np.uint64(16) << np.uint64(8)) | (codes & np.uint64(255))


def _diverge(first: np.ndarray, n: np.ndarray, parent_n: np.ndarray, parent_m: np.ndarray, least: float, least_nats: float) -> np.ndarray:
    """For contexts that begin at ``first``, whether they are states by themselves."""
    m = np.add.reduceat(n, first)
    own = np.repeat(m, np.diff(np.r_[first, len(n)]))
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(n > 0, n * (np.log(n / own) - np.log(parent_n / parent_m)), 0.0)
    nats = np.add.reduceat(each, first)
    return (m >= least) & (nats >= LEAST_NATS * m) & (nats >= least_nats)


@dataclass(frozen=True)
class Base:
    """All contexts of up to ``BASE`` symbols as a ``tree``, which of them are states by themselves, the number of symbols, and what it asks of a state: how often met, nats."""

    tree: Tree
    own: np.ndarray
    total: int
    least: float
    least_nats: float

    def with_states(self, below: np.ndarray) -> Tree:
        """The states of the tree, given the states of ``BASE`` + 1 symbols."""
        t = self.tree
        number = {(int(k), int(c)): i for i, (k, c) in enumerate(zip(t.lengths, t.contexts, strict=True))}
        kept = {0}
        for k, c in [(BASE + 1, int(c)) for c in below] + [(int(t.lengths[i]), int(t.contexts[i])) for i in np.flatnonzero(self.own)]:
            kept |= {number[j, c & ((1 << 8 * j) - 1)] for j in range(1, min(k, BASE) + 1)}
        states = np.array(sorted(kept))
        take = np.isin(t.at, states)
        return Tree(t.lengths[states], t.contexts[states], np.searchsorted(states, t.at[take]), t.next[take], t.n[take])


def based(counts: DataFrame) -> Base:
    """The short contexts of counted runs of ``BASE`` + 1 symbols. Without any, the root alone."""
    got = counts.where(f"bucket < 0 and bucket > {ENDS}").select("keys", "n").toArrow()
    parts = [(_risen(k).astype(np.int64), _unpacked(n).astype(np.int64)) for k, n in zip(*(c.to_pylist() for c in got.columns), strict=True)]
    run, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [])))
    total, levels = int(n.sum()), []
    least = max(LEAST_COUNT, LEAST_SHARE * total), LEAST_TOTAL * total
    for k in range(BASE + 1):
        codes = run & ((1 << 8 * (k + 1)) - 1)
        levels.append(_merged(codes, n))
    lengths, contexts, at, nxt, counts, own = [np.zeros(1, int)], [np.zeros(1, np.int64)], [np.zeros(len(levels[0][0]), int)], [levels[0][0]], [levels[0][1]], [np.zeros(1, bool)]
    for k in range(1, BASE + 1 if total else 1):
        codes, m = levels[k]
        first = _starts(codes >> 8)
        shorter, parents = codes & ((1 << 8 * k) - 1), levels[k - 1]
        parent_first = _starts(parents[0] >> 8)
        parent_m = np.add.reduceat(parents[1], parent_first)[np.searchsorted(parents[0][parent_first] >> 8, shorter >> 8)]
        own.append(_diverge(first, m, parents[1][np.searchsorted(parents[0], shorter)], parent_m, *least))
        at.append(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)])) + sum(map(len, lengths)))
        lengths.append(np.full(len(first), k))
        contexts.append(codes[first] >> 8)
        nxt.append(codes & 255)
        counts.append(m)
    return Base(Tree(*map(np.concatenate, (lengths, contexts, at, nxt, counts))), np.concatenate(own), total, *least)


def ranges(base: Base) -> np.ndarray:
    """The edges of the buckets of runs, as turned contexts of ``BASE`` + 1 symbols that begin one."""
    t = base.tree
    deepest = t.lengths[t.at] == BASE
    code, n = t.contexts[t.at[deepest]] << 8 | t.next[deepest], t.n[deepest]
    turned_ = np.zeros(len(code), np.int64)
    for k in range(BASE + 1):
        turned_ |= (code >> 8 * k & 255) << 8 * (BASE - k)
    order = np.argsort(turned_)
    bucket = np.cumsum(n[order]) // BUCKET
    return turned_[order][np.flatnonzero(np.diff(bucket)) + 1].astype(np.uint64)


def _slices(keys: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of turned runs in order: buckets that have some, and from where to where."""
    at = np.r_[0, np.searchsorted(keys, edges << np.uint64(8 * (7 - BASE))), len(keys)]
    for i in np.flatnonzero(np.diff(at)):
        yield int(i), int(at[i]), int(at[i + 1])


def gathered(docs: DataFrame, id_col: str, text_col: str, edges: np.ndarray) -> DataFrame:
    """COUNTS of the turned runs of the training texts, in parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[bytes]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(turned(runs(symbols(waiting))), return_counts=True)
            if rows := [(i, _rising(keys[a:b]), _packed(n[a:b])) for i, a, b in _slices(keys, edges)]:
                yield _rows(rows)

        for batch in batches:
            for t in batch.column(0):
                w = space_words(t.as_py())
                waiting.append(w)
                size += sum(map(len, w)) + len(w) + DEPTH + 1
                if size >= HELD_SYMBOLS:
                    yield from out()
                    waiting, size = [], 0
        if waiting:
            yield from out()

    return docs.where(~held_out(id_col)).select(F.col(text_col).cast("binary").alias("t")).mapInArrow(work, COUNTS)


def run_logs(keys: np.ndarray, n: np.ndarray, base: Base, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The log10 probability of the last symbol of each turned run, in order, at the longest state before it; not a number if that has ``BASE`` symbols or less.

    All runs of a context of ``BASE`` + 1 symbols are needed together.
    """
    child, logs = tables
    levels = [(keys, n)]
    for _ in range(DEPTH - BASE - 1):
        levels.append(_merged(_shorter(levels[-1][0]), levels[-1][1]))
    levels.reverse()  # of BASE + 1 to DEPTH symbols
    up = [np.searchsorted(a[0], _shorter(b[0])) for a, b in zip(levels, levels[1:], strict=False)]
    # What the tree says of the longest context in it.
    codes = levels[0][0]
    x = (codes & np.uint64(255)).astype(np.int64)
    state = np.zeros(len(codes), np.int64)
    for j in range(BASE):
        state = child[state, (codes >> np.uint64(8 * (BASE + 1 - j)) & np.uint64(255)).astype(np.int64)].astype(np.int64)
    t, none = base.tree, len(base.tree.lengths)
    pairs = t.at * 256 + t.next
    at = np.minimum(np.searchsorted(pairs, state * 256 + x), max(0, len(pairs) - 1))
    parent_n = np.where(pairs[at] == state * 256 + x, t.n[at], 0) if len(pairs) else np.zeros(len(codes), np.int64)
    parent_m = np.r_[np.bincount(t.at, t.n, none), 0.0][state]
    p = np.where(state == none, 0.0, 10.0 ** logs[np.minimum(state, none - 1), x])
    own, ps, of = [], [], []
    for k, (codes, m) in enumerate(levels):
        if k:
            parent_n, parent_m, p = levels[k - 1][1][up[k - 1]], sums[up[k - 1]], p[up[k - 1]]
        first = _starts(codes >> np.uint64(8))
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)]))
        sums = np.add.reduceat(m, first)[group]
        kinds = np.maximum(np.add.reduceat((m > 0).astype(np.int64), first), 1)[group]
        own.append(_diverge(first, m, parent_n, parent_m, base.least, base.least_nats)[group])
        p = (m + kinds * p) / (sums + kinds)
        ps.append(p)
        of.append((first, group))
    for k in range(len(levels) - 1, 0, -1):  # with all its suffixes
        first, group = of[k - 1]
        some = np.bincount(group[up[k - 1]], own[k], len(first)) > 0
        own[k - 1] = own[k - 1] | some[group]
    with np.errstate(divide="ignore"):
        best = np.where(own[0], np.log10(ps[0]), np.nan)
        for k in range(1, len(levels)):
            best = np.where(own[k], np.log10(ps[k]), best[up[k - 1]])
    return best


_made: dict[str, object] = {}


def _once(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once by a worker for the name last asked for."""
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


#: Of a bucket: its runs and their counts, its states of BASE + 1 symbols, and its frequent runs with their logarithms.
GROWN = "bucket int, keys binary, n binary, below binary, head binary, logs binary"


def grown(parts: DataFrame, base: Base, least: float) -> DataFrame:
    """The runs of each bucket (GROWN); frequent ones are met ``least`` times. A run whose longest state has ``BASE`` symbols or less is none of these."""
    shared, name = parts.sparkSession.sparkContext.broadcast(base), uuid.uuid4().hex
    names, kinds = ("bucket", "keys", "n", "below", "head", "logs"), (pa.int32(), *[pa.binary()] * 5)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        now, held = None, []

        def together() -> tuple[np.ndarray, np.ndarray]:
            return _merged(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                k, m = together()
                log = run_logs(k, m, base, _once(name, base.tree.tables))
                deep = ~np.isnan(log)
                below = np.unique(k[deep] >> np.uint64(8 * (7 - BASE)))
                top = deep & (m >= least)
                yield _rows([(now, _rising(k), _packed(m), _rising(below), _rising(k[top]), log[top].astype(np.float32).tobytes())], names, kinds)

        for batch in batches:
            for bucket, k, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from out()
                    now, held = bucket, []
                held.append((_risen(k), _unpacked(m).astype(np.int64)))
                if len(held) > 1 and sum(len(k) for k, _ in held) > 2 * max(len(held[0][0]), SENT):
                    held = [together()]
        yield from out()

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, GROWN)


@dataclass(frozen=True)
class Head:
    """The logarithms of frequent runs, found by hash: ``first`` gives the place of a hash's first run in ``keys``."""

    first: np.ndarray
    keys: np.ndarray
    logs: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, logs: np.ndarray) -> Head:
        bits = max(1, (2 * len(keys)).bit_length())
        slot = (keys * _MIX) >> np.uint64(64 - bits)
        order = np.argsort(slot)
        return Head(np.searchsorted(slot[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32), keys[order], logs[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which runs are there, and the logarithms of those."""
        bits = (len(self.first) - 1).bit_length() - 1
        slot = (keys * _MIX) >> np.uint64(64 - bits)
        at, end = self.first[slot], self.first[slot + np.uint64(1)]
        place = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            place[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        there = place >= 0
        return there, self.logs[place[there]]


def tree_scores(texts: list[list[bytes]], found: np.ndarray, logs: np.ndarray, below: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log10 probability of each text but for some of its symbols, and the texts and turned runs of those.

    ``found`` is the longest state of each context of ``BASE`` symbols, ``below`` marks contexts of ``BASE`` + 1 symbols, turned, that are states.
    """
    stream = symbols(texts)
    at = np.flatnonzero(stream != BEFORE)
    x, run = stream[at], turned(runs(stream))
    each = logs[found[(run >> np.uint64(8 * (8 - BASE))).astype(np.int64)], x]
    deep = np.flatnonzero(below[(run >> np.uint64(8 * (7 - BASE))).astype(np.int64)])
    run = run[deep]
    there, known = head.find(run)
    each[deep] = 0
    each[deep[there]] = known
    sums = np.r_[0.0, np.cumsum(each)]
    ends = np.flatnonzero(x == END) + 1
    left = deep[~there]
    return np.diff(sums[np.r_[0, ends]]), np.searchsorted(ends, left, side="right"), run[~there]


#: Of documents: words met in training, logarithms of words, and of symbols.
SUMS = "uid long, known long, logs double, score double"


def _summed(sums: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    uid, *values = (np.concatenate(x) for x in zip(*sums, strict=True))
    uid, of = np.unique(uid, return_inverse=True)
    return uid, *(np.bincount(of, v, len(uid)) for v in values)


def asked(tables: DataFrame, requests: DataFrame, base: Base, run_buckets: int, parts: int) -> DataFrame:
    """SUMS of what documents ask of the buckets' tables, one row for each that asks; on their way sums are packed in ``parts`` parts of the documents.

    Both have ``bucket``, ``keys``, ``n``; a request has ``uids`` for its keys, which are
    runs below ``run_buckets`` (in order, one by one) and words from there on (``n`` times).
    """
    shared, name = tables.sparkSession.sparkContext.broadcast(base), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        now = None
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        words: dict[bytes, int] = {}
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        sums: list[tuple[np.ndarray, ...]] = []

        def answered() -> None:
            """The runs that wait, at once; those never met in training stand in the table with a count of 0."""
            if waiting:
                keys, uids = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting.clear()
                order = np.argsort(keys, kind="stable")
                keys, uids = keys[order], uids[order]
                all_keys, all_n = _merged(np.concatenate([k for k, _ in counts] + [keys]), np.concatenate([m for _, m in counts] + [np.zeros(len(keys), np.int64)]))
                log = run_logs(all_keys, all_n, base, _once(name, base.tree.tables))
                sums.append((uids, np.zeros(len(uids)), np.zeros(len(uids)), log[np.searchsorted(all_keys, keys)]))

        def out() -> Iterator[pa.RecordBatch]:
            if sums:
                uid, *values = _summed(sums)
                sums.clear()
                part = ((uid.astype(np.uint64) * _MIX) >> np.uint64(40)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                first = _starts(part[order])
                rows = [(int(part[order[a]]), *(x[order[a:b]].tobytes() for x in (uid, *values))) for a, b in zip(first, [*first[1:], len(order)], strict=True)]
                yield _rows(rows, ("part", "uid", "known", "logs", "score"), (pa.int32(), *[pa.binary()] * 4))

        for batch in batches:
            for bucket, keys, n, uids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    answered()
                    now, counts, words = bucket, [], {}
                if uids is None:
                    n = _unpacked(n).astype(np.int64)
                    if bucket < run_buckets:
                        counts.append((_risen(keys), n))
                    else:
                        words.update(zip(keys.split(), n.tolist(), strict=True))
                    continue
                uids = _unpacked(uids).astype(np.int64)
                if bucket < run_buckets:
                    waiting.append((_risen(keys), uids))
                    if sum(len(k) for k, _ in waiting) > SENT:
                        answered()
                else:
                    m, times = np.fromiter((words.get(w, 0) for w in keys.split()), np.int64, len(uids)), _unpacked(n).astype(np.int64)
                    sums.append((uids, np.where(m > 0, times, 0).astype(float), times * np.log10(m + 1), np.zeros(len(uids))))
                if sum(len(x[0]) for x in sums) > SENT:
                    yield from out()
        answered()
        yield from out()

    both = tables.select("bucket", "keys", "n", F.lit(None).cast("binary").alias("uids")).unionByName(requests.select("bucket", "keys", "n", "uids"))
    packed = both.repartition("bucket").sortWithinPartitions("bucket", F.col("uids").isNotNull()).mapInArrow(work, "part int, uid binary, known binary, logs binary, score binary")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if sums:
                uid, known, logs, score = _summed(sums)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(score)], names=["uid", "known", "logs", "score"])

        for batch in batches:
            for part, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from out()
                    now, sums = part, []
                sums.append((np.frombuffer(rest[0], np.int64), *(np.frombuffer(x) for x in rest[1:])))
                if sum(len(x[0]) for x in sums) > 2 * max(len(sums[0][0]), SENT):
                    sums = [_summed(sums)]
        yield from out()

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(together, SUMS)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text under the tree and under the plain counts of words.

    Columns: ``id_col``, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known`` (those met in training), ``train_tokens``, ``base_score`` (sum
    over tokens of log10((c + 1) / (N + V + 1))), ``score`` (log10 of the
    tree's probability of the text).

    One row for each input row: ids may repeat; a null id is not held out. A
    null or empty text has the end as its only token. If all rows are held
    out, nothing is known and the tree gives each symbol the same probability.
    Columns of other names are not read.
    """
    spark = docs.sparkSession
    word_buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts, counts_path = stored(counted(docs, id_col, text_col, word_buckets), "counts")
    n, v = totals(counts)
    head_words = frequent(counts, HEAD_SHARE * n)
    base = based(counts)
    edges = ranges(base)
    run_buckets = len(edges) + 1
    table, table_path = stored(grown(gathered(docs, id_col, text_col, edges), base, max(1.0, HEAD_RUNS * base.total)), "runs")
    top = table.select("below", "head", "logs").toArrow()
    below = np.concatenate([np.zeros(0, np.uint64), *map(_risen, top.column(0).to_pylist())]).astype(np.int64)
    head = Head.of(np.concatenate([np.zeros(0, np.uint64), *map(_risen, top.column(1).to_pylist())]), np.frombuffer(b"".join(top.column(2).to_pylist()), np.float32))
    as_code = np.zeros(len(below), np.int64)
    for k in range(BASE + 1):
        as_code |= (below >> 8 * k & 255) << 8 * (BASE - k)
    shared, name = spark.sparkContext.broadcast((head_words, base.with_states(as_code), below, head)), uuid.uuid4().hex
    del top, head
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["uid", "id", "n_tokens", "known", "logs", "score", "bucket", "keys", "n", "uids"]
    types = [pa.int64(), None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    schema = f"uid long, id {kind}, n_tokens long, known long, logs double, score double, bucket int, keys binary, n binary, uids binary"

    def prepared() -> tuple:
        words, tree, states, runs_head = shared.value
        child, logs = tree.tables()
        none = len(child) - 1
        found = np.zeros(1 << 8 * BASE, np.int32)
        turned_ = np.arange(1 << 8 * BASE)
        state = np.zeros(len(turned_), np.int64)
        for k in range(BASE):
            state = child[state, turned_ >> 8 * (BASE - 1 - k) & 255].astype(np.int64)
            found = np.where(state != none, state, found)
        deep = np.zeros(1 << 8 * (BASE + 1), bool)
        deep[states] = True
        return {w: math.log10(c + 1) for w, c in words.items()}, found, logs, deep, runs_head

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found, logs, deep, runs_head = _once(name, prepared)
        end = words.get(END_TOKEN)
        rare_words: tuple[list, list, list] = ([], [], [])
        rare_runs: list[tuple[np.ndarray, np.ndarray]] = []

        def requests(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows = []
            if rare_runs:
                keys, uids = (np.concatenate(x) for x in zip(*rare_runs, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, uids = keys[order], uids[order]
                rows += [(i, _rising(keys[a:b]), None, _packed(uids[a:b])) for i, a, b in _slices(keys, edges)]
            if rare_words[0]:
                word, times, uids = rare_words[0], np.array(rare_words[1]), np.array(rare_words[2])
                rows += [(run_buckets + b, b" ".join([word[i] for i in at]), _packed(times[at]), _packed(uids[at])) for b, at in _words_by_bucket(word, word_buckets)]
            rare_runs.clear()
            for x in rare_words:
                x.clear()
            if rows:
                none = [pa.nulls(len(rows), t or id_type) for t in types[:6]]
                yield pa.RecordBatch.from_arrays([*none, *(pa.array([r[i] for r in rows], types[6 + i]) for i in range(4))], names=names)

        def block(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
            score, text_of, rest = tree_scores(texts, found, logs, deep, runs_head)
            uids = np.asarray(batch.column(0))
            if len(rest):
                rare_runs.append((rest, uids[text_of]))
            n_tokens, known, sums = [], [], []
            for uid, w in zip(uids.tolist(), texts, strict=True):
                each = [words.get(x) for x in w]
                have = [x for x in each if x is not None]
                if len(have) < len(w):
                    rare = Counter(x for x, y in zip(w, each, strict=True) if y is None)
                    rare_words[0].extend(rare)
                    rare_words[1].extend(rare.values())
                    rare_words[2].extend([uid] * len(rare))
                n_tokens.append(len(w) + 1)
                known.append(len(have) + (end is not None))
                sums.append(sum(have) + (end or 0.0))
            mine = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip((n_tokens, known, sums, score), types[2:6], strict=True))]
            return pa.RecordBatch.from_arrays([*mine, *(pa.nulls(batch.num_rows, t) for t in types[6:])], names=names)

        for batch in batches:
            texts: list[list[bytes]] = []
            first, size = 0, 0
            for i, t in enumerate(batch.column(2)):
                texts.append(space_words(t.as_py()))
                size += sum(map(len, texts[-1])) + len(texts[-1]) + DEPTH + 1
                if size >= BLOCK or i == batch.num_rows - 1:
                    yield block(batch.slice(first, i + 1 - first), texts)
                    texts, first, size = [], i + 1, 0
                    if len(rare_words[0]) + sum(len(k) for k, _ in rare_runs) > SENT:
                        yield from requests(batch.column(1).type)
            id_type = batch.column(1).type
        if rare_runs or rare_words[0]:
            yield from requests(id_type)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(work, schema)
    rows, _ = stored(rows, "scored")
    shared.destroy()
    tables = table.select("bucket", "keys", "n").unionByName(counts.where("bucket >= 0").select((F.col("bucket") + run_buckets).alias("bucket"), "keys", "n"))
    rest = asked(tables, rows.where("bucket is not null").select("bucket", "keys", "n", "uids"), base, run_buckets, word_buckets)
    rest, _ = stored(rest.toDF("uid", "k", "l", "s"), "sums")
    discard(spark, counts_path, table_path)
    per = rows.where("bucket is null").select("uid", "id", "n_tokens", "known", "logs", "score").join(rest, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    each = float(np.log10(n + v + 1))
    return per.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", plus("known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (plus("logs", "l") - F.col("n_tokens") * F.lit(each)).alias("base_score"), plus("score", "s").alias("score"),
    )
