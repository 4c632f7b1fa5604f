"""Token counts that follow edits: segment trees over pre-tokens.

A text is split into pre-tokens by the tokenizer's pattern; each is encoded by
itself, so the count of a text is the sum over its pre-tokens. A document
keeps a segment tree whose leaves are short runs of pre-tokens and whose
nodes hold the sums of characters and tokens below them.

An edit replaces a span of characters. The tree finds the leaves that it
touches; splitting starts again a few characters before the span, at the
begin of a pre-token, because the pattern looks ahead, and ends as soon as a
new boundary behind the span falls on an old one, because the pattern does
not look back: from there on everything stays as it was. Only the pre-tokens
between are encoded, and only the sums above their leaves are renewed.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a leaf at first, and those at which leaves are made anew.
LEAF, FULL = 32, 256
#: Characters before a span that can change how the text before it is split: the pattern looks at most two characters ahead of a pre-token's end.
AHEAD = 2
#: The bound on pre-tokens whose counts a worker remembers, and on the length of those.
REMEMBERED, REMEMBERED_CHARS = 400_000, 40


class Counter:
    """Splits texts by ``pattern``, which must not look back, and counts the tokens of pre-tokens under the ranks of ``rank_file``."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts = _Counts(self.encoding)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def whole(self, text: str) -> int:
        """The count of a text, by encoding all of it."""
        return sum(map(self.counts.__getitem__, self.split(text)))


class _Counts(dict):
    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class CountedText:
    """A text, its pre-tokens in leaves, and the sums above them.

    ``chars`` and ``tokens`` are the trees: node 1 is the root, nodes 2i and
    2i + 1 stand below node i, and the leaves begin at ``base``.
    """

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF, kept: tuple[bytes, bytes] | None = None):
        """``kept``: what :meth:`state` gave for the same text; then nothing is split or encoded."""
        self.counter, self.leaf = counter, leaf
        if kept is None:
            pieces = counter.split(text)
            counts = list(map(counter.counts.__getitem__, pieces))
        else:
            ends = list(accumulate(array("I", kept[0])))
            pieces = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            counts = array("I", kept[1]).tolist()
        self.encoded = 0
        self._build(pieces, counts)

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        leaf = self.leaf
        self.leaves = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self.counts = [counts[i : i + leaf] for i in range(0, len(counts), leaf)] or [[]]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i in range(len(self.leaves)):
            self._fill(i)
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def state(self) -> tuple[bytes, bytes]:
        """Characters and tokens of every pre-token: with the text, all of the tree."""
        return array("I", (len(p) for leaf in self.leaves for p in leaf)).tobytes(), array("I", (n for leaf in self.counts for n in leaf)).tobytes()

    def _fill(self, leaf: int) -> None:
        self.chars[self.base + leaf] = sum(map(len, self.leaves[leaf]))
        self.tokens[self.base + leaf] = sum(self.counts[leaf])

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and where that leaf begins; for a place behind the text, the last leaf with characters."""
        at = max(0, min(at, self.n_chars - 1))
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if at - begin >= self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` up to ``end`` by ``new``; places outside the text mean its ends."""
        size = self.n_chars
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        first, begin = self.find(max(0, start - AHEAD - 1))
        # The pre-token that ends within AHEAD of the span, or behind it, is the first in doubt.
        kept = 0
        for piece in self.leaves[first]:
            if begin + len(piece) >= start - AHEAD:
                break
            begin += len(piece)
            kept += 1
        last, last_begin = self.find(end)
        while True:
            # What stands from there to the end of the last leaf, and a look beyond it.
            held = [p for i in range(first, last + 1) for p in self.leaves[i]][kept:]
            old, at = set(), begin
            for p in held:
                old.add(at)
                at += len(p)
            stop, shift = at, len(new) - (end - start)
            beyond = self._after(last, AHEAD + 1)
            text = "".join(held)
            text = text[: start - begin] + new + text[end - begin :] + beyond
            limit, edited = stop + shift, start + len(new)
            if stop < size:
                old.add(stop)
            pieces, here, met = [], begin, None
            for m in self.counter.pattern.finditer(text):
                if here >= edited and here - shift in old and here - shift >= end:
                    met = here
                    break
                if begin + m.end() > limit and stop < size:
                    break  # it may go on behind what is in sight
                pieces.append(m[0])
                here = begin + m.end()
            else:
                if stop >= size or (here >= edited and here - shift in old and here - shift >= end):
                    met = here
            if met is not None:
                break
            last += 1
            while not self.chars[self.base + last]:
                last += 1
        rest, at = 0, begin
        for p in held:
            if at + shift >= met:
                break
            rest += 1
            at += len(p)
        self.encoded += len(pieces)
        counts = [n for i in range(first, last + 1) for n in self.counts[i]][kept:]
        self.leaves[first] = self.leaves[first][:kept] + pieces + held[rest:]
        self.counts[first] = self.counts[first][:kept] + list(map(self.counter.counts.__getitem__, pieces)) + counts[rest:]
        touched = {self.base + first}
        self._fill(first)
        for i in range(first + 1, last + 1):
            self.leaves[i], self.counts[i] = [], []
            self._fill(i)
            touched.add(self.base + i)
        while touched := {n // 2 for n in touched if n > 1}:
            for node in touched:
                self._sum(node)
        if len(self.leaves[first]) > FULL:  # after so many new pre-tokens in one place; none is encoded again
            self._build([p for leaf in self.leaves for p in leaf], [n for leaf in self.counts for n in leaf])

    def _after(self, leaf: int, n: int) -> str:
        out = ""
        for i in range(leaf + 1, len(self.leaves)):
            out += "".join(self.leaves[i])[: n - len(out)]
            if len(out) >= n:
                break
        return out


@lru_cache(maxsize=2)
def counter(rank_file: str, pattern: str) -> Counter:
    """One counter for each worker."""
    return Counter(rank_file, pattern)


def trees(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segment tree of every text, to be kept: ``id_col``, ``text_col``, ``tree`` (characters and tokens of its pre-tokens, from which its sums follow without splitting or encoding), ``n_tokens``. Null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(rank_file, pattern)
        for batch in batches:
            kept = [CountedText(t.as_py() or "", c) for t in batch.column(1)]
            states = [dict(zip(("chars", "tokens"), k.state(), strict=True)) for k in kept]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, TREE_TYPE), pa.array([k.n_tokens for k in kept], pa.int64())], names=[id_col, text_col, "tree", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(work, f"`{id_col}` {kind}, `{text_col}` string, tree {TREE}, n_tokens long")


TREE, TREE_TYPE = "struct<chars: binary, tokens: binary>", pa.struct([("chars", pa.binary()), ("tokens", pa.binary())])


def recounted(
    docs: DataFrame, edits: Column | Callable[[str], list[dict]], rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tree_col: str | None = None, with_text: bool = False
) -> DataFrame:
    """Token counts of every whole text before and after its edits.

    ``edits``: an array of structs ``start``, ``stop`` (characters of the text
    as it was, 0 for the first) and ``new``, or a function that gives those of
    a text; they are applied from the last place to the first, so none moves
    another. Of two that overlap, the one that begins later comes first, and
    the other then replaces what it left. ``tree_col``: the trees that are
    kept of the same texts (see :func:`trees`); a null one is built.

    Columns: ``id_col``, ``n_before``, ``n_after``, ``n_edits``, ``n_chars``
    (after), ``n_pieces`` (pre-tokens before), ``n_encoded`` (pre-tokens that
    the edits made it encode again) and, if asked for, ``edited`` (the text)
    and its ``tree``.

    One row for each input row, whatever its id. A null text counts as empty.
    No or null edits leave the count; edits with a null place or text count as
    those of place 0 or of the empty text. Columns of other names are read by
    ``edits`` alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_before", "n_after", "n_edits", "n_chars", "n_pieces", "n_encoded"] + ["edited", "tree"] * with_text
    types = [pa.int64()] * 6 + [pa.string(), TREE_TYPE] * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(rank_file, pattern)
        for batch in batches:
            rows = []
            for text, changes, tree in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text, tree = text.as_py() or "", tree.as_py()
                kept = CountedText(text, c, kept=(tree["chars"], tree["tokens"]) if tree else None)
                before, pieces = kept.n_tokens, sum(map(len, kept.leaves))
                changes = apply_edits(kept, edits(text) if callable(edits) else changes.as_py() or [])
                more = (kept.text, dict(zip(("chars", "tokens"), kept.state(), strict=True))) if with_text else ()
                rows.append((before, kept.n_tokens, changes, kept.n_chars, pieces, kept.encoded, *more))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=[id_col, *names])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[:6]) + f", edited string, tree {TREE}" * with_text
    given = edits if isinstance(edits, Column) else F.lit(None).cast("int")
    edits = None if isinstance(edits, Column) else edits
    tree = F.col(tree_col) if tree_col else F.lit(None).cast(TREE)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"), given.alias("e"), tree.alias("k")).mapInArrow(work, schema)


def apply_edits(kept: CountedText, changes: Sequence[dict]) -> int:
    """Apply ``changes`` from the last place to the first; how many there were."""
    order = sorted(changes, key=lambda e: (e["start"] or 0, e["stop"] or 0), reverse=True)
    for e in order:
        kept.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
    return len(order)
