"""SentencePiece encoding and decoding with a merge-type prefix table.

A merge-type (BPE) encoding has two properties that give a linear algorithm:

* every prefix of an encoding is the encoding of the text it spells, so each
  prefix of a text has exactly one last token;
* a token sequence is an encoding if and only if each pair of neighbours is
  one, because the first merge that would cross a boundary depends on the two
  tokens beside it alone.

So the table holds, for each prefix, its last token: among the vocabulary
pieces that an Aho-Corasick automaton finds to end there, the one that is
compatible with the last token of the prefix before it. The ids are then read
backwards from the end of the table.

Here a pair of symbols merges if its concatenation is a piece, the piece of
the best score first and the leftmost of equals; that is how the pair test
below is computed, on the two tokens only, and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks longer than this are encoded each time; shorter ones are remembered.
REMEMBERED_CHARS = 48
#: The bound on remembered pair tests and on the chunks of each generation.
REMEMBERED = 400_000


class PieceBpe:
    """Encoder and decoder for one SentencePiece model of the BPE type."""

    def __init__(self, model_file: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in usual}
        self.scores = {pieces[i]: sp.get_score(i) for i in usual}
        # Nothing merges across a place where no piece has the two characters side by side.
        self.splits_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        probe = " ".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]))
        self.plain = sp.normalize(probe) == self._plain(probe)
        # Of each piece of two characters or more: its length, itself, and the tests of tokens to its left ("": none).
        self.automaton = ahocorasick.Automaton()
        self.tests = 0
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece), piece, {}))
        self.automaton.make_automaton()
        self.memory = _Memory(self)

    @staticmethod
    def _plain(text: str) -> str:
        """What normalisation gives if it only marks spaces and puts one in front."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first, leftmost of equals; for the pair test."""
        parts = list(text)
        alive = [True] * len(parts)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.scores.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and parts[i] + parts[j] == both):
                continue
            parts[i], alive[j], after[i] = both, False, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stand side by side in the encoding of what they spell."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def prefix_table(self, chunk: str) -> list[str]:
        """The last token of each prefix.

        The automaton gives the pieces that end at a place longest first; only
        one of them can be right. If none of two characters or more is, the
        prefix ends with its last character alone.
        """
        last, decided = list(chunk), -1
        for end, (length, piece, tests) in self.automaton.iter(chunk):
            if end == decided:
                continue
            start = end + 1 - length
            left = last[start - 1] if start else ""
            found = tests.get(left)
            if found is None:
                self.tests += 1
                if self.tests > REMEMBERED:
                    self.tests = 0
                    for _, _, other in self.automaton.values():
                        other.clear()
                found = tests[left] = self.compatible(left, piece)
            if found:
                last[end], decided = piece, end
        return last

    def chunk_pieces(self, chunk: str) -> list[str]:
        """The pieces of one chunk, recovered backwards from its prefix table."""
        last, out, at = self.prefix_table(chunk), [], len(chunk)
        while at:
            out.append(last[at - 1])
            at -= len(out[-1])
        return out[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.chunk_pieces(chunk):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a whole text with begin and end ids, as little-endian unsigned 32-bit integers."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        spelt = self._plain(text) if self.plain else self.sp.normalize(text)
        if not self.splits_at_space:
            return begin + (self.memory[spelt] if spelt else b"") + end
        words = spelt.split(SPACE)
        if words[0] or "" in words[1:]:  # more spaces than one, or none in front
            return begin + b"".join(map(self.memory.__getitem__, self.chunks.findall(spelt))) + end
        return begin + b"".join(map(self.memory.__getitem__, map(SPACE.__add__, words[1:]))) + end

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


class _Memory(dict):
    """The packed ids of short chunks met lately, bounded: when full, it becomes the older of two generations."""

    def __init__(self, coder: PieceBpe):
        super().__init__()
        self.coder, self.older = coder, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            ids = self.coder.chunk_ids(chunk)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out


@lru_cache(maxsize=2)
def coder(model_file: str) -> PieceBpe:
    """One coder for each worker and model."""
    return PieceBpe(model_file)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Encode every whole text with begin and end ids and decode the ids again.

    Columns: ``id_col``, ``n_tokens`` (all ids), ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` and, if asked
    for, ``ids`` (array of int) and ``decoded``.

    A null text counts as empty: it has the begin and end ids and decodes to
    the empty text. Ids may be null or repeated: there is one row for each
    input row. An empty table gives none. Other columns of the input, whatever
    their names, are not read.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_file)
        try:
            for batch in batches:
                counts, of_ids, of_text, ids, texts = [], [], [], [], []
                for text in batch.column(1):
                    packed = c.packed(text.as_py() or "")
                    listed = np.frombuffer(packed, "<u4").tolist()
                    decoded = c.decode(listed)
                    counts.append(len(listed))
                    of_ids.append(hashlib.sha256(packed).hexdigest())
                    of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_output:
                        ids.append(listed)
                        texts.append(decoded)
                out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] * with_output
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_output])
        finally:
            c.memory.forget()  # the coder lives as long as its worker, through other stages

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(work, schema)
