"""Near-duplicates by 64-bit fingerprints: variants of segments with one bit deleted, verification, and connected components.

1. One pass over the texts gives each document its fingerprint. Documents of
   one fingerprint are represented by the smallest id from here on.
2. A fingerprint is cut into so few segments that of two fingerprints within
   the distance one segment differs by at most one bit: 2 segments for 3 bits.
   Each segment is indexed once for each of its bits, without that bit. Such a
   pair then has a variant in common.
3. Fingerprints of one variant are compared. Under the first bit of a segment
   all pairs are; under another bit only those that differ in it, since the
   others have met already. So a pair meets no more than once a segment.
   Variants of many fingerprints are dealt into blocks; a task compares two
   blocks and returns no more links than they have members, but for groups of
   up to 8, which return all theirs.
4. Components of the links are the groups of near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.minhash_dedup import components
from prismara.llm.shared import discard, fresh, small_broadcast, stored
from prismara.llm.text import space_words

BITS, SEED = 64, 42
#: Members of a block, and of groups that are compared side by side.
BLOCK, FEW = 1024, 8
#: Hot variants, and groups of copies, of up to so many rows are broadcast (16 bytes each).
BROADCAST_ROWS = 2_000_000


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bits that over half of the shingles' hashes have; 0 without words."""
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - k + 1].tolist()
    ends = (ends[k - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 15):  # all of them, in blocks of bounded memory
        some = zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in some], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``fp`` (64 bits as a signed number)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(work, "id long, fp long")


def variants(distance: int) -> list[tuple[int, int, bool]]:
    """For each variant: the bits that are kept, the one left out, and whether it is the first of its segment, under which all pairs are compared."""
    if not 1 <= distance < BITS // 2:
        raise ValueError(f"distance {distance} is not in 1..{BITS // 2 - 1}")
    segments = (distance + 2) // 2
    edges = [BITS * i // segments for i in range(segments + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        segment = (1 << high) - (1 << low)
        out += [(segment & ~(1 << b), 1 << b, b == low) for b in range(low, high)]
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def joined(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of both sides (``y`` counted behind ``x``) the first of their component, over pairs within the distance across the sides; members that are the first themselves are left out."""
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= distance
    n = len(x) + len(y)
    left, right = np.arange(len(x)), np.arange(len(x), n)
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], n).min(0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], n).min(1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    label = np.r_[left, right]
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def links(classes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links of representatives that join what all pairs of ``classes`` (``fp``, ``rep``) within ``distance`` join, and nothing else."""
    kinds = variants(distance)
    masks = F.array(*(F.lit(_signed(mask)) for mask, _, _ in kinds))
    members = classes.select("fp", "rep", F.posexplode(masks).alias("kind", "mask")).select("kind", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", "rep")
    sizes = members.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block)
    hot, hot_path = stored(sizes.select("kind", "value", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "hot")
    members = members.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, ["kind", "value"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = members.select("kind", "value", "fp", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("kind", "value", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fp", "rep")
    keys = ["kind", "value", "one", "two"]
    bits = np.array([bit for _, bit, _ in kinds], np.uint64)
    whole = np.array([first for _, _, first in kinds])

    def compared(table: pa.Table) -> pa.RecordBatch:
        kind, value, one, two, own = (np.asarray(table.column(c)) for c in [*keys, "own"])
        fp, rep = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("rep"))
        new = np.r_[True, (kind[1:] != kind[:-1]) | (value[1:] != value[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(fp)])
        a, b = [], []
        # Groups of a few, of one block: all pairs, each with the member so many places behind it.
        few = np.repeat((length <= FEW) & (one[first] == two[first]), length)
        group = np.cumsum(new)
        for behind in range(1, FEW):
            i = np.flatnonzero(few[:-behind] & (group[behind:] == group[:-behind]))
            near = np.bitwise_count(fp[i] ^ fp[i + behind]) <= distance
            near &= whole[kind[i]] | ((fp[i] ^ fp[i + behind]) & bits[kind[i]] != 0)
            a.append(rep[i[near]])
            b.append(rep[i[near] + behind])
        for g in np.flatnonzero((length > FEW) | ((length > 1) & (one[first] != two[first]))):
            part = slice(first[g], first[g] + length[g])
            f, r, k = fp[part], rep[part], kind[first[g]]
            side, set_ = own[part] != one[first[g]], (f & bits[k]) != 0
            across = one[first[g]] != two[first[g]]
            # All pairs, or those that differ in the bit that was left out; of one block, or across two.
            if whole[k]:
                sides = [(~side, side)] if across else [(~side, ~side)]
            else:
                sides = [(~side & ~set_, side & set_), (~side & set_, side & ~set_)] if across else [(~set_, set_)]
            for x, y in sides:
                if not x.any() or not y.any():
                    continue
                rest, of = joined(f[x], f[y], distance)
                both = np.r_[r[x], r[y]]
                a.append(both[rest])
                b.append(both[of])
        out_a, out_b = np.concatenate(a), np.concatenate(b)
        apart = out_a != out_b
        return pa.RecordBatch.from_arrays([pa.array(out_a[apart]), pa.array(out_b[apart])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # The last group of a batch may go on in the next one; a group has no more than two blocks.
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            key = [np.asarray(table.column(c)) for c in keys]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield compared(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield compared(pa.Table.from_batches(held).combine_chunks())

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a long, b long")
    out, _ = stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    discard(classes.sparkSession, hot_path)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """The group of every document among those with nearly equal fingerprints.

    Columns: ``id_col``, ``fingerprint`` (16 hexadecimal digits),
    ``component_id`` (smallest id reachable over links, itself included),
    ``kept`` (whether that is the document's own id).

    A fingerprint bit is 1 if over half of the XXH64 hashes of the text's
    shingles (words in lower case, repeats included; with fewer words, all of
    them) have it. Documents are linked if their fingerprints differ in at most
    ``distance`` bits; all such pairs count. Texts without words, empty or
    null, have fingerprint zero, which is linked like any other. There is one
    row for each input row: rows that repeat an id are one document with
    several fingerprints, and rows with a null id take part in no link, have a
    null component and are kept. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    prof, _ = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = prof.where("id is not null")
    classes, _ = stored(named.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")), "classes")
    found = links(classes.select("fp", "rep"), distance, block)
    # Rows that repeat an id with several fingerprints are one document: it links their classes.
    several = named.groupBy("id").agg(F.min("fp").alias("one"), F.max("fp").alias("two")).where("one <> two").select("id")
    several, several_path = stored(several, "several")
    if not several.isEmpty():
        of = named.join(several, "id").distinct().join(classes.select("fp", "rep"), "fp")
        found = found.unionAll(of.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = components(found)
    discard(spark, several_path)

    # Documents alone with their fingerprint and without links need no look-up.
    placed = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").where("k > 1 or component is not null").select("fp", F.coalesce("component", "rep").alias("component"))
    placed, _ = stored(placed, "placed")
    out = prof.join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kind = docs.schema[id_col].dataType
    return out.select(
        F.col("id").cast(kind).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, the one of the smallest id, with all columns; rows with a null id stay."""
    name = fresh(docs, "gone")
    gone, _ = stored(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias(name)).distinct(), "gone")
    return docs.join(small_broadcast(gone), F.col(id_col) == F.col(name), "left_anti")
