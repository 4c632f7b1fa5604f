"""Near-duplicates: universal hash minima with banding, verification, and connected components.

1. One pass over the texts gives each document the fingerprint of its shingle
   set and the minima of its shingles under universal hash functions.
   Documents of one fingerprint have equal sets; the smallest id stands for all
   of them from here on, so copies never meet each other.
2. Representatives that share a band are in one bucket, where sizes and
   signatures are compared; a task returns no more links than it has members.
   The components of these links are the candidate groups, so documents that
   share no more than a passage stay apart, however many share it.
3. Within a candidate group pairs are confirmed on full sets, the likeliest
   first; pairs that confirmed links have joined already are passed over.
4. Components of the confirmed links are the groups of near-duplicates.

Large buckets and groups are compared in rounds. The first deals them into
blocks of fixed size and looks within blocks only. The second looks at what the
links of the first have not joined: members outside the largest component of
their bucket or group meet all its members, block by block. So a group of near
copies costs what it has members, and no pair is left out that could join two
components.

Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.llm.shared import discard, fresh, small_broadcast, stored
from prismara.llm.text import space_words

#: Each band is a choice of 7 of the minima. A pair of similarity 0.8 shares none of 45 with probability 2.5e-5, one of 0.42 shares some with 0.1.
BANDS, ROWS, MINIMA = 45, 7, 120
#: Pairs whose signatures agree in a smaller share of minima are not confirmed: at a similarity of 0.8 that has probability 4e-5.
SCREEN = 0.65
#: The bound on words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Members of a block.
BLOCK = 512
#: Sets that a worker holds and hands on at once.
SETS = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift functions, universal over 64-bit keys."""
    rng = np.random.default_rng(20_240_817)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


def shingle_set(text: bytes | None, n: int, memory: _Hashes) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, ascending; with fewer words than ``n``, of all words together."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    m = len(h) - k + 1
    out = np.full(m, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : i + m]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """The minima of a set that is not empty, as 32-bit numbers."""
    a, b = _functions(minima)
    least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):  # whole sets, in blocks that fit the cache
        block = shingles[start : start + 4096]
        np.minimum(least, (a[:, None] * block[None, :] + b[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=4)
def _bands(bands: int, rows: int, minima: int) -> np.ndarray:
    """Which minima each band takes."""
    rng = np.random.default_rng(7)
    return np.stack([rng.choice(minima, rows, replace=False) for _ in range(bands)])


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of signatures, one in each row; the number of the band is part of it."""
    m = minima[:, _bands(bands, rows, minima.shape[1])].astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, m.shape[:2]).copy()
    for i in range(rows):
        out = (out ^ m[:, :, i]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``n`` (set size), ``set_key`` (of the set) and ``minima``; the last two null for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            n, keys, minima = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), shingle, memory)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                minima.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())], names=["id", "n", "set_key", "minima"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(work, "id long, n long, set_key binary, minima binary")


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``rep``, ``bucket``: a row for each band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            keys = band_keys(minima, bands, rows).view(np.int64).ravel() if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), bands), pa.int64()), pa.array(keys)], names=["rep", "bucket"])

    return classes.select("rep", "minima").mapInArrow(work, "rep long, bucket long")


def likely(short: np.ndarray, sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of members by their shortened minima: those that are not the first of their component of likely pairs, and that first one.

    ``side``: with 0 and 1 only pairs of both sides are looked at, with 0 alone all pairs.
    """
    n = len(sizes)
    pairs = np.zeros((n, n), bool)
    for a in range(0, n, 32):
        same = (short[a : a + 32, None, :] == short[None, :, :]).mean(2)
        least, most = np.minimum(sizes[a : a + 32, None], sizes[None, :]), np.maximum(sizes[a : a + 32, None], sizes[None, :])
        pairs[a : a + 32] = (same >= SCREEN) & (least * 100 >= most * percent)
    if side.any():
        pairs &= side[:, None] != side[None, :]
    np.fill_diagonal(pairs, True)
    label = np.arange(n)
    while True:
        least = np.where(pairs, label[None, :], n).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def _likely_links(dealt: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: links of the likely pairs of the blocks ``one`` and ``two`` of buckets (``bucket``, ``one``, ``two``, ``block``, ``rep``, ``n``, ``short``), which join what these pairs join."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("bucket", "one", "two")])
            block, rep, size = (np.asarray(table.column(c)).astype(np.int64) for c in ("block", "rep", "n"))
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(len(rep), -1)
            first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            length = np.diff(np.r_[first, len(rep)])
            # Buckets of two are looked at together, all others one by one.
            two = first[(length == 2) & (key[1, first] == key[2, first])]
            alike = ((short[two] == short[two + 1]).mean(1) >= SCREEN) & (np.minimum(size[two], size[two + 1]) * 100 >= np.maximum(size[two], size[two + 1]) * percent)
            a, b = [rep[two[alike]]], [rep[two[alike] + 1]]
            for i in np.flatnonzero((length > 2) | ((length == 2) & (key[1, first] != key[2, first]))):
                part = slice(first[i], first[i] + length[i])
                side = (block[part] != key[1, first[i]]).astype(np.int8)
                if key[1, first[i]] == key[2, first[i]] or side.any() and not side.all():
                    rest, of = likely(short[part], size[part], side, percent)
                    a.append(rep[part][rest])
                    b.append(rep[part][of])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            # The last bucket of a batch may go on in the next one.
            table = pa.Table.from_batches([*held, batch])
            key = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("bucket", "one", "two")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield links(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield links(pa.Table.from_batches(held).combine_chunks())

    keys = ["bucket", "one", "two"]
    rows = dealt.select(*keys, "block", "rep", "n", "short")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a long, b long").distinct()


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``id``, ``s``, ``minima``: the full sets of documents and their signatures, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, SETS):
                part = batch.slice(start, SETS)
                sets = [shingle_set(t.as_py(), shingle, memory) for t in part.column(1)]
                minima = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(minima, pa.binary())], names=["id", "s", "minima"])

    return texts.mapInArrow(work, "id long, s binary, minima binary").where("minima is not null")


def forest(ids: list[int], sets: list[np.ndarray], minima: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what the similar pairs of a task join, each id to the smallest one of its component.

    Members of the same id are joined already. ``side``: with 0 and 1 only
    pairs of both sides are looked at, with 0 alone all pairs. A pair whose
    signatures agree in less than SCREEN is not.
    """
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes, names = np.array([len(s) for s in sets]), np.array(ids)
    across = side.any()
    found: list[tuple[float, int, int]] = []
    for x in range(len(ids)):
        if across and side[x]:
            continue
        others = np.flatnonzero(side) if across else np.arange(x + 1, len(ids))
        others = others[names[others] != names[x]]
        others = others[np.minimum(sizes[others], sizes[x]) * 100 >= np.maximum(sizes[others], sizes[x]) * percent]
        alike = (minima[others] == minima[x]).mean(1)
        likely = alike >= SCREEN
        found.extend((-float(j), x, int(y)) for j, y in zip(alike[likely], others[likely], strict=True))
    for _, x, y in sorted(found):
        p, q = root(ids[x]), root(ids[y])
        if p != q:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                parent[max(p, q)] = min(p, q)
    return [(i, root(i)) for i in parent if root(i) != i]


def _confirmed(dealt: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``, ``final``: links of the similar pairs of the blocks ``one`` and ``two`` of candidate groups (``component``, ``one``, ``two``, ``block``, ``known``, ``final``, ``s``, ``minima``).

    Members of the same ``known`` are joined already, and links are between these.
    """

    def work(table: pa.Table) -> pa.Table:
        ids = table.column("known").to_pylist()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("s")]
        minima = np.stack([np.frombuffer(m.as_py(), np.uint32) for m in table.column("minima")])
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        side = np.asarray(table.column("block")) != one
        links = forest(ids, sets, minima, side, percent) if one == two or side.any() and not side.all() else []
        final = table.column("final")[0].as_py()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64()), "final": pa.array([final] * len(links), pa.bool_())})

    rows = dealt.select("component", "one", "two", "block", "known", "final", "s", "minima")
    return rows.groupBy("component", "one", "two").applyInArrow(work, "a long, b long, final boolean")


def within(members: DataFrame, group: str, id_: str, deals: int) -> DataFrame:
    """Members of groups of ``blocks`` blocks, each with its block as ``block``, ``one`` and ``two``; groups of several blocks are dealt ``deals`` times."""
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, deals - 1).otherwise(0))).alias("deal"))
    block = F.col("deal") * F.col("blocks") + F.pmod(F.xxhash64(id_, group, "deal"), F.col("blocks")).cast("int")
    return dealt.withColumns({c: block for c in ("block", "one", "two")}).drop("deal")


def unjoined(known: DataFrame, group: str, block: int) -> DataFrame:
    """Groups whose members are not all of one ``known``: ``most``, that of the most members, and the numbers of blocks of others, ``few``, and of these, ``many``."""
    sizes = known.groupBy(group, "known").agg(F.count(F.lit(1)).alias("k"))
    found = sizes.groupBy(group).agg(F.max_by("known", F.struct("k", "known")).alias("most"), F.max("k").alias("largest"), F.sum("k").alias("k")).where("k > largest")
    return found.select(group, "most", F.ceil((F.col("k") - F.col("largest")) / block).cast("int").alias("few"), F.ceil(F.col("largest") / block).cast("int").alias("many"))


def across(known: DataFrame, rest: DataFrame, group: str, id_: str) -> DataFrame:
    """Members of the groups in ``rest`` (see :func:`unjoined`), for each pair of blocks of which one at least has members outside the largest component."""
    hashed = F.xxhash64(id_, group)
    own = F.when(F.col("known") != F.col("most"), F.pmod(hashed, F.col("few"))).otherwise(F.col("few") + F.pmod(hashed, F.col("many"))).cast("int")
    dealt = known.join(rest, group).withColumn("block", own)
    last = F.when(F.col("block") < F.col("few"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)
    dealt = dealt.select(group, id_, "known", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select(group, id_, "known", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def _joined(found: DataFrame, members: DataFrame, group: str, id_: str, block: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id``, ``component``: components of the links that the first round ``found`` and of those that ``compare`` finds among what they have not joined of large groups (``group``, ``id_``)."""
    first, _ = stored(components(found), "first")
    known = members.join(first.select(F.col("id").alias(id_), F.col("component").alias("known")), id_, "left").select(group, id_, F.coalesce("known", id_).alias("known"))
    rest, _ = stored(unjoined(known, group, block), "rest")
    if rest.isEmpty():
        return first
    more, _ = stored(compare(across(known, rest, group, id_)), "more")
    return components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component``: the smallest id reachable over ``links`` (``a``, ``b``), for each id in a link.

    Large-star and small-star steps alternate until neither changes the links;
    then every id is linked to the smallest of its component alone.
    """
    spark = links.sparkSession
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def step(edges: DataFrame, large: bool) -> DataFrame:
        # Of each node, its neighbours (small: only the smaller ones) and the least of them with itself.
        nbrs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = nbrs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least, least_path = stored(least, "least")  # so that a hub's links can be split in the join
        used.append(least_path)
        met = nbrs.join(least, "u")
        if large:
            return met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row.n, row.x

    before = mark(edges)
    while before[0]:
        used: list[str] = []
        large, large_path = stored(step(edges, True), "edges")
        small, small_path = stored(step(large, False), "edges")
        now = mark(small)
        discard(spark, path, large_path, *used)
        edges, path = small, small_path
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _shortened(minima: Column) -> Column:
    """The lowest bytes of packed minima."""

    @F.pandas_udf("binary")
    def lowest(packed: pd.Series) -> pd.Series:
        return packed.map(lambda m: np.frombuffer(m, np.uint32).astype(np.uint8).tobytes())

    return lowest(minima)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """The group of every document among near-duplicates.

    Columns: ``id_col``, ``n_shingles`` (set size), ``component_id`` (smallest
    id reachable over links, itself included), ``kept`` (whether that is the
    document's own id).

    Documents are linked if a share of ``percent`` or more of the union of
    their shingle sets is in both. A text with fewer words than ``shingle``
    has one shingle of all its words; one without words, empty or null, has an
    empty set and is linked with nothing. There is one row for each input row:
    rows that repeat an id are one document with several texts, and rows with
    a null id take part in no link, have a null component and are kept. Other
    columns of the input are not read.
    """
    spark = docs.sparkSession
    prof, _ = stored(profiles(docs, id_col, text_col, shingle), "profiles")
    named = prof.where("n > 0 and id is not null")
    # Equal sets have equal minima: any document's will do.
    classes, _ = stored(named.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("minima").alias("minima")), "classes")
    members, members_path = stored(_buckets(classes, bands, rows), "members")
    # Only buckets of several documents matter. Tables on both sides let the join split a bucket that holds many.
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    shared, shared_path = stored(shared, "buckets")
    short = classes.select("rep", "n", _shortened(F.col("minima")).alias("short"))
    likely_, likely_path = stored(_likely_links(within(members.join(shared, "bucket"), "bucket", "rep", 1).join(short, "rep"), percent), "likely")
    large = shared.where("blocks > 1")
    if large.isEmpty():
        groups = components(likely_)
    else:
        groups = _joined(likely_, members.join(large, "bucket").select("bucket", "rep"), "bucket", "rep", block, lambda dealt: _likely_links(dealt.join(short, "rep"), percent))
    groups, groups_path = stored(groups, "groups")
    discard(spark, members_path, shared_path, likely_path)

    blocks = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    blocks, blocks_path = stored(blocks, "blocks")

    def sets(ids: DataFrame) -> DataFrame:
        return _sets(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).join(small_broadcast(ids), "id"), shingle)

    placed_sets = sets(groups.select("id")).join(groups, "id").join(blocks, "component").withColumns({"known": F.col("id"), "final": F.col("blocks") == 1})
    links, links_path = stored(_confirmed(within(placed_sets, "component", "id", 2), percent), "links")
    final = links.where("final").select(F.col("a").alias("id"), F.col("b").alias("component"))
    rest = None
    large = blocks.where("blocks > 1")
    if not large.isEmpty():

        def compare(dealt: DataFrame) -> DataFrame:
            return _confirmed(dealt.join(sets(dealt.select("id").distinct()), "id").withColumn("final", F.lit(False)), percent).select("a", "b")

        rest, _ = stored(_joined(links.where("not final").select("a", "b"), groups.join(large, "component").select("component", "id"), "component", "id", block, compare), "rest")
    # Rows that repeat an id with several texts are one document: it links the classes of its texts.
    several = named.groupBy("id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("two")).where("one <> two").select("id")
    if not several.isEmpty():
        of = named.join(several, "id").select("id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key")
        found = final if rest is None else final.unionAll(rest)
        comp = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(of.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    else:
        comp = final if rest is None else final.unionAll(rest)

    placed, _ = stored(classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "placed")
    discard(spark, groups_path, blocks_path, links_path)
    # Rows without a set meet nothing; keys of their own keep them apart.
    key = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("set_key")).otherwise(F.unhex(F.hex(F.monotonically_increasing_id())))
    out = prof.select("id", "n", key.alias("set_key")).join(placed, "set_key", "left")
    component = F.coalesce("component", "id")
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, the one of the smallest id, with all columns; rows with a null id stay."""
    name = fresh(docs, "gone")
    gone, _ = stored(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias(name)).distinct(), "gone")
    return docs.join(small_broadcast(gone), F.col(id_col) == F.col(name), "left_anti")
