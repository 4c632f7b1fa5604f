"""Exact top-k search over vector-approximation files.

The file is a table of its own, written once: for each chunk of vectors the
cell of every component, one byte each, and the ends of the range that the cells divide.
Queries in blocks scan the cells alone; a cell bounds the score of what lies
in it from above and below. Of each query those candidates are kept whose
upper bound reaches the kth best lower bound, first among the chunks scanned
together, then among all. Exact vectors are read for these only, the best
bounds first: those of the k best lower bounds say how good the kth is at
least, and then only what can still reach that is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismara.llm.shared import discard, stored

#: Cells of a dimension, rows of a chunk at most, queries of a block, bounds looked at together, and chunks of a task.
CELLS, CHUNK, BLOCK, TOGETHER, SHARE = 256, 10_000, 4_096, 2_000_000, 64
_LEAST, _MOST = -(2**63), 2**63 - 1
#: Sums of products that stay below this fit 64 bits, whatever rounding does to the bound itself.
_FITS = 2.0**62


def whole(flat: np.ndarray, scale: float, dims: int) -> np.ndarray:
    return np.floor(np.asarray(flat, float) * scale).reshape(-1, dims)


def edges_of(low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The edges of the cells of a chunk: cell c of a dimension holds what is edges[c] up to edges[c + 1]."""
    edges = low + (high - low) * (np.arange(cells + 1) / cells)[:, None]
    edges[-1] = high
    return edges


def approximate(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every component of whole-number vectors, and the edges of the cells."""
    edges = edges_of(x.min(0), x.max(0), cells)
    codes = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        codes[:, d] = np.clip(np.searchsorted(edges[:, d], x[:, d], side="right") - 1, 0, cells - 1)
    return codes, edges


def bounds(codes: np.ndarray, edges: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
    """The least and the largest score of each query with each vector of a chunk, whatever rounding does."""
    places = np.arange(codes.shape[1])
    low, high = edges[codes, places], edges[codes + np.int64(1), places]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-13 * codes.shape[1] * (np.abs(q) @ np.abs(edges).max(0))[:, None]
    # Scores end at 64 bits, so bounds do: what lies beyond is equal.
    return (np.clip(x, float(_LEAST), float(_MOST)) for x in (up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack))


def survivors(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], query_uids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of queries and chunks (uids, codes, edges): place of the query, uid, least and largest score of what can be among the k best; never the query's own row."""
    floor = np.full((len(q), k), -np.inf)
    step = max(1, TOGETHER // max(1, max(len(c[0]) for c in chunks)))
    for last in (False, True):  # first the kth best lower bound, then what reaches it
        for uids, codes, edges in chunks:
            for a in range(0, len(q), step):
                least, most = bounds(codes, edges, q[a : a + step])
                own = query_uids[a : a + step, None] == uids[None, :]
                least[own] = most[own] = -np.inf
                if last:
                    i, j = np.nonzero((most >= floor[a : a + step, :1]) & (most > -np.inf))
                    yield i + a, uids[j], least[i, j], most[i, j]
                else:
                    best = np.concatenate([floor[a : a + step], least], 1)
                    floor[a : a + step] = np.sort(np.partition(best, -k, 1)[:, -k:], 1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The scores of pairs of whole-number vectors; those beyond 64 bits end at the largest or smallest long."""
    if not x.size or (x.shape[1] * np.abs(q).max() * np.abs(x).max() < _FITS and max(np.abs(q).max(), np.abs(x).max()) < _FITS):
        return (q.astype(np.int64) * x.astype(np.int64)).sum(1)
    return np.array([max(_LEAST, min(_MOST, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


def approximation_file(rows: DataFrame, scale: float, chunk: int) -> DataFrame:
    """``chunk``, ``dims``, ``uids``, ``codes``, ``ends``: the cells of vectors (``uid``, ``v``, ``dims``), packed by chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for d in np.unique(dims):
                mine = batch.filter(pa.array(dims == d))
                for a in range(0, mine.num_rows, chunk):
                    part = mine.slice(a, chunk)
                    uids = np.asarray(part.column(0)).astype(np.int64)
                    codes, edges = approximate(whole(part.column(1).flatten(), scale, int(d))) if d else (np.zeros((len(uids), 0), np.uint8), np.zeros((CELLS + 1, 0)))
                    yield pa.RecordBatch.from_arrays([pa.array(uids[:1]), pa.array([int(d)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (uids, codes, edges[[0, -1]]))], names=["chunk", "dims", "uids", "codes", "ends"])

    return rows.select("uid", "v", "dims").mapInArrow(work, "chunk long, dims int, uids binary, codes binary, ends binary")


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of the highest inner product with each query, after ``floor(scale * x)`` of every component.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Ties go to
    the smaller id; with fewer candidates all are returned.

    Vectors that are null or hold a null or a number that is not finite take
    no part. A row with a null id is a candidate like others, behind them in
    ties. Candidates are all rows but the query's own; rows that repeat an id count one by one, as candidates (also
    of each other) and as queries. Only vectors of one length meet. An empty
    table gives no rows. Scores beyond 64 bits end at the largest or smallest
    long. Columns of other names are read by ``is_query`` alone.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(sound).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows, _ = stored(rows, "vectors")
    cells, cells_path = stored(approximation_file(rows, scale, chunk), "cells")
    blocks = max(1, ceil(rows.where("is_query").count() / block))
    # Each block meets the chunks in so many tasks, none of which holds more than SHARE of them on average; chunks are copied for each block, blocks for each of these.
    chunks = max(1, cells.count())
    shares = min(chunks, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(chunks / SHARE)))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = cells.withColumn("share", F.pmod(F.xxhash64("chunk"), F.lit(shares)).cast("int")).select("*", each(blocks).alias("block"))
    right = rows.where("is_query").select("uid", "v", "dims", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), each(shares).alias("share"))
    names, types = ["query", "uid", "least", "most"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def meet(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if chunks.num_rows and asked.num_rows:
            d = chunks.column("dims")[0].as_py()
            held = []
            for uids, codes, ends in zip(*(chunks.column(c) for c in ("uids", "codes", "ends")), strict=True):
                uids = np.frombuffer(uids.as_buffer(), np.int64)
                held.append((uids, np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(uids), d), edges_of(*np.frombuffer(ends.as_buffer(), np.float64).reshape(2, d))))
            query_uids = np.asarray(asked.column("uid")).astype(np.int64)
            q = whole(asked.column("v").combine_chunks().flatten(), scale, d) if d else np.zeros((len(query_uids), 0))
            parts = [(query_uids[i], *rest) for i, *rest in survivors(held, query_uids, q, k)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    keys = ["dims", "share", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, uid long, least double, most double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("least"), "uid"))
    near, near_path = stored(near.withColumn("place", place), "near")
    kth = lambda best: F.coalesce(best, F.lit(-float("inf")))
    floor = near.groupBy("query").agg(kth(F.max(F.when(F.col("place") == k, F.col("least")))).alias("floor"))

    def scored(pairs: DataFrame) -> DataFrame:
        """``query``, ``uid``, ``query_id``, ``vec_id``, ``score`` of pairs, whose exact vectors are read here."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, dims = np.zeros(batch.num_rows, np.int64), np.asarray(batch.column(6))
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    q, x = (whole(batch.column(i).take(pa.array(at)).flatten(), scale, int(d)) if d else np.zeros((len(at), 0)) for i in (4, 5))
                    out[at] = exact(q, x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["query", "uid", "query_id", "vec_id", "score"])

        one = rows.select(F.col("uid").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"), "dims")
        other = rows.select("uid", F.col("id").alias("vec_id"), F.col("v").alias("x"))
        met = pairs.select("query", "uid").join(one, "query").join(other, "uid")
        return met.select("query", "uid", "query_id", "vec_id", "q", "x", "dims").mapInArrow(work, "query long, uid long, query_id long, vec_id long, score long")

    first, first_path = stored(scored(near.where(F.col("place") <= k)), "first")
    sure = first.groupBy("query").agg(kth(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double"))).alias("sure"))
    sure = sure.withColumn("sure", F.col("sure") - F.abs("sure") * 1e-12)  # a long may be less than its double
    rest = near.where(F.col("place") > k).join(floor.join(sure, "query"), "query").where("most >= floor and most >= sure")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid"))
    out, _ = stored(first.unionAll(scored(rest)).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    discard(spark, cells_path, near_path, first_path)
    return out
