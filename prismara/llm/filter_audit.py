"""Interaction of filters: what each removes, at each place of each order.

A document that fails the filters of a set is removed, in a given order, by
the first of them. So a table of all sets by all orders holds the step of the
first failure, and a task only has to look documents up and count: by part,
order, step and label. Partial counts are added up; everything that is reported
follows from them.

Only digests of texts are shuffled. Exact copies are found by the smallest id
of each digest, added up before it is shuffled; digests of many copies are
broadcast, so that none of them meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.shared import stored

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
#: Which filter (0 to 4) is at each step of each order.
AT = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
#: By set of failed filters (a bit each) and order: the step of the first failure from 0, or 5 for none.
FIRST = np.array([[next((k for k, f in enumerate(order) if s >> f & 1), len(FILTERS)) for order in AT] for s in range(1 << len(FILTERS))])

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_CAPITALS, _SIGNS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Digests of at least this share of all rows are broadcast; there are no more than its inverse.
HOT = 0.001
#: Parts that a task adds up at a time.
PARTS = 256
_KINDS, _STEPS = ("all", "good", "toxic"), len(FILTERS) + 1


def failures(text: bytes) -> int:
    """The filters that a text fails by itself, as bits: few words (A), few distinct words (B), many capitals (C), signs (D)."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (len(text.translate(None, _SIGNS)) < len(text)) << 3
    )


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id``, ``part``, ``failed`` (bits of the filters A to D), ``digest`` of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [], []
            for t in batch.column(2):
                text = t.as_py()
                failed.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "failed", "digest"])

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t")).mapInArrow(work, "id long, part string, failed int, digest binary")


def with_copies(rows: DataFrame, hot: float = HOT) -> DataFrame:
    """``judged`` rows with the bit of filter E: a row of a smaller id has the same text. A null id is neither smaller nor larger than others."""
    shared = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1")
    total = rows.count()
    shared, _ = stored(shared, "copies")
    common = F.broadcast(shared.where(F.col("k") >= hot * total).select("digest", F.col("least").alias("hot_least")))
    rare = shared.where((F.col("k") < hot * total) & (F.col("most") > F.col("least"))).select(F.col("digest").alias("rare"), F.col("least").alias("rare_least"))
    met = rows.join(common, "digest", "left")
    # A digest that was met needs no second look, nor does a row that cannot be a copy: their keys are their own.
    cold = met.where("hot_least is null").join(rare, F.col("digest") == F.col("rare"), "left").select("id", "part", "failed", F.col("rare_least").alias("least"))
    warm = met.where("hot_least is not null").select("id", "part", "failed", F.col("hot_least").alias("least"))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return cold.unionAll(warm).select("id", "part", F.col("failed").bitwiseOR(copy).alias("failed"))


def partial_counts(rows: DataFrame) -> DataFrame:
    """``part``, ``at``, ``n``: counts of ``part``, ``failed``, ``good``, ``toxic``, ``n``, by their place in an array.

    Of each part, the first places count sets of failed filters, those behind
    count by label, order and step of the first failure.
    """
    sets, cells = len(FIRST), len(ORDERS) * _STEPS

    def flush(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = sets + len(_KINDS) * cells
        part = pa.array([p for p in sums for _ in range(size)], pa.string())
        return pa.RecordBatch.from_arrays([part, pa.array(np.tile(np.arange(size, dtype=np.int32), len(sums))), pa.array(np.concatenate(list(sums.values())))], names=["part", "at", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            failed, good, toxic, n = (np.asarray(batch.column(c)) for c in range(1, 5))
            for c, name in enumerate(names):
                rows = np.flatnonzero(codes == c) if len(names) > 1 else slice(None)
                s, weight = failed[rows], n[rows]
                parts = [np.bincount(s, weight, sets)]
                cell = FIRST[s] + np.arange(len(ORDERS)) * _STEPS
                for label in (1, good[rows], toxic[rows]):
                    parts.append(np.bincount(cell.ravel(), np.repeat(weight * label, len(ORDERS)), cells))
                now = np.concatenate(parts).astype(np.int64)
                sums[name] = sums[name] + now if name in sums else now
                if len(sums) >= PARTS:
                    yield flush(sums)
                    sums = {}
        if sums:
            yield flush(sums)

    return rows.select("part", "failed", "good", "toxic", "n").mapInArrow(work, "part string, at int, n long")


def _reported(sums: DataFrame) -> DataFrame:
    sets, cells = len(FIRST), len(ORDERS) * _STEPS
    fields = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((k, pa.int64()) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]
    schema = pa.schema(fields)

    def work(table: pa.Table) -> pa.Table:
        n = np.zeros(sets + len(_KINDS) * cells, np.int64)
        n[np.asarray(table.column("at"))] = np.asarray(table.column("n"))
        everything, good, toxic = (n[sets + k * cells : sets + (k + 1) * cells].reshape(len(ORDERS), _STEPS)[:, :-1] for k in range(len(_KINDS)))
        fails = np.array([n[:sets][np.arange(sets) >> f & 1 == 1].sum() for f in range(len(FILTERS))])
        only = n[1 << np.arange(len(FILTERS))]
        share = np.bincount(AT.ravel(), everything.ravel(), len(FILTERS)).astype(np.int64)
        values = [n[:sets].sum() - np.cumsum(everything, 1), everything, fails[AT] - everything, only[AT], good, toxic, share[AT]]
        rows = len(ORDERS) * len(FILTERS)
        columns = [pa.array([table.column("part")[0].as_py()] * rows, pa.string()), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))]
        return pa.Table.from_arrays([*columns, *(pa.array(v.ravel()) for v in values)], schema=schema)

    # A group is the one array of a part.
    return sums.groupBy("part").applyInArrow(work, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What five filters remove in all orders, by part.

    A text fails A with fewer than 200 words (stretches without a space or one
    of U+0009 to U+000D), B if fewer than half of its words are distinct, C if
    over 3% of its characters are A to Z, D if one is in ``#$%&*|``, E if a row
    of a smaller id has the same text, removed or not.

    There is one row, zeros included, for each ``part`` (value of
    ``part_col``), ``filter_order`` (120) and ``step`` (1 to 5). Counts of rows
    in the part: ``kept`` after this step, ``removed`` by it, ``redundant``
    (failing its filter but removed earlier), ``unique_fails`` (failing its
    filter only), ``good_lost`` and ``toxic_lost`` (removed here, labelled
    quality = 1 or toxic = 1), ``shapley`` (removed by its filter, over all 120
    orders).

    Null texts are empty; null parts are the empty string. Rows that repeat an
    id count each, and are copies of a smaller id only; a row with a null id
    passes E, makes none fail it, and has no label. An id has a label if one of
    its rows in ``labels`` says so. An empty table gives no rows. Other columns
    are not read.
    """
    rows, _ = stored(judged(docs, id_col, text_col, part_col), "judged")
    # Rows of one id, or of none, are added up before they meet their labels.
    counted = with_copies(rows).groupBy("id", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    told = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.where("id is not null and (good or toxic)").groupBy("id").agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(c) for c in ("good", "toxic")))
    known = counted.join(told, "id", "left").select("part", "failed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")), "n")
    return _reported(partial_counts(known).groupBy("part", "at").agg(F.sum("n").alias("n")))
