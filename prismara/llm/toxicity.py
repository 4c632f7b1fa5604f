"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a text and the first five characters of longer words;
both are hashed to a fixed range. Beside a weight, each term has a short
vector, and the product of two terms' vectors is the weight of their meeting,
such as an insult and the mention of a group. Additive weights cannot tell
that from the two apart.

The machine is fitted in one task from a bounded sample of labelled rows:
first weights, of terms that tell something by themselves; then weights and
vectors together, of these and of terms that tell something where they meet
one of them, or each other, whether or not they tell anything alone. So rare
terms that share a partner get like vectors. Scoring is a pass over all documents with
the fitted model, whose size is fixed, broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.llm.text import alnum_words

#: At most so many labelled rows are fitted, those of the smallest hash of their id.
FIT_ROWS = 20_000
#: Terms are hashed to so many places.
PLACES = 1 << 18
FACTORS = 8
PREFIX = 5
#: Terms, and meetings of two, are fitted if the labels of their rows differ so much from what the terms fitted before
#: expect; it is the square of a normal deviate. What tells nothing is noise in every sum.
LEAST_DEVIANCE, ROUNDS = 10.0, 3
#: Meetings are counted in so many rows of each label, between terms in so many of them, the most frequent so many terms at most.
PAIR_ROWS, LEAST_MEETINGS, PAIR_TERMS = 2_000, 4, 4_096
#: Other terms are tested in the rows of so many fitted ones.
ANCHORS = 64
#: Vectors start small, and are drawn to zero so strongly, so that meetings which tell nothing weigh nothing.
SPREAD, SHRINK = 0.1, 2e-4
#: Places looked at together.
PART = 1 << 20
THRESHOLD = 0.3
#: Rows whose terms a worker holds and hands on at once.
HANDED = 512
#: The bound on words whose places a worker remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Machine:
    """``bias``, ``weights`` (PLACES) and ``vectors`` (PLACES x FACTORS); without them every score is 0."""

    bias: float = 0.0
    weights: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        raw = self.bias + float(values @ self.weights[places])
        v = self.vectors[places]
        raw += 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -40, 40))))


class _Places(dict):
    """The places of a word and its prefix, bounded."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "replace")
        out = (zlib.crc32(b"w" + word) % PLACES,)
        if len(text) > PREFIX:
            out += (zlib.crc32(b"p" + text[:PREFIX].encode()) % PLACES,)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


def features(text: bytes | None, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """The places of a whole text's terms, ascending, and the logarithm of one more than their counts."""
    words = alnum_words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, counts = np.unique(np.fromiter(chain.from_iterable(map(places.__getitem__, words)), np.int32), return_counts=True)
    return found, np.log2(counts + 1).astype(np.float32)


class Sample:
    """Labelled rows one behind the other: ``places`` and ``values`` of their terms, where each row begins (``edges``), and labels ``y``."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.places = np.concatenate([p for p, _ in rows]).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
        self.values = np.concatenate([v for _, v in rows]).astype(np.float32) if len(rows) else np.zeros(0, np.float32)
        self.edges = np.r_[0, np.cumsum([len(p) for p, _ in rows])].astype(np.int64)
        self.y = np.asarray(labels, float)

    @classmethod
    def packed(cls, places: list[np.ndarray], values: list[np.ndarray], lengths: np.ndarray, labels: np.ndarray) -> Sample:
        """From parts of many rows each, which are emptied, and the lengths of the rows."""
        sample = cls([], labels)
        sample.places = np.concatenate(places)
        places.clear()
        sample.values = np.concatenate(values)
        values.clear()
        sample.edges = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        return sample

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and the rows that they stand in, in parts of bounded size."""
        step = max(1, len(self.y) * PART // max(1, len(self.places)))
        for a in range(0, len(self.y), step):
            b = min(len(self.y), a + step)
            yield self.places[self.edges[a] : self.edges[b]], np.repeat(np.arange(a, b), np.diff(self.edges[a : b + 1]))

    def only(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the rows have of some places, by their numbers in ``places``: numbers, values, and where each row begins."""
        own = np.full(PLACES, -1, np.int32)
        own[places] = np.arange(len(places))
        numbers, values, lengths, at = [], [], [], 0
        for part, row in self.parts():  # in parts, so that nothing of the sample's size is made beside it
            mine = own[part]
            keep = np.flatnonzero(mine >= 0)
            numbers.append(mine[keep])
            values.append(self.values[at : at + len(part)][keep])
            lengths.append(np.bincount(row[keep], minlength=len(self.y)).astype(np.int64))
            at += len(part)
        return np.concatenate(numbers), np.concatenate(values), np.r_[0, np.cumsum(sum(lengths))]


def deviance(seen: np.ndarray, expected: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far the labels seen among ``n`` rows are from those expected, as a likelihood ratio; rare terms need no correction."""
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda o, e: np.where(o > 0, o * np.log(o / np.maximum(e, 1e-12)), 0.0)
        return 2 * (part(seen, expected) + part(n - seen, n - expected))


def telling(sample: Sample, p: np.ndarray) -> np.ndarray:
    """The places whose rows have other labels than the probabilities ``p`` expect."""
    seen, expected, n = np.zeros((3, PLACES))
    for places, row in sample.parts():
        seen += np.bincount(places, sample.y[row], PLACES)
        expected += np.bincount(places, p[row], PLACES)
        n += np.bincount(places, minlength=PLACES)
    return np.flatnonzero(deviance(seen, expected, n) >= LEAST_DEVIANCE)


def meeting(sample: Sample, p: np.ndarray, rows: int = PAIR_ROWS, seed: int = 7) -> np.ndarray:
    """The places of pairs whose meetings have other labels than ``p``, which knows the terms one by one, expects.

    All pairs are counted of the places that stand in LEAST_MEETINGS of the
    toxic or of the other rows looked at. Of each label ``rows`` rows at most
    are, each standing for as many as there are.
    """
    rng = np.random.default_rng(seed)
    chosen, weight = [], []
    for label in (sample.y > 0, sample.y <= 0):
        of = np.flatnonzero(label)
        take = np.sort(rng.permutation(of)[:rows])
        chosen.append(take)
        weight.append(np.full(len(take), len(of) / max(1, len(take))))
    at = np.concatenate(chosen)
    w, y = np.concatenate(weight), np.r_[np.ones(len(chosen[0])), np.zeros(len(chosen[1]))]
    lengths = sample.edges[at + 1] - sample.edges[at]
    row = np.repeat(np.arange(len(at)), lengths)
    places = np.concatenate([sample.places[sample.edges[r] : sample.edges[r + 1]] for r in at]) if len(at) else np.zeros(0, np.int32)
    most = np.maximum(np.bincount(places[y[row] > 0], minlength=PLACES), np.bincount(places[y[row] <= 0], minlength=PLACES))
    terms = np.flatnonzero(most >= max(LEAST_MEETINGS, np.sort(most)[-PAIR_TERMS]))
    if len(terms) < 2:
        return np.zeros(0, int)
    own = np.full(PLACES, -1, np.int32)
    own[terms] = np.arange(len(terms))
    keep = own[places] >= 0
    there = np.zeros((len(at), len(terms)), np.uint8)
    there[row[keep], own[places[keep]]] = 1
    least = LEAST_DEVIANCE + 2 * np.log(len(terms) ** 2 / 2)  # more pairs, more chance meetings
    found: set[int] = set()
    for b in range(0, len(terms), 512):  # block by block, so that only bytes are held of all terms
        right = there[:, b : b + 512].astype(np.float32)
        for a in range(0, len(terms), 256):
            left = there[:, a : a + 256].astype(np.float32)
            n, seen, expected = ((left * c.astype(np.float32)[:, None]).T @ right for c in (w, w * y, w * p[at]))
            far = deviance(seen.astype(float), expected.astype(float), n.astype(float)) >= least
            i, j = np.nonzero(far)
            i += a
            j += b
            found.update(*(x[i != j].tolist() for x in (i, j)))
    return terms[sorted(found)]


def partners(sample: Sample, p: np.ndarray, places: np.ndarray, anchors: int = ANCHORS) -> np.ndarray:
    """The places of terms that tell, among the rows of one of the fitted ``places``, what ``p`` does not expect there.

    A term is tested once for each of the most frequent fitted places, in all
    rows. So a term with few rows, which tells little alone and with any one
    of many partners, is found by those that it has with a frequent one.
    """
    if not len(places):
        return places
    number = np.full(PLACES, -1, np.int32)
    number[places] = np.arange(len(places))
    rows_of = np.zeros(len(places), np.int64)
    for part, _ in sample.parts():
        mine = number[part]
        rows_of += np.bincount(mine[mine >= 0], minlength=len(places))
    first = places[np.argsort(-rows_of, kind="stable")[:anchors]]
    least, found = LEAST_DEVIANCE + 2 * np.log(len(first)), []
    for anchor in first:
        seen, expected, n = np.zeros((3, PLACES))
        for part, row in sample.parts():
            with_ = np.zeros(len(sample.y), bool)
            with_[row[part == anchor]] = True
            keep = with_[row]
            some, of = part[keep], row[keep]
            seen += np.bincount(some, sample.y[of], PLACES)
            expected += np.bincount(some, p[of], PLACES)
            n += np.bincount(some, minlength=PLACES)
        far = deviance(seen, expected, n) >= least
        far[anchor] = False
        if far.any():
            found.append(np.r_[np.flatnonzero(far), anchor])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, int)


def descend(sample: Sample, places: np.ndarray, vectors: int, epochs: int, batch: int = 256, rate: float = 0.2, decay: float = 2e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic loss by adaptive gradient steps: bias and weights of ``places``, vectors of the last ``vectors`` of them, and the probability of each row."""
    at, x, edges = sample.only(places)
    y, n = sample.y, len(places)
    plain = n - vectors
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n + 1), rng.normal(0, SPREAD, (vectors, FACTORS))
    w[n] = np.log(y.mean() / (1 - y.mean()))
    gw, gv = np.full(n + 1, 1e-2), np.full((vectors, FACTORS), 1e-2)

    def raw_of(chosen: np.ndarray) -> tuple:
        parts = [np.arange(edges[r], edges[r + 1]) for r in chosen]
        take = np.concatenate(parts)
        group = np.repeat(np.arange(len(chosen)), [len(p) for p in parts])
        a, xs = at[take], x[take]
        raw = w[n] + np.bincount(group, w[a] * xs, len(chosen))
        with_ = a >= plain
        b, of = a[with_] - plain, group[with_]
        vb = v[b]
        sums = np.stack([np.bincount(of, vb[:, f], len(chosen)) for f in range(FACTORS)], 1)
        raw += 0.5 * ((sums**2).sum(1) - np.bincount(of, (vb**2).sum(1), len(chosen)))
        return a, xs, group, b, of, vb, sums, 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            chosen = order[start : start + batch]
            a, xs, group, b, of, vb, sums, p = raw_of(chosen)
            slope = (p - y[chosen]) / len(chosen)
            g = np.bincount(a, slope[group] * xs, n + 1) + 0.0
            g[n] = slope.sum()
            g[:n] += decay * w[:n]
            gw += g**2
            w -= rate * g / np.sqrt(gw)
            if vectors:
                dv = slope[of][:, None] * (sums[of] - vb)
                g = np.stack([np.bincount(b, dv[:, f], vectors) for f in range(FACTORS)], 1) + SHRINK * v
                gv += g**2
                v -= rate * g / np.sqrt(gv)
    p = np.concatenate([raw_of(np.arange(a, min(len(y), a + 1024)))[-1] for a in range(0, len(y), 1024)])
    return w, v, p


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30) -> Machine:
    """The machine of labelled rows, which may have no terms; see :func:`fit_sample`."""
    return fit_sample(Sample(rows, labels), epochs)


def fit_sample(sample: Sample, epochs: int = 30) -> Machine:
    """Weights of terms that tell something beside those already in, then vectors of these and of terms whose meetings tell something.

    Without rows, or with one label only, the machine scores 0.
    """
    if not len(sample.y) or sample.y.min() == sample.y.max():
        return Machine()
    places = np.zeros(0, int)
    w, _, p = descend(sample, places, 0, 1)
    for _ in range(ROUNDS):
        more = np.setdiff1d(telling(sample, p), places)
        if not len(more):
            break
        places = np.r_[places, more]
        w, _, p = descend(sample, places, 0, epochs)
    places = np.unique(np.r_[places, meeting(sample, p), partners(sample, p, places)])
    w, v, _ = descend(sample, places, len(places), 2 * epochs)
    weights, vectors = np.zeros(PLACES, np.float32), np.zeros((PLACES, FACTORS), np.float32)
    weights[places] = w[:-1]
    vectors[places] = v
    return Machine(float(w[-1]), weights, vectors)


def held_out(id_col: str | Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The terms of labelled rows that are not held out, ``fit_rows`` at most, in one partition: ``at``, ``y``, ``places``, ``values``.

    Rows of the labels whose id or label is null are not used; of an id with
    several labels the largest counts; of documents with one id all are used,
    but ``fit_rows`` rows in all.
    """
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Places()
        for batch in batches:
            for start in range(0, batch.num_rows, HANDED):
                part = batch.slice(start, HANDED)
                rows = [features(t.as_py(), memory) for t in part.column(2)]
                columns = [part.column(0), part.column(1), pa.array([p.tobytes() for p, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "y", "places", "values"])

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(sample), "_id")
    found = chosen.select(F.xxhash64("_id").alias("at"), F.col("y").cast("int"), "t").mapInArrow(work, "at long, y int, places binary, values binary")
    # An order of their own makes the machine the same each time, however rows are dealt; the limit leaves one partition.
    return found.orderBy("at", F.xxhash64("places"), F.xxhash64("values"), "y").limit(fit_rows)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Machine:
    """A machine learned from the rows that :func:`sampled` takes.

    One task fits them, as the sample is bounded; only the model, ``PLACES``
    places at most, comes to the driver.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, lengths, labels = [], [], [], []
        for batch in batches:  # copied, so that no batch outlives its turn
            labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32))
            lengths.append(np.fromiter((len(p.as_buffer()) // 4 for p in batch.column(2)), np.int64, len(batch)))
            places.append(np.frombuffer(b"".join(p.as_buffer() for p in batch.column(2)), np.int32))
            values.append(np.frombuffer(b"".join(v.as_buffer() for v in batch.column(3)), np.float32))
            del batch
        if labels:
            m = fit_sample(Sample.packed(places, values, np.concatenate(lengths), np.concatenate(labels)))
            if m.weights is not None:
                at = np.flatnonzero((m.weights != 0) | (m.vectors != 0).any(1))
                places, weights = np.r_[-1, at], np.r_[m.bias, m.weights[at].astype(float)]
                vectors = pa.array([b""] + [v.tobytes() for v in m.vectors[at]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(weights), vectors], names=["place", "weight", "vector"])

    sample = sampled(docs, labels, id_col, text_col, label_col, fit_rows)
    model = sample.mapInArrow(learn, "place int, weight double, vector binary").collect()
    if not model:
        return Machine()
    bias, weights, vectors = 0.0, np.zeros(PLACES, np.float32), np.zeros((PLACES, FACTORS), np.float32)
    for r in model:  # PLACES rows at most
        if r.place < 0:
            bias = r.weight
        else:
            weights[r.place], vectors[r.place] = r.weight, np.frombuffer(r.vector, np.float32)
    return Machine(bias, weights, vectors)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The toxicity of every whole text.

    Columns: ``id_col``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if
    the score reaches ``threshold``, else 0).

    One row for each input row, whatever its id; a null id is not held out. A
    null or empty text has no terms and gets the score of the bias alone.
    Only the id, which decides ``held_out``, and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, m = _Places(), shared.value
        for batch in batches:
            scores = [m.score(*features(t.as_py(), memory)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(work, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below ``threshold``, with all their columns, in one pass without a shuffle.

    Workers see the texts alone; other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory, m = _Places(), shared.value
        for batch in batches:
            yield pa.array([m.score(*features(t.as_py(), memory)) for t in batch], pa.float64())

    return docs.where(score(F.col(text_col).cast("binary")) < threshold)
