"""Periodic runs, SimHash groups and the audit of filters against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismara.llm import filter_audit, periodic_runs, queries, simhash_dedup

SF = "/root/testdata/sf0.001"


def table(spark, texts, ids=None, langs=None):
    """Documents with further columns whose names operators use."""
    ids = ids or range(len(texts))
    data = [(i, t, k, "s", None, 1, 2, "c", 0.5) for i, t, k in zip(ids, texts, langs or ["en"] * len(texts), strict=True)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id long, fp int, part string, start double")


# Periodic runs


def plain_runs(words, least=12):
    """Stretches on which words p apart agree, period by period; a multiple of a smaller period gives the same stretch."""
    seen = {}
    w = np.unique(words, return_inverse=True)[1] if len(words) else np.zeros(0, int)
    for p in range(1, len(w) // 2 + 1):
        same = np.r_[False, w[p:] == w[:-p], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edge.reshape(-1, 2):
            if b - a + p >= max(least, 2 * p):
                seen.setdefault((int(a), int(b - a + p)), p)
    return sorted((a, n, p) for (a, n), p in seen.items())


def plain_row(words, found):
    drop = set()
    for a, n, p in found:
        drop.update(range(a + p, a + n))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in found).encode()
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(found), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest())


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    if h % 10 or not words:
        return words
    a = h // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + h // 10 % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_op11_on_all_rows_against_plain(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = planted(d.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (d.text or "").encode()))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == plain_row(words, plain_runs(words)), d.doc_id
    assert sum(r.n_runs > 0 for r in got.values()) >= 15


def test_runs_of_many_kinds(monkeypatch):
    r = random.Random(5)
    texts = [[], [0], [0] * 11, [0] * 12, [0] * 5000, [0, 1] * 6, [0, 1, 0] * 40 + [2] + [0, 1, 0] * 40, list(range(500)) * 2, list(range(500)) * 3 + [7]]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    texts.append(fib[-1])
    texts += [[r.randrange(k) for _ in range(r.randrange(300))] for k in (1, 2, 2, 2, 3, 3, 4, 9, 50) for _ in range(12)]
    arrays = [np.array(t, np.int64) for t in texts]
    want = [plain_runs(t) for t in texts]
    for points in (1 << 20, 50):  # also where a grid is looked at in parts
        monkeypatch.setattr(periodic_runs.grid, "__defaults__", (points,))
        got = periodic_runs.runs(arrays)
        assert [[tuple(x) for x in g.tolist()] for g in got] == want
    assert [[tuple(x) for x in periodic_runs.runs([a], 2)[0].tolist()] for a in arrays] == [plain_runs(t, 2) for t in texts]


def test_extensions_are_the_longest():
    r = random.Random(2)
    s = np.array([r.randrange(2) for _ in range(120)] + [0] * 60)
    e = periodic_runs.Extensions(s)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        return n

    assert e.common(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_odd_texts_have_defined_runs(spark):
    texts = [None, "", " \t\n", "a " * 30, "A a " * 20, "x" * 200_000, "é b\x0bc " * 50_000, "na " * 11, "na " * 12]
    docs = table(spark, texts, [None, 5, 5, 6, 6, 7, -3, 8, 9])
    got = periodic_runs.periodic_runs(docs, with_output=True).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[None, 0].n_runs == by[5, 0].n_runs == 0 and by[None, 0].start is None
    assert (by[6, 30].start, by[6, 30].length, by[6, 30].period, by[6, 30].exponent_milli, by[6, 30].collapsed) == (0, 30, 1, 30_000, "a")
    assert by[6, 40].collapsed == "A a" and by[6, 40].period == 2
    assert by[-3, 150_000].collapsed == "é b c" and by[-3, 150_000].runs[0].length == 150_000
    assert by[8, 11].n_runs == 0 and by[9, 12].n_runs == 1
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert queries.planted_period(None, [b"a"]) == [b"a"]


# SimHash


def plain_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64(s, seed=42).intdigest() >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_op12_on_all_rows_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    ids = sorted(fp)
    want = plain_components([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    got = queries.op12_simhash(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id, r.kept) for r in got) == [(i, f"{fp[i]:016x}", want[i], want[i] == i) for i in ids]
    assert len(set(want.values())) < len(ids)


@pytest.mark.parametrize(("block", "distance"), [(1024, 3), (16, 3), (16, 1), (64, 2), (1024, 6)])
def test_links_join_what_all_pairs_join(spark, block, distance):
    """Dense groups, so that variants are hot and dealt into blocks."""
    r = random.Random(block + distance)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            fps.add(x)
    half = r.getrandbits(32) << 32  # many that agree in one half and hardly in the other
    fps |= {half | r.getrandbits(32) for _ in range(150)} | {half | 1 << b for b in range(32)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    got = [(x.a, x.b) for x in simhash_dedup.links(classes, distance, block).collect()]
    pairs = {(b, a) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance}
    assert plain_components(got, range(len(fps))) == plain_components(pairs, range(len(fps)))


def test_simhash_of_odd_tables(spark):
    same = "one two three four five six"
    docs = table(spark, [None, "", "  ", same, same.upper(), "other words here", same, "lone", "x " * 60_000, "other words here"], [7, 4, 9, 20, 11, 11, None, 30, 31, 3])
    got = {(r.doc_id, r.fingerprint): r for r in simhash_dedup.near_duplicates(docs).collect()}
    zero, f, g = "0" * 16, f"{plain_fingerprint(same):016x}", f"{plain_fingerprint('other words here'):016x}"
    assert {got[i, zero].component_id for i in (4, 7, 9)} == {4}
    assert {got[k].component_id for k in ((20, f), (11, f), (11, g), (3, g))} == {3}  # document 11 has two texts
    assert got[None, f].component_id is None and got[None, f].kept
    assert got[30, f"{plain_fingerprint('lone'):016x}"].kept
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    left = simhash_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 3), (False, 4), (False, 30), (False, 31), (True, 0)]


def test_segments_and_their_variants():
    for distance in (1, 2, 3, 5, 8):
        kinds = simhash_dedup.variants(distance)
        assert len(kinds) == 64 and sum(first for *_, first in kinds) == (distance + 2) // 2
    for bad in (0, 40):
        with pytest.raises(ValueError, match="distance"):
            simhash_dedup.variants(bad)


# Audit of filters


def plain_audit(rows, labels):
    """``rows``: id, text, part; ``labels``: id to (good, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(lambda: [0] * 7)
    orders = ["".join(o) for o in permutations("ABCDE")]
    taken = Counter()
    for i, t, part in rows:
        t, part = t or "", part or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        good, toxic = labels.get(i, (0, 0))
        for o in orders:
            gone = False
            for k, f in enumerate(o, 1):
                row = out[part, o, k]
                if bad[f] and not gone:
                    row[1] += 1
                    row[4] += good
                    row[5] += toxic
                    taken[part, f] += 1
                row[2] += bad[f] and gone
                row[3] += bad[f] and sum(bad.values()) == 1
                gone |= bad[f]
                row[0] += not gone
    for (part, o, k), row in out.items():
        row[6] = taken[part, o[k - 1]]
    return sorted((*k, *map(int, v)) for k, v in out.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_op13_on_all_rows_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert told(queries.op13_filter_audit(spark, SF)) == plain_audit([(d.doc_id, d.text, d.lang) for d in docs], labels)


def test_audit_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    copy = "Same words here " * 80
    texts = [None, "", copy, copy, copy, copy, "a#", "É" * 500, "word " * 100_000, *("copy me" for _ in range(40))]
    ids = [1, 0, 5, 5, 9, None, 2, 3, 4, *range(100, 140)]
    langs = [None, "", "en", "de", "en", "en", "fr", "fr", "fr", *("x" for _ in range(40))]
    labels = spark.createDataFrame([(5, 1, 0, "x"), (5, 0, 1, "y"), (None, 1, 1, "z"), (9, None, 1, "z"), (120, 1, None, "z")], "doc_id long, quality int, toxic int, part string")
    docs = table(spark, texts, ids, langs)
    want = plain_audit(list(zip(ids, texts, langs, strict=True)), {5: (1, 1), 9: (0, 1), 120: (1, 0)})
    assert told(filter_audit.audit(docs, labels)) == want
    assert told(filter_audit.audit(docs, labels.limit(0))) == plain_audit(list(zip(ids, texts, langs, strict=True)), {})
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    for hot in (0.0, 2.0):  # all copies broadcast, and none
        rows = filter_audit.with_copies(filter_audit.judged(docs, "doc_id", "text", "lang"), hot)
        assert rows.where(F.col("failed") >= 16).count() == 1 + 1 + 39


def test_first_failures_of_all_sets_and_orders():
    assert filter_audit.FIRST.shape == (32, 120)
    for s in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            failed = [s >> "ABCDE".index(f) & 1 for f in order]
            assert filter_audit.FIRST[s, o] == (failed.index(1) if any(failed) else 5)


def test_audit_equals_its_sql_without_null_parts(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.OP13_SQL)
    at = [want.columns.index(c) for c in COLUMNS]
    assert sorted(tuple(r[i] for i in at) for r in want.fetchall()) == told(queries.op13_filter_audit(spark, SF))
