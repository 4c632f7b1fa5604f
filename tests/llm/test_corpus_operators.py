"""URL rules, suffix trees, decontamination, near-duplicates, search, archives and the pipeline against plain versions."""

import gzip
import hashlib
import math
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.llm import decontaminate, minhash_dedup, queries, suffix_tree_lm, toxicity, url_rules, va_topk, warc
from prismara.llm.shared import stored

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def rows(df):
    return sorted(map(str, ([x if not isinstance(x, float) else round(x, 6) for x in r] for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == sorted(str([r[i] for i in at]) for r in want.fetchall())


# URL rules


def plain_verdict(url):
    host, path = url_rules.host_and_path(url)
    if not host and not path:
        return host, path, None, "allow"
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    fits = [r for r in url_rules.PATTERN_RULES if re.fullmatch(r.pattern, host + path)]
    return host, path, None, max(fits, key=lambda r: len(r.name)).verdict if fits else "allow"


def test_url_rules_against_all_rules(spark):
    r = random.Random(1)
    hosts = ["net", "a.net", "xnet", "example.net", "m.Example.NET", "badexample.net", "example.com", "x.example.com", "org", "q.org", "spam-farm.example.org", "ads.example.org", "casino.example.org", "é.org", ""]
    paths = ["", "/", "/en", "/en/", "/EN/", "/de/x", "/de", "/fr/a?b=/de/", "/fr#x", "/track/1", "/login.html", "/tag/x/page/2", "/a\nb", "?q", "#f"]
    urls = [None, "", "no scheme", "://", "http:///en/", *(f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(1500))]
    pages = spark.createDataFrame([(i % 900 or None, u, None, "clash", "rule") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    got = url_rules.judged(pages).collect()
    assert sorted(str((x.host, x.path, x.rule, x.verdict)) for x in got) == sorted(map(str, map(plain_verdict, urls)))
    assert sum(x.n_run for x in got) < len(urls) * len(url_rules.HOST_RULES + url_rules.PATTERN_RULES) / 2
    assert url_rules.judged(pages.limit(0)).count() == 0


def test_rules_are_filed_under_the_rarest_token():
    index = url_rules.RuleIndex(url_rules.HOST_RULES, {"example": 100, "net": 50, "en": 2, "com": 70, "de": 1, "org": 9, "fr": 9})
    assert {t: [r.name for r, _ in rules] for t, rules in index.filed.items()} == {"net": ["net/"], "en": ["example.net/en/"], "de": ["example.com/de/"], "fr": ["org/fr/"]}


# Documents


def documents(spark, texts, ids=None):
    data = [(i, t, None, "s", None, 1, 2.0, "c", True) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, component_id string, kept boolean")


def space(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()


def plain_tree(texts, depth, share):
    """States and smoothed distributions by dictionaries alone."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    streams = []
    for t in texts:
        s = bytes([suffix_tree_lm.BEFORE]) * depth + b" ".join(space(t)) + bytes([suffix_tree_lm.END])
        streams.append(s)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    total = sum(len(s) - depth for s in streams)
    kept = {b""}
    for k in range(1, depth + 1):
        for c, n in counts[k].items():
            m, parent = sum(n.values()), counts[k - 1][c[1:]]
            nats = sum(v * (math.log(v / m) - math.log(parent[x] / sum(parent.values()))) for x, v in n.items())
            if m >= share * total and nats >= suffix_tree_lm.LEAST_NATS * m and nats >= suffix_tree_lm.LEAST_TOTAL * total:
                kept |= {c[j:] for j in range(k + 1)}

    def p(c, x):
        n = counts[len(c)][c]
        if not c:
            return (n[x] + 1) / (sum(n.values()) + suffix_tree_lm.SYMBOLS)
        return (n[x] + len(n) * p(c[1:], x)) / (sum(n.values()) + len(n))

    def score(t):
        s = bytes([suffix_tree_lm.BEFORE]) * depth + b" ".join(space(t)) + bytes([suffix_tree_lm.END])
        out = 0.0
        for i in range(depth, len(s)):
            k = depth
            k = next(k for k in range(depth + 1) if k == depth or s[i - k - 1 : i] not in kept)
            out += math.log10(p(s[i - k : i], s[i]))
        return out

    return score, kept


@pytest.mark.parametrize("share", [1e-4, 0.01])
def test_suffix_tree_against_plain(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_tree_lm, "LEAST_SHARE", share)
    monkeypatch.setattr(suffix_tree_lm, "HEAD_SHARE", 0.02)  # so that many words take the join
    r = random.Random(3)
    words = ["the", "cat", "Cat", "sat", "sät", "on", "x" * 100, "mat.", "a"]
    texts = [None, "", " \n ", *(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(120)), "neverseen words", "cat " * 30_000]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    got = suffix_tree_lm.scores(documents(spark, texts, ids)).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    c = Counter(w for t in train for w in [*space(t), b" "])
    n, v = sum(c.values()), len(c)
    score, kept = plain_tree(train, suffix_tree_lm.DEPTH, share)
    assert len(kept) > 4
    key = lambda x: tuple(-1 if y is None else y for y in x)
    want = sorted(((i, h, len(w := [*space(t), b" "]), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), score(t)) for i, h, t in zip(ids, held, texts, strict=True)), key=key)
    have = sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got), key=key)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in have], [x[5:] for x in want], rtol=1e-6)


def test_suffix_tree_distributions_add_up():
    s = suffix_tree_lm.runs(suffix_tree_lm.symbols([space("the cat sat on the mat " * 50)]))
    codes, n = np.unique(s, return_counts=True)
    tree = suffix_tree_lm.Tree(np.array([0]), np.array([0]), np.zeros(len(np.unique(codes & 255)), int), np.unique(codes & 255), np.bincount(codes & 255, n)[np.unique(codes & 255)])
    _, logs = tree.tables()
    assert (10.0 ** logs).sum() == pytest.approx(1)


def test_suffix_tree_grows_with_the_corpus(spark):
    """A rare context of more than four symbols counts however many other symbols there are."""
    r = random.Random(9)
    noise = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)) for _ in range(8)]
    rare = ["zqgabcw", "zqgabcw", "xqgabcv", "xqgabcv"]
    training = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts, ids = rare + noise, training[: len(rare) + len(noise)]
    got = {x.doc_id: x.score for x in suffix_tree_lm.scores(documents(spark, [*texts, "zqgabcw", "zqgabcv"], ids + held)).collect()}
    score, kept = plain_tree(texts, suffix_tree_lm.DEPTH, 0)
    assert b"zqgabc" in {c[-6:] for c in kept}
    assert got[held[0]] > got[held[1]] + 0.3  # the sixth symbol before tells them apart
    some = [c for c in kept if len(c) > 4]
    assert len(some) > 1000


def test_suffix_tree_without_training(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = suffix_tree_lm.scores(documents(spark, ["ab"], [held])).first()
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0) and got.score == pytest.approx(-3 * math.log10(suffix_tree_lm.SYMBOLS))
    assert suffix_tree_lm.scores(documents(spark, [])).count() == 0


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(texts, items):
    windows = [(str("" if i is None else i), tuple(w[k : k + 13])) for i, t in items for w in [alnum(t)] if w for k in range(max(1, len(w) - 12))]
    out = []
    for t in texts:
        w, hit, found = alnum(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_contamination_against_plain(spark, limit):
    r = random.Random(8)
    vocabulary = ["a", "B", "é", "the", "x1"]
    items = [(1, None), (2, ""), (3, "the"), (10, "x1 the a"), (None, "b b b b"), (4, " ".join(r.choice(vocabulary) for _ in range(13))), (5, " ".join(r.choice(vocabulary) for _ in range(30))), (5, "É a a a")]
    long_item = items[6][1]
    texts = [None, "", "!", "THE", "a", *(" ".join(r.choice(vocabulary[:3]) for _ in range(r.randint(1, 60))) for _ in range(60)), "z " * 300 + long_item, "z " * 900 + long_item.upper().replace(" ", "-"), "a a a a a a" + " q" * 20_000]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, at string")
    docs = documents(spark, texts, [None if i % 9 == 0 else i % 50 for i in range(len(texts))])
    got = decontaminate.contamination(docs, bench, broadcast_bytes=limit)
    assert sorted((x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got.collect()) == plain_contamination(texts, items)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_contamination_runs_no_python(spark):
    docs, bench = documents(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas", plan)


def test_decontaminated_keeps_the_rest(spark):
    docs = documents(spark, ["clean text", "the secret answer", None, "the secret answer"], [1, 2, None, None])
    out = decontaminate.decontaminated(docs, spark.createDataFrame([(1, "secret answer")], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(map(str, [r.doc_id for r in out.collect()])) == ["1", "None", "None"]


def plain_groups(texts, ids, n, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = space(t)
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, all_ in sets.items() if i is not None for s in all_ if s]
    for x, (i, s) in enumerate(flat):
        for j, t in flat[:x]:
            if 100 * len(s & t) >= percent * len(s | t):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else root(i)) for i, all_ in sets.items() for s in all_]


def near_copies(seed=1):
    """Groups of exact and near copies at many distances, some of them large, and odd texts."""
    r = random.Random(seed)
    texts = [None, "", " \n", "one", "one", "ONE", "two words", "x y z", "word " * 30_000]
    for size in (2, 3, 8, 90):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(80, 200))]
        for _ in range(size):
            copy = base[:]
            for _ in range(r.randint(0, 9)):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 9999)}"
            texts.append(" ".join(copy))
        texts += [texts[-1]] * 3
    return texts


@pytest.mark.parametrize("block", [512, 16, 3])
def test_near_duplicates_against_plain(spark, block):
    texts = near_copies()
    ids = [None, 7, 8, *range(1000, 1000 - len(texts) + 3, -1)]
    ids[20] = ids[21]  # one document with two texts
    texts += ["k l m n o p", "k l m n o p", "q r s t u v w", "q r s t u v w"]  # 5 has a copy of 3 and one of 9
    ids += [3, 5, 5, 9]
    got = minhash_dedup.near_duplicates(documents(spark, texts, ids), block=block).collect()
    assert sorted(map(str, [(x.doc_id, x.n_shingles, x.component_id) for x in got])) == sorted(map(str, plain_groups(texts, ids, 4, 80)))
    assert all(x.kept == (x.doc_id is None or x.doc_id == x.component_id) for x in got)


def test_documents_of_one_template_stay_apart(spark, monkeypatch):
    """They share a passage, not enough to be linked; groups of candidates must not grow with their number."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    texts = [" ".join([f"o{r.randint(0, 10**6)}" for _ in range(84)] + passage) for _ in range(1500)]
    sizes = []
    real = minhash_dedup.components
    monkeypatch.setattr(minhash_dedup, "components", lambda links: sizes.append(links.count()) or real(links))
    got = minhash_dedup.near_duplicates(documents(spark, texts)).collect()
    assert all(x.kept for x in got) and len(got) == 1500
    assert sizes[0] < 150  # likely links, among a million pairs


def one_word_apart(n, seed=9):
    """Texts of which each two share at least 89 of 105 shingles of four words."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    return [" ".join(base[:at] + [f"e{i}"] + base[at + 1 :]) for i in range(n) for at in [r.randrange(100)]]


@pytest.mark.parametrize("n", [2000, 8000])
def test_a_group_of_near_copies_costs_what_it_has_members(spark, monkeypatch, n):
    rows = {"bucket": 0, "component": 0, "across": 0}
    within, across = minhash_dedup.within, minhash_dedup.across

    def counted_within(members, group, *rest):
        out = within(members, group, *rest)
        rows[group] += out.count()
        return out

    def counted_across(*args):
        out = across(*args)
        rows["across"] += out.count()
        return out

    monkeypatch.setattr(minhash_dedup, "within", counted_within)
    monkeypatch.setattr(minhash_dedup, "across", counted_across)
    got = minhash_dedup.near_duplicates(documents(spark, one_word_apart(n)), block=64)
    assert got.select("component_id").distinct().count() == 1 and got.count() == n
    assert rows["component"] == 2 * n  # copies of full sets
    assert rows["bucket"] <= minhash_dedup.BANDS * n and rows["across"] <= n


def test_the_second_round_finds_what_blocks_do_not_join(spark):
    """Groups dealt into blocks of one or two members, so that the first round sees next to no pair."""
    texts = one_word_apart(60) + [t.replace("w", "v") for t in one_word_apart(25, 3)] + [f"alone {i} " * 20 for i in range(5)]
    ids = list(range(500, 500 + len(texts)))
    want = sorted(plain_groups(texts, ids, 4, 80))
    for block in (1, 2):
        got = minhash_dedup.near_duplicates(documents(spark, texts, ids), block=block).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == want


def test_pairs_of_blocks_meet_once(spark):
    """Every pair with a member outside the largest component is in one task, and no pair within it."""
    known = spark.createDataFrame([(1, i, 0 if i < 30 else 100 + i % 3) for i in range(42)] + [(2, i, 5) for i in range(9)], "g long, i long, known long")
    rest = minhash_dedup.unjoined(known, "g", 4)
    assert [tuple(r) for r in rest.collect()] == [(1, 0, 3, 8)]
    tasks = {}
    for r in minhash_dedup.across(known, rest, "g", "i").collect():
        tasks.setdefault((r.one, r.two), []).append((r.i, r.block))
    met = {}
    for (one, two), members in tasks.items():
        for x, (i, p) in enumerate(members):
            for j, q in members[:x]:
                if one == two or p != q:
                    met[min(i, j), max(i, j)] = met.get((min(i, j), max(i, j)), 0) + 1
    assert met == {(i, j): 1 for j in range(30, 42) for i in range(j)}


def test_links_at_the_edge_are_found(spark):
    """Pairs of a similarity just over 0.8."""
    r = random.Random(6)
    texts, ids = [], []
    for i in range(400):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(453)]  # 450 shingles, 50 of which differ: 400 / 500
        texts += [" ".join(base), " ".join(base[:403] + [f"n{r.randint(0, 10**6)}" for _ in range(50)])]
        ids += [2 * i, 2 * i + 1]
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(documents(spark, texts, ids)).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(400)) / 400
    assert found >= 0.99 and all(got[2 * i] == 2 * i for i in range(400))


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert [tuple(r) for r in minhash_dedup.near_duplicates(documents(spark, [None, ""], [4, 5])).orderBy("doc_id").collect()] == [(4, 0, 4, True), (5, 0, 5, True)]


def test_deduplicated_keeps_one_of_each(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "other text here now ok", None], [5, 3, 9, None]).withColumn("gone", F.lit(1))
    out = minhash_dedup.deduplicated(docs, shingle=5)
    assert out.columns == docs.columns and sorted(map(str, [r.doc_id for r in out.collect()])) == ["3", "9", "None"]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    want = {i: root(i) for a, b in links if a != b for i in (a, b)}
    got = minhash_dedup.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted((x.id, x.component) for x in got.collect()) == sorted(want.items())
    assert minhash_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x << np.uint64(7))
    same = (minhash_dedup.signature(np.unique(mix(a)), 1000) == minhash_dedup.signature(np.unique(mix(b)), 1000)).mean()
    assert abs(same - 800 / 1200) < 0.06


# Search


def plain_top(data, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for n, (j, v) in enumerate(ok) if n != at and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("spread", "chunk", "block"), [(0.2, 65_536, 4096), (1e-3, 64, 3), (1e6, 65_536, 4096), (5e5, 100, 7)])
def test_top_k_against_all(spark, spread, chunk, block):
    rng = np.random.default_rng(5)
    data = [(int(i), (rng.normal(0, spread, 8)).astype(np.float32).tolist()) for i in range(400)]
    data += [(i + 1000, data[i][1]) for i in range(120)]  # ties
    data += [(50, data[50][1]), (77, data[77][1]), (2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, data[3][1]), (2200, [1.0, 2.0]), (2250, [1.0, -2.0]), (2251, [])]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in data], "vec_id long, embedding array<float>, label int, score string")
    got = va_topk.top_k(df, F.col("vec_id") % 50 == 0, chunk=chunk, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(data, 5)
    assert va_topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_cells_hold_their_components():
    x = np.floor(np.random.default_rng(1).normal(0, 40, (500, 6)))
    x[:, 5] = 3
    codes, edges = va_topk.approximate(x)
    at = np.arange(6)
    assert (edges[codes, at] <= x).all() and (x <= edges[codes.astype(int) + 1, at]).all()
    least, most = va_topk.bounds(codes, edges, x[:50])
    score = x[:50] @ x.T
    assert (least <= score).all() and (score <= most).all()


# Archives


def archive():
    payloads = [b"", b"x" * 10, b"WARC/1.0\r\nnot a record", b"<html>" + bytes(range(256)) * 8]
    return [(p, warc.member(warc.record_bytes("response", f"urn:page:{i}", b"HTTP/1.1 200 OK\r\n\r\n" + p, [("Content-Type", "application/http")]))) for i, p in enumerate(payloads)]


def read(data):
    found = list(warc.salvage(data))
    return [x.payload for x in found if isinstance(x, warc.Record)], [(x.offset, x.length) for x in found if isinstance(x, warc.Gap)]


def test_whole_archives():
    parts = archive()
    assert read(b"".join(m for _, m in parts)) == ([p for p, _ in parts], [])
    assert read(b"".join(gzip.decompress(m) for _, m in parts)) == ([p for p, _ in parts], [])
    assert read(gzip.compress(b"".join(gzip.decompress(m) for _, m in parts)) + b"\0\0") == ([p for p, _ in parts], [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("plain", [False, True])
def test_damage_is_quarantined(plain):
    parts = [(p, gzip.decompress(m) if plain else m) for p, m in archive()]
    edges = np.cumsum([0, *(len(m) for _, m in parts)])
    whole = b"".join(m for _, m in parts)
    r = random.Random(6)
    for _ in range(150):
        i = r.randrange(len(parts))
        at = r.randrange(edges[i], edges[i + 1])
        hurt = bytearray(whole)
        kind = r.choice(["flip", "cut", "noise"])
        if kind == "flip":
            hurt[at] ^= 1 << r.randrange(8)
        elif kind == "cut":
            del hurt[at : at + r.randint(1, 9)]
        else:
            hurt[at:at] = b"noise \x1f\x8b\x08 WARC/1.0\r\n"
        payloads, gaps = read(bytes(hurt))
        touched = {i} | ({i + 1} if kind == "cut" and at + 9 >= edges[i + 1] else set())
        untouched = [p for j, (p, _) in enumerate(parts) if j not in touched]
        assert [p for p in payloads if p in untouched] == untouched  # later records are found again
        # Nothing guards a plain record's header: with its content type hurt, the HTTP header counts as payload.
        assert all(any(p == q or plain and p.endswith(b"\r\n\r\n" + q) for q, _ in parts) for p in payloads)
        assert sum(n for _, n in gaps) <= len(hurt) and all(a + n <= b for (a, n), (b, _) in zip(gaps, gaps[1:], strict=False))


def test_members_of_many_records_are_salvaged():
    parts = [(p, gzip.decompress(m)) for p, m in archive()]
    payloads, plain = [p for p, _ in parts], [m for _, m in parts]
    hurt = [plain[0], plain[1].replace(b"xxx", b"xyx", 1), *plain[2:]]
    one = gzip.compress(b"".join(hurt))
    assert read(one) == ([payloads[0], *payloads[2:]], [(0, len(one))])
    noise = gzip.compress(b"".join(plain[:2]) + b"noise" + b"".join(plain[2:]))
    assert read(noise + parts[0][1]) == ([*payloads, payloads[0]], [(0, len(noise))])
    whole = gzip.compress(b"".join(plain))
    bad = whole[:-8] + bytes(x ^ 255 for x in whole[-8:-4]) + whole[-4:]  # another checksum
    assert read(bad + whole) == (payloads * 2, [(0, len(bad))])
    long = gzip.compress(b"".join(plain) + warc.record_bytes("resource", "urn:x", random.Random(1).randbytes(5000), []))
    assert read(long[:-4000]) == (payloads, [(0, len(long) - 4000)])


@pytest.mark.parametrize("mark", [b"\x1f\x8b\x08\0\0\0\0\0\0\0", b"WARC/1.0\r\nno: end ", b"WARC/1.0\r\nbad line\r\n", b"\x1f\x8b\x08"])
def test_false_marks_take_linear_time(mark):
    def seconds(n):
        data = mark * (n // len(mark)) + warc.member(warc.record_bytes("resource", "urn:x:1", b"kept", []))
        began = time.process_time()
        got = list(warc.salvage(data))
        assert [r.payload for r in got if isinstance(r, warc.Record)] == [b"kept"]
        return time.process_time() - began

    seconds(10_000)
    assert seconds(800_000) < 24 * max(seconds(50_000), 0.02)


def test_revisits_are_resolved(spark):
    rows = [("response", "a", None, "d1", 5), ("revisit", "b", "a", "said", 99), ("revisit", "c", "lost", "said", 99), ("revisit", "e", None, "said", 99), ("response", None, None, "d2", 7)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long")
    got = {r.record_id: (r.payload_digest, r.payload_bytes, r.dangling) for r in warc.resolved(df).collect()}
    assert got == {"a": ("d1", 5, False), "b": ("d1", 5, False), "c": (None, None, True), "e": (None, None, True), None: ("d2", 7, False)}


def test_zeroed_members_are_logged():
    (p, a), (q, b), (_, c), _ = archive()
    assert read(a + bytes(len(c)) + b) == ([p, q], [(len(a), len(c))])
    assert read(a + bytes(len(c))) == ([p], [(len(a), len(c))])
    assert read(a + bytes(19) + b + b"\0\0") == ([p, q], [])


def test_round_trip_of_odd_pages(spark):
    big = "é" * 700
    data = [(1, "http://a b/\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "z" * 300_000), (None, "u", "y" * 2000)]
    pages = spark.createDataFrame([(i, u, h, "clash", 5) for i, u, h in data], "page_id long, url string, html string, record_type string, id int")
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        largest = max((j for j, _, x in data if x == h and j is not None), default=None)
        revisit = len(b) >= 1000 and largest is not None and i != largest
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    got = warc.round_trip(pages).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files_and_gaps_by_spark(spark, tmp_path):
    (tmp_path / "w").mkdir()
    parts = archive()
    (tmp_path / "w/a.warc.gz").write_bytes(parts[0][1] + b"garbage" + parts[1][1])
    (tmp_path / "w/b.warc").write_bytes(b"")
    got = warc.salvaged(warc.read_archives(spark, str(tmp_path / "w"))).orderBy("offset").collect()
    assert [(x.gap is None, x.length, x.payload) for x in got] == [(True, len(parts[0][1]), b""), (False, 7, None), (True, len(parts[1][1]), b"x" * 10)]


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    machine = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out, _ = stored(stage(spark, docs, sf), "stage")
        if name == "sentencepiece":
            assert out.count() == len(before) and "ids_sha256" in out.columns
            continue
        after = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            memory = toxicity._Places()
            want = {i for i, t in before.items() if machine.score(*toxicity.features(t.encode(), memory)) < toxicity.THRESHOLD}
        elif name == "near_dedup":
            want = {c for _, _, c in plain_groups(list(before.values()), list(before), 5, 80)}
        else:
            want = {i for i, t in before.items() if not plain_contamination([t], items)[0][-1]}
        assert after == want and out.columns == docs.columns
        docs = out
    assert rows(corpus_pipeline.run(spark, sf)) == rows(out)


def test_pipeline_takes_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (documents(spark, []), documents(spark, [None, "", "a", "a", "b c"], [None, 1, 2, 2, 3])):
        for _, stage in corpus_pipeline.STAGES:
            docs, _ = stored(stage(spark, docs, sf), "stage")
        docs.collect()


def test_long_vectors_keep_their_scores(spark):
    """Sums of 200 products that fit 64 bits or do not, against whole numbers without bounds; null ids come last in ties."""
    most = float(2**20 - 1)
    rows = [(0, [most] * 200), (1, [most] * 200), (2, [1.0] * 200), (None, [most] * 200), (50, [-(2.0**26)] * 200), (3, [2.0**33] * 200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in va_topk.top_k(v, F.col("vec_id") % 50 == 0).collect()}
    whole = [(i, [int(256 * x) for x in e]) for i, e in rows]
    for at, (query, q) in enumerate(whole):
        if query in (0, 50):
            scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), i) for k, (i, x) in enumerate(whole) if k != at]
            want = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:5]
            assert [got[query, k] for k in range(1, 6)] == [(i, s) for s, i in want]


def test_responses_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_SHARED", 0)
    data = [("response", f"urn:page:{i}", None, f"d{i}", i) for i in range(4000)] + [("revisit", f"urn:page:{9000 + i}", f"urn:page:{i % 7}" if i % 5 else "urn:page:gone", None, None) for i in range(40)] + [("revisit", "urn:page:x", None, None, None)]
    found = spark.createDataFrame(data, "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long").repartition(8)
    out = warc.resolved(found)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(data) and max(sizes) <= 2 * sum(sizes) / 8
    by = {r.record_id: r for r in out.collect()}
    assert by["urn:page:12"].payload_bytes == 12 and not by["urn:page:12"].dangling
    assert by["urn:page:9001"].payload_digest == "d1" and by["urn:page:9000"].dangling and by["urn:page:x"].dangling
