"""The queries that SQL cannot express, by their names, on all rows of sf0.001 against plain versions."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from prismara.llm import piece_bpe, queries, suffix_tree_lm, toxicity
from prismara.llm.queries import piece_model
from test_corpus_operators import plain_tree, space
from test_text_operators import plain_labels, plain_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op2_equals_the_library(spark, texts):
    sp = piece_bpe.coder(piece_model()).sp
    got = queries.op2_sentencepiece(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_op3_equals_plain_searches(spark, texts):
    got = queries.op3_license_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(texts[r.doc_id])
        labels, score = plain_labels(texts[r.doc_id])
        assert r.labels == labels and r.score == pytest.approx(score)


def test_op4_is_the_sum_of_weights_and_of_all_pairs(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fitted(docs, labels)
    assert (m.vectors != 0).any()
    memory = toxicity._Places()
    for r in queries.op4_toxicity(spark, SF).collect():
        places, values = toxicity.features((texts[r.doc_id] or "").encode(), memory)
        v = m.vectors[places].astype(float)
        pairs = np.triu(v @ v.T, 1).sum()
        raw = m.bias + float(values.astype(float) @ m.weights[places].astype(float)) + pairs
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, raw)))), abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_op6_equals_a_plain_tree(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [t for i, t in texts.items() if not held[i]]
    symbols = sum(len(b" ".join(space(t))) + 1 for t in train)
    score, kept = plain_tree(train, suffix_tree_lm.DEPTH, (suffix_tree_lm.LEAST_COUNT - 0.5) / symbols)
    c = Counter(w for t in train for w in [*space(t), b" "])
    n, v = sum(c.values()), len(c)
    got = queries.op6_suffix_tree(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and len(kept) > 100
    for r in got:
        w = [*space(texts[r.doc_id]), b" "]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(score(texts[r.doc_id]), rel=1e-6)
