"""The queries ``opN_<name>``: each operator over its whole table, reduced to the columns of its contract."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The SentencePiece model of the queries; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to FROM m"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.piece_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), piece_model())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.toxicity import fitted, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, _table(spark, sf_dir, "labels")))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.url_rules import judged

    return judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    """The contract's four rules, the longest first, as plain conditions; behind them the method's patterns on every url, without the index."""
    from prismara.llm.url_rules import DEFAULT, PATTERN_RULES

    patterns = " ".join(f"WHEN regexp_full_match(host || path, '{r.pattern}') THEN '{r.verdict}'" for r in sorted(PATTERN_RULES, key=lambda r: (-len(r.name), r.name)))
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL OR host || path = '' THEN 'allow' {patterns} ELSE '{DEFAULT}' END AS verdict FROM r"""


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.suffix_tree_lm import scores

    return scores(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, w[i:i + 12] AS win, len(w[i:i + 12]) AS n FROM bw),
lengths AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths),
hits AS (SELECT doc_id, i, windows.n AS n, item FROM dw JOIN windows ON windows.n = dw.n AND windows.win = dw.w[dw.i:dw.i + dw.n - 1]),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0))),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON edges.u = reach.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.u = d.doc_id"""


#: What op9 replaces: runs of four digits or more, and mail addresses.
OP9_SPANS = r"[0-9]{4,}|[A-Za-z0-9._-]{1,64}@[A-Za-z0-9.-]{1,253}"


def op9_edits(text: str) -> list[dict]:
    """Each number and each mail address of a text is replaced."""
    return [{"start": m.start(), "stop": m.end(), "new": "<mail>" if "@" in m[0] else "0"} for m in re.finditer(OP9_SPANS, text)]


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after numbers and mail addresses are replaced, each by an edit."""
    import public_tokenizers

    from prismara.llm.edit_counts import recounted

    return recounted(_table(spark, sf_dir, "documents"), op9_edits, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from prismara.llm.va_topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.uid <> q.uid)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 5"""


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that ``op11`` looks at: those of a tenth of all ids repeat with a period from some place on; a null id's are left alone."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.periodic_runs import periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents"), change=planted_period)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.simhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismara.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS bad FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, bad, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bad),
x AS (SELECT i FROM range(1, 6) t(i)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step.i::INTEGER AS step, o[step.i] AS filter, bad[o[step.i]] AS fails,
  len(list_filter(o[1:step.i - 1], lambda i: bad[i])) > 0 AS earlier, len(list_filter(bad, lambda b: b)) = 1 AS alone, n, good, toxic FROM m, o, x step),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name) and name != "op9_edits" and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op10_va_topk": OP10_SQL, "op13_filter_audit": OP13_SQL, "op5_url_rules": _op5_sql(), "op7_decontaminate": OP7_SQL, "op8_near_dedup": OP8_SQL}
