"""One thin query for each operator: whole tables in, the digest of the operator's output back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_topk, language_id, mixing, near_dedup, quality, secrets, sentencepiece_fst, token_files, warc
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.checked(sentencepiece_fst.encode(table(spark, sf_dir, "documents"), keep=["doc_id", "text"]))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.save(table(spark, sf_dir, "documents"))
    return token_files.read_digest(manifest)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(warc.plan(table(spark, sf_dir, "pages")))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality.classify(docs, table(spark, sf_dir, "labels"), meta=[F.floor(4 * F.log2(F.col("n_chars") + 1))])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_source_mixing, op3_exact_topk, op4_language_id, op5_secret_scan, op6_embedding_near_dedup, op7_minhash_near_dedup, op8_token_files, op9_warc, op10_quality_classifier)}

_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_RULES = {
    "assign": rf"""({_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\t\r\n]+-----END [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d" for i, (k, p) in enumerate(_RULES.items()))



def _seeded(seed: int, *columns: str) -> str:
    """mixing._seeded() in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(f"coalesce({c}::VARCHAR, '')" for c in columns)}, '{seed}')), 1, 15))::BIGINT"


def _mix_sql() -> str:
    """mixing.mix() in SQL: here every quotient is ranked, up to as many as there are blocks."""
    m = mixing
    weights = f"[{', '.join(map(str, m.WEIGHTS))}]"
    order = "ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
        WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
        a AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM m GROUP BY source),
        b AS (SELECT *, {weights}[((sid - 1) % {len(m.WEIGHTS)} + 1)::INT]::DOUBLE AS weight, source_size * {m.CAP}::DOUBLE AS cap, greatest(ceil(docs / {float(m.SHARD_DOCS)}::DOUBLE), 1)::BIGINT AS shards FROM a),
        c AS (SELECT *, (sum(source_size) OVER () * {m.SHARE}::DOUBLE - coalesce(sum(cap) OVER ({order}), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER ({order}), 0)) AS level FROM b),
        t AS (SELECT *, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 'inf'::DOUBLE) * weight)::DOUBLE AS target FROM c),
        n AS (SELECT round(sum(target) / {m.BLOCK_WORDS})::BIGINT AS all_blocks FROM t),
        w AS (SELECT sid, row_number() OVER (ORDER BY target / (2 * x.a + 1) DESC, sid, x.a) AS place, all_blocks FROM t, n, unnest(range(all_blocks)) AS x(a) WHERE target > 0),
        per AS (SELECT t.*, count(w.sid) AS blocks FROM t LEFT JOIN w ON w.sid = t.sid AND place <= all_blocks GROUP BY ALL),
        keyed AS (SELECT m.*, sid, blocks, source_size, target, {_seeded(m.SEED + 1, 'doc_id', 'tie')} % shards AS shard, {_seeded(m.SEED, 'doc_id', 'tie')} AS h FROM m JOIN per ON m.source IS NOT DISTINCT FROM per.source),
        s AS (SELECT sid, shard, blocks, sum(size)::BIGINT AS words FROM keyed GROUP BY ALL),
        v AS (SELECT sid, shard, blocks, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * x.a + 1) DESC, shard, x.a) AS place FROM s, unnest(range(blocks)) AS x(a) WHERE words > 0),
        q AS (SELECT s.sid, s.shard, s.words, count(v.sid) AS quota FROM s LEFT JOIN v ON v.sid = s.sid AND v.shard = s.shard AND place <= v.blocks GROUP BY ALL),
        r AS (SELECT sid, shard, words, least(quota * {m.BLOCK_WORDS}, words * {int(m.CAP)})::BIGINT AS take, {_seeded(m.SEED + 2, 'sid', 'shard')} % greatest(ceil(words / {float(m.BLOCK_WORDS)}::DOUBLE), 1)::BIGINT * {m.BLOCK_WORDS} AS start FROM q),
        p AS (SELECT keyed.*, r.words, take // greatest(r.words, 1) AS passes, start, start + CASE WHEN r.words > 0 THEN take % r.words ELSE 0 END AS stop,
              (sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS e FROM keyed JOIN r USING (sid, shard))
        SELECT doc_id, size, source_size, target, (passes * size + greatest(least(e, stop) - greatest(e - size, start), 0) + greatest(least(e, stop - words) - greatest(e - size, 0), 0))::BIGINT AS taken FROM p"""


ORACLES: dict[str, str] = {
    "op2_source_mixing": _mix_sql(),
    "op5_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
        x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f),
        s AS (SELECT doc_id, kind, o, ms[i] AS m, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS b FROM x),
        k AS (SELECT *, concat(kind, ':', b, ':', b + length(m)) AS span FROM s
              WHERE kind IN ('pem', 'jwt') OR (kind = 'access' AND length(m) >= 20) OR (kind = 'hex' AND length(m) >= 24) OR (kind = 'assign' AND length(regexp_extract(m, '{_RULES["assign"]}', 2)) >= 6))
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY b, o) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY b, o), '') AS spans
        FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""",
    "op3_exact_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_GOOD}),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN head <> page_id THEN head END AS refers_to FROM h""",
    "op6_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        r(vec_id, l) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.vec_id),
        c AS (SELECT vec_id, min(l) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
        SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
}
