"""Registered queries of the training-data operators, and SQL where SQL can state them.

Each query reads its whole table, calls one operator with production parameters and
derives the contract's columns from the operator's result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcheck.llm.util import table
from shelfcheck.session import scratch_path

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@register
def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark windows in documents."""
    from shelfcheck.llm import decontaminate as dc

    return dc.digest(dc.find(table(spark, d, "documents"), table(spark, d, "benchmark"), ["doc_id"]))


ORACLE["op2_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS p
  FROM bw, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i)
  WHERE len(w) > 0),
grams AS (
  SELECT r, i, k.n, array_to_string(list_slice(w, i, i + k.n - 1), ' ') AS p
  FROM dw, (SELECT DISTINCT n FROM win) k,
       LATERAL (SELECT unnest(generate_series(1, len(w) - k.n + 1)) AS i)),
hits AS (SELECT DISTINCT g.r, g.i, g.n, win.item FROM grams g JOIN win ON win.p = g.p AND win.n = g.n),
pos AS (SELECT r, count(DISTINCT word_at) AS n_hit
        FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS word_at FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@register
def op9_bpe(spark: SparkSession, d: str) -> DataFrame:
    """BPE ids of every document and their decoding, as digests."""
    import public_tokenizers

    from shelfcheck.llm.bpe import encode_decode

    return encode_decode(table(spark, d, "documents"),
                         public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


@register
def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of every document; each run starts its own empty cache, so that its
    work does not depend on earlier runs."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from shelfcheck.llm import token_counts as tc

    cache = scratch_path(spark, "llm", f"token-cache-{uuid.uuid4().hex}")
    counts = tc.token_counts(table(spark, d, "documents"),
                             public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > tc.LIMIT)


@register
def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from shelfcheck.llm import simhash as sh

    return sh.near_duplicates(table(spark, d, "documents")).select(
        "doc_id", sh.hex_fingerprint().alias("fingerprint"), "component_id")


@register
def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity score of every document."""
    from pyspark.sql import functions as F

    from shelfcheck.llm import toxicity as tx

    scored = tx.score_documents(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])
    return scored.select("doc_id", tx.held_out().alias("held_out"), "score",
                         (F.col("score") >= tx.THRESHOLD).cast("int").alias("predicted"))


@register
def op8_licenses(spark: SparkSession, d: str) -> DataFrame:
    """License phrases and notices in every document."""
    from shelfcheck.llm import licenses as ls

    return ls.digest(ls.scan(table(spark, d, "documents"), ["doc_id"]))


@register
def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in every document."""
    from shelfcheck.llm import pii

    return pii.digest(table(spark, d, "documents"))


@register
def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    from shelfcheck.llm import warc

    return warc.round_trip(table(spark, d, "pages"))


ORACLE["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM k
"""


@register
def op5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest vectors by inner product for every twentieth vec_id."""
    from pyspark.sql import functions as F

    from shelfcheck.llm import ann

    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op3_training_order(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences of every document in shards by training slot, read back: one row per
    sequence with its place and the digest of its ids."""
    import public_tokenizers

    from shelfcheck.llm import training_order as to

    placed = to.round_trip(table(spark, d, "documents"),
                           public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return placed.select("doc_id", "seq_no", "slot", "shard", "byte_offset", "n_ids", "ids_sha256")


@register
def op12_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the one that stays of its equal texts. Each run starts its own index
    and fills it in two deliveries, so the second one meets what the first one left."""
    from shelfcheck.llm import digest_index as di

    index = di.DigestIndex(spark, scratch_path(spark, "llm", f"digest-index-{uuid.uuid4().hex}"))
    return di.dedupe(table(spark, d, "documents"), index)


ORACLE["op12_exact_dedup"] = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""


@register
def op11_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's cluster after three exact rounds of 16 centroids."""
    from shelfcheck.llm import heap_kmeans as hk

    assigned, centroids, _ = hk.cluster(table(spark, d, "embeddings"))
    return hk.with_inertia(assigned, centroids)


# Vectors as one row per component; a round assigns, then moves the centroids that have vectors.
_ASSIGN = """
d{r} AS MATERIALIZED (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d
  FROM v JOIN c{r} c ON c.pos = v.pos GROUP BY v.vec_id, c.c),
a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * 100 + c)::INTEGER AS c, min(d) AS d FROM d{r} GROUP BY vec_id)"""
_MOVE = """,
c{n} AS MATERIALIZED (SELECT c.c, c.pos, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT a.c, v.pos, floor(sum(v.x) / count(*))::BIGINT AS x FROM a{r} a JOIN v USING (vec_id) GROUP BY a.c, v.pos) m
  ON m.c = c.c AND m.pos = c.pos),"""
ORACLE["op11_clusters"] = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept
          ORDER BY sha256('1:' || vec_id) LIMIT 16),
c0 AS MATERIALIZED (SELECT first.c, v.pos, v.x FROM first JOIN v USING (vec_id)),""" + "".join(
    _ASSIGN.format(r=r) + (_MOVE.format(r=r, n=r + 1) if r < 3 else "") for r in range(4)) + """,
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS s FROM c3 GROUP BY c)
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.s AS centroid_sha256
FROM a3 a JOIN h USING (c)
"""


@register
def op13_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as 16 codebook numbers, with the error they leave."""
    from shelfcheck.llm import cover_codes as cc

    return cc.with_label_error(*cc.compress(table(spark, d, "embeddings")))


# Parts as one row per component: p part, pos position within it, e entry.
_PART_ASSIGN = """
a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 100 + e)::INTEGER AS e, min(d) AS d FROM (
  SELECT v.vec_id, v.p, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d
  FROM v JOIN c{r} c ON c.p = v.p AND c.pos = v.pos GROUP BY v.vec_id, v.p, c.e) GROUP BY vec_id, p)"""
_PART_MOVE = """,
c{n} AS MATERIALIZED (SELECT c.p, c.e, c.pos, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT a.p, a.e, v.pos, floor(sum(v.x) / count(*))::BIGINT AS x
  FROM a{r} a JOIN v ON v.vec_id = a.vec_id AND v.p = a.p GROUP BY a.p, a.e, v.pos) m
  ON m.p = c.p AND m.e = c.e AND m.pos = c.pos),"""
ORACLE["op13_codes"] = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS f, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT vec_id, w, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS i FROM kept),
v AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS pos, x FROM flat),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
c0 AS MATERIALIZED (SELECT v.p, first.e, v.pos, v.x FROM first JOIN v USING (vec_id)),""" + "".join(
    _PART_ASSIGN.format(r=r) + (_PART_MOVE.format(r=r, n=r + 1) if r < 2 else "") for r in range(3)) + """,
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT coded.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, pos)) FROM c2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
