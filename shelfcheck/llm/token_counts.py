"""Token counts through a digest cache.

The count of a text is stored under (digest of its normalised content, digest of the
tokenizer file and options). A run encodes only the distinct texts whose digest is not in
the cache, appends their counts, and joins the stored counts back to the documents.

The one normalisation that cannot change a count for every tokenizer is null -> empty, so
the content digest is the SHA-256 of that UTF-8 text.

Defined cases: a null or empty text has 0 bytes and 0 tokens (unless the tokenizer itself
gives some); repeated texts are encoded once and counted for every row; repeated or null
doc_ids keep one result row per input row; an empty table leaves the cache as it was. Two
runs appending the same digest at once leave equal rows, which are read as one. Only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.llm.util import map_text, materialize, prepare, worker_state

LIMIT = 4096
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file and of how it is called."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"plain-encode;" + f.read()).hexdigest()


def _counter(path: str):
    """A function from a list of texts to their token counts."""
    def build():
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(sp.encode(t)) for t in texts]
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]

    return worker_state(("counts", path), build)


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; empty if nothing is stored."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cache = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if fs.exists(p)
             else spark.createDataFrame([], CACHE_SCHEMA))
    return cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per document row; the cache holds every digest after.

    Slim rows (id, digest, bytes) are written once; the text itself crosses the network
    only for distinct digests that miss, reduced per map task before the exchange.
    """
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(docs[text], F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    known = read_cache(spark, cache_path, version)
    # The plan that finds misses sees one row per digest and map task.
    distinct = (docs.select(digest.alias("digest"), content.alias("text"))
                .groupBy("digest").agg(F.first("text").alias("text")))
    misses = distinct.join(known, "digest", "left_anti")

    def make():
        count = _counter(tokenizer_path)
        return lambda texts: [(n,) for n in count([t or "" for t in texts])]

    (map_text(misses, "text", ["digest"], "n_tokens long", make)
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))
    counts = materialize(read_cache(spark, cache_path, version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens")), "counts")
    rows = materialize(docs.select(
        docs[doc_id], digest.alias("digest"),
        F.octet_length(content).cast("long").alias("n_bytes")), "digests")
    return rows.join(counts, "digest", "left").select(doc_id, "n_bytes", "n_tokens")
