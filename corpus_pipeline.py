"""Corpus preparation: five stages over ``documents``, each a Spark job of its own.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``, in their order, further columns included whatever their names.

In every stage a null text counts as empty and stays null, a null doc_id is a document like
any other, rows that repeat are treated alike, texts are worked on whole, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcheck.llm.util import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. A text without words, null or empty, has the score of the
    intercept alone; repeated rows share their fate; without labelled rows nothing is learnt and
    every document stays."""
    from shelfcheck.llm import toxicity as tx

    return tx.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: three-word shingles, two bits. The one with
    the smallest doc_id stays, of rows that tie on it one; a component that has only null ids
    keeps one row. Texts without words form one component, of fingerprint zero."""
    from shelfcheck.llm import simhash as sh

    return sh.keep_one(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window stay: those without words always, all of them
    where the benchmark is empty, repeated rows each."""
    from shelfcheck.llm import decontaminate as dc

    return dc.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to tags; every row stays. Of overlapping spans the
    first one's tag replaces their union; a null text stays null; n_chars follows the text."""
    from shelfcheck.llm import pii

    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row that is left, with their digests; a null text counts as
    empty and has no ids."""
    import public_tokenizers

    from shelfcheck.llm.bpe import encode_decode

    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], full=True)


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal-data", personal_data),
    ("bpe", tokenize),
]

# The toxicity score is a trained model; SQL cannot state it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
