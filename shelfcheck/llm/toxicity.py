"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashed word unigrams, bigrams, trigrams and skip-bigrams
(one and two words left out) of its normalised words, whole text, plus a constant. FTRL
keeps a learning rate per coordinate and its L1 term leaves few weights other than zero,
so the model is a short list of (slot, weight) rows: at most 2^BITS, broadcast to the scorers.

Training runs over at most ``train_rows`` labelled documents (the documented bound; those
with the smallest hash of doc_id), ``epochs`` times in a pseudo-random order fixed by the
data, streamed through one task that holds one Arrow batch and the coordinates.

Defined cases: a null or empty text has only the constant feature; labels that are null, or
whose doc_id is null, are not used; of repeated labels of a doc_id the larger counts;
repeated documents are scored (and learned from) once per row; without any usable label
every score is 0. Only the id and text columns of the documents are read.
"""

from __future__ import annotations

import uuid
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.llm.util import map_text, materialize, prepare, words_bytes, worker_state

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 2
# FTRL-proximal: step size, smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.3


def features(text: str | None):
    """Hash slots of a text's features, repeats included; slot 0 is the constant."""
    import numpy as np

    words = words_bytes(text)
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    n = len(h)
    spread = np.uint64(0x9E3779B97F4A7C15)
    parts = [h * spread]
    for kind, gaps in enumerate([(1,), (2,), (3,), (1, 1)], 1):
        reach = sum(gaps)
        if n > reach:
            x = h[:n - reach] + np.uint64(kind << 32)
            at = 0
            for g in gaps:
                at += g
                x = (x * spread) ^ h[at:n - reach + at]
            x ^= x >> np.uint64(29)
            parts.append(x * spread)
    slots = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([[0], np.maximum(slots, 1)])


class Ftrl:
    """Per-coordinate state of FTRL-proximal logistic regression."""

    def __init__(self):
        import numpy as np

        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, idx):
        import numpy as np

        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots, label: int) -> None:
        import numpy as np

        idx = np.unique(slots)
        w = self.weights(idx)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[idx] = n + g * g

    def model(self):
        import numpy as np

        w = self.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        return at, w[at]


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> list[tuple[int, float]]:
    """Weights other than zero: at most 2^BITS pairs, so they fit the driver."""
    spark = docs.sparkSession
    prepare(spark)
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
             .groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
             .orderBy(F.xxhash64(doc_id), doc_id).limit(train_rows))
    # At most train_rows slim rows by the limit above.
    rows = materialize(
        docs.select(docs[doc_id].alias("k"), docs[text].alias("t"))
        .join(F.broadcast(known.withColumnRenamed(doc_id, "k")), "k")
        .orderBy(F.xxhash64("k"), F.xxhash64("t")).limit(train_rows), "train")
    turns = rows.select("y", "t", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("e"), "k")
    ordered = (turns.repartition(1).sortWithinPartitions("e", F.xxhash64("k", "e"), F.xxhash64("t"))
               .select("y", "t"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        state, seen = Ftrl(), 0
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                state.learn(features(t), 1 if y else 0)
                seen += 1
        at, w = state.model() if seen else (np.empty(0, np.int64), np.empty(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())],
                                         names=["slot", "weight"])

    return [(r["slot"], r["weight"]) for r in ordered.mapInArrow(run, "slot long, weight double").collect()]


def score(docs: DataFrame, model: list[tuple[int, float]], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus ``score`` for every document row. A map: no shuffle."""
    import numpy as np

    spark = docs.sparkSession
    prepare(spark)
    packed = (np.array([s for s, _ in model], np.int64), np.array([w for _, w in model], np.float64))
    weights = spark.sparkContext.broadcast(packed)
    key = uuid.uuid4().hex

    def make():
        def build():
            dense = np.zeros(1 << BITS)
            at, w = weights.value
            dense[at] = w
            return dense, len(at) > 0

        dense, learned = worker_state(key, build)

        def one(t):
            if not learned:
                return (0.0,)
            slots = features(t)
            hit = np.unique(slots[dense[slots] != 0])
            return (float(1 / (1 + np.exp(-np.clip(dense[hit].sum(), -35, 35)))),)

        return lambda texts: [one(t) for t in texts]

    return map_text(docs, text, keep, "score double", make)


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str], doc_id: str = "doc_id",
                    text: str = "text", label: str = "toxic") -> DataFrame:
    """Train on the labels that may be learned, score every row."""
    return score(docs, train(docs, labels, doc_id, text, label), keep, text)


def accept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """The document rows that score below the threshold, all columns kept."""
    keep = [c for c in docs.columns if c != text]
    inner = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)],
                        docs[text].alias("__doc"), docs[text].alias("__scan"))
    names = [f"__k{i}" for i in range(len(keep))]
    model = train(docs, labels, doc_id, text)
    passed = score(inner, model, [*names, "__doc"], "__scan").where(F.col("score") < threshold)
    back = dict(zip(keep, names)) | {text: "__doc"}
    return passed.select(*[F.col(back[c]).alias(c) for c in docs.columns])
