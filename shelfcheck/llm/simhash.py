"""SimHash near-duplicates through anchor-point covering.

Fingerprint: bit i is set if it is set in over half of the XXH64 hashes (seed 42) of the
word shingles, repeats included. Two fingerprints link at ``max_bits`` or fewer differing
bits; components of the links are the near-duplicate groups.

Anchors are the words of a covering code over the first 46 fingerprint bits: two blocks of
the perfect binary Golay code [23, 12], covering radius 3 each. Every fingerprint has one
home anchor, the code word nearest in each block. Two fingerprints that differ in at most t
bits differ in t1 + t2 <= t of the blocks' bits, so the second lies within 3 + t1 and 3 + t2
of the first one's home. Each fingerprint is therefore replicated to every anchor within
covering radius plus threshold, the threshold shared between the blocks (about 61 anchors
for t = 2), and compared per anchor with the fingerprints at home there. No pair is missed
and each link appears once.

Only distinct fingerprints are replicated, so copies cost nothing beyond their own row.

Defined cases: a null or empty text has the fingerprint zero and links like any other; a
text with fewer words than a shingle hashes the whole sequence; repeated rows and repeated
doc_ids keep one result row each; the component_id ignores null doc_ids and is null if a
component has no other; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.llm.graph import components
from shelfcheck.llm.util import free_worker_state, map_text, materialize, prepare

SHINGLE = 3
MAX_BITS = 2
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code
LENGTH, RADIUS = 23, 3

_TABLES: dict = {}


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        h = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        h = [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]
    total = np.zeros(64, np.int64)
    hashes = np.array(h, "<u8")
    for i in range(0, len(h), 16_384):
        bits = np.unpackbits(hashes[i:i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns plus ``fp``, one row per document."""
    return map_text(docs, text, keep, "fp long",
                    lambda: lambda texts: [(fingerprint(t, shingle),) for t in texts], stateful=False)


def _syndromes(words):
    """Remainders of 23-bit words modulo the generator."""
    import numpy as np

    r = np.array(words, np.int64, copy=True)
    for shift in range(LENGTH - 12, -1, -1):
        top = (r >> (shift + 11)) & 1
        r ^= top * (GENERATOR << shift)
    return r


def _patterns(threshold: int):
    """Error patterns up to covering radius plus threshold, grouped by syndrome.

    The patterns with a word's syndrome lead from it to all code words in that range.
    Returns (patterns, excess over the radius, start of each syndrome).
    """
    if threshold not in _TABLES:
        from itertools import combinations

        import numpy as np

        pats = [0]
        for w in range(1, RADIUS + threshold + 1):
            pats += [sum(1 << b for b in c) for c in combinations(range(LENGTH), w)]
        pats = np.array(pats, np.int64)
        syn = _syndromes(pats)
        order = np.argsort(syn, kind="stable")
        pats, syn = pats[order], syn[order]
        excess = np.maximum(np.array([int(p).bit_count() for p in pats]) - RADIUS, 0)
        _TABLES[threshold] = pats, excess, np.searchsorted(syn, np.arange(2 ** 11 + 1))
    return _TABLES[threshold]


def anchors(fp: int, threshold: int):
    """(anchors, home flags) of one fingerprint: code word pairs as 46-bit numbers."""
    import numpy as np

    pats, excess, start = _patterns(threshold)
    x = np.array([fp & (2 ** LENGTH - 1), (fp >> LENGTH) & (2 ** LENGTH - 1)], np.int64)
    s = _syndromes(x)
    p1, e1 = pats[start[s[0]]:start[s[0] + 1]], excess[start[s[0]]:start[s[0] + 1]]
    p2, e2 = pats[start[s[1]]:start[s[1] + 1]], excess[start[s[1]]:start[s[1] + 1]]
    both = e1[:, None] + e2[None, :]
    i, j = np.nonzero(both <= threshold)
    return ((p1[i] ^ x[0]) << LENGTH) | (p2[j] ^ x[1]), both[i, j] == 0


def replicate(nodes: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp, home) for every anchor of every fingerprint."""
    prepare(nodes.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        free_worker_state()
        for b in batches:
            fps = b.column(0).to_pylist()
            made = [anchors(f, threshold) for f in fps]
            if not made:
                continue
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a for a, _ in made])),
                pa.array(np.repeat(np.array(fps, np.int64), [len(a) for a, _ in made])),
                pa.array(np.concatenate([h for _, h in made]))], names=["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b, for all distinct fingerprints at ``max_bits`` or fewer bits.

    Spark sizes the copies like the fingerprints they come from, some 60 times too low. The
    hint keeps it from broadcasting them for that; adaptive execution still splits skew.
    """
    rows = replicate(nodes, max_bits)
    visitors = rows.select("anchor", F.col("fp").alias("b"))
    homes = rows.where("home").select("anchor", F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return homes.join(visitors.hint("merge"), (homes["anchor"] == visitors["anchor"]) & near).select("a", "b")


def groups(rows: DataFrame, doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, label) per distinct ``fp`` of written ``rows``; ``component_id``
    is the smallest ``doc_id`` of the component, ``label`` its smallest fingerprint."""
    nodes = materialize(rows.groupBy("fp").agg(F.min(doc_id).alias("low_id")), "fingerprints")
    stars = materialize(components(links(nodes, max_bits)), "components")
    # Fingerprints without a link are their own component.
    named = materialize(
        nodes.join(stars, nodes["fp"] == stars["node"], "left")
        .select("fp", "low_id", F.coalesce("label", "fp").alias("label")), "labelled")
    low = materialize(named.groupBy("label").agg(F.min("low_id").alias("component_id")), "lowest")
    return named.join(low, "label").select("fp", "component_id", "label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every document row."""
    rows = materialize(fingerprints(docs, [doc_id], text, shingle), "simhash")
    named = materialize(groups(rows, doc_id, max_bits), "groups")
    return rows.join(named, "fp").select(doc_id, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document row of each component, all columns kept: that with the smallest doc_id
    (nulls last); of repeated rows with this doc_id any single one.

    The documents are written once with a row number and their fingerprint; everything
    that decides which rows stay is slim.
    """
    cols = docs.columns
    keep = [c for c in cols if c != text]
    inner = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)],
                        docs[text].alias("__doc"), docs[text].alias("__scan"))
    names = [f"__k{i}" for i in range(len(keep))]
    rows = materialize(
        fingerprints(inner, [*names, "__doc"], "__scan", shingle)
        .withColumn("__row", F.monotonically_increasing_id()), "numbered")
    key = names[keep.index(doc_id)]
    label = materialize(groups(rows.select("fp", key), key, max_bits), "groups")
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__row").alias("r")))
    stay = (rows.select("fp", key, "__row").join(label, "fp")
            .groupBy("label").agg(first.alias("s")).select(F.col("s.r").alias("__row")))
    back = dict(zip(keep, names)) | {text: "__doc"}
    return rows.join(stay, "__row", "left_semi").select(*[F.col(back[c]).alias(c) for c in cols])
