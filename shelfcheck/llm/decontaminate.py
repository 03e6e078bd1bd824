"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

A window is ``window`` consecutive words of a benchmark item; an item with fewer words,
but not none, is one window. Windows become patterns ``" w1 ... wn "`` of one automaton,
which scans each document's normalised words once; matches map back to word positions and
to character offsets of the original text.

Defined cases: a null or empty text has no words and no hits; an item without words has
no window; repeated items and repeated windows count once per item_id; repeated documents
are treated alike, one result row per input row; null item_ids are ignored. An empty
benchmark contaminates nothing. Only the id and text columns are read, so other columns
and their names do not matter.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.llm.util import map_text, materialize, prepare, words_bytes, worker_state

WINDOW = 10
# An automaton costs about 100 times the pattern bytes; larger benchmarks are scanned in
# blocks of at most this many pattern bytes, so what is broadcast stays bounded.
BLOCK_BYTES = 4_000_000

SPANS = ("n_words long, n_hit long, items array<string>, "
         "spans array<struct<word_start:int,word_end:int,char_start:int,char_end:int>>")

def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
            window: int = WINDOW) -> DataFrame:
    """Distinct patterns with the ids (as strings) of the items that hold them."""

    def make():
        def fn(texts):
            out = []
            for t in texts:
                w = words_bytes(t)
                ws = {b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
                out.append((sorted(x.decode("utf-8", "surrogatepass") for x in ws),))
            return out
        return fn

    per_item = map_text(benchmark, text, [item_id], "patterns array<string>", make, stateful=False)
    return (per_item.where(F.col(item_id).isNotNull())
            .select(F.col(item_id).cast("string").alias("item"), F.explode("patterns").alias("pattern"))
            .groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _automaton(patterns):
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, (p, _) in enumerate(patterns):
        a.add_word(f" {p} ", i)
    if patterns:
        a.make_automaton()
    return a, [items for _, items in patterns], [p.count(" ") + 1 for p, _ in patterns]


def scan(text: str | None, automaton, items_of, n_words_of, with_spans: bool = True):
    """One text: number of words, hit words, item ids, merged spans."""
    words = words_bytes(text)
    if not words or not len(automaton):
        return len(words), 0, [], []
    norm = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = list(automaton.iter(norm))
    if not found:
        return len(words), 0, [], []
    # Word i starts at starts[i] in the normalised string.
    starts, at = [], 1
    for w in norm[1:-1].split(" "):
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    items, runs = set(), []
    for end, i in found:  # `end` is the space after the last word, starts[j] = end + 1
        stop = bisect_left(starts, end + 1)
        runs.append((stop - n_words_of[i], stop))
        items.update(items_of[i])
    runs.sort()
    merged = [list(runs[0])]
    for s, e in runs[1:]:
        if s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    spans = []
    if with_spans:
        at = _offsets(text)
        spans = [(s, e, at[s][0], at[e - 1][1]) for s, e in merged]
    return len(words), sum(e - s for s, e in merged), sorted(items), spans


def _offsets(text: str) -> list[tuple[int, int]]:
    """Character start and end of each word of the original text."""
    return [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: ``keep`` columns, n_words, n_hit, items, spans.

    ``n_hit`` counts the document words inside any occurrence of a window, ``items`` are
    the ids with occurring windows, ``spans`` the merged stretches with word positions
    and character offsets in the original text (ends exclusive).
    """
    spark = docs.sparkSession
    prepare(spark)
    wins = materialize(windows(benchmark, window=window), "windows")
    size = wins.agg(F.sum(F.octet_length("pattern") + F.octet_length(F.array_join("items", ",")) + 2)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64("pattern"), F.lit(n_blocks))

    def one(b: int, frame: DataFrame, cols: list[str]):
        """The matches of one block, and the broadcast they read: at most about block_bytes."""
        part = wins if n_blocks == 1 else wins.where(block == b)
        pats = spark.sparkContext.broadcast(
            sorted((r["pattern"], list(r["items"])) for r in part.collect()))

        key = uuid.uuid4().hex

        def make():
            built = worker_state(key, lambda: _automaton(pats.value))
            return lambda texts: [scan(t, *built) for t in texts]

        return map_text(frame, text, cols, SPANS, make), pats

    if n_blocks == 1:
        return one(0, docs, keep)[0]
    # One job per block over the same written rows: the driver and the executors hold one block
    # at a time. Rows that a block hits are written by number, and joined back once.
    tagged = materialize(docs.select(*keep, text, F.monotonically_increasing_id().alias("__row")), "docs")
    parts = []
    for b in range(n_blocks):
        found, pats = one(b, tagged, ["__row"])
        # The first block's rows carry the number of words of every text.
        parts.append(materialize(found if b == 0 else found.where("n_hit > 0"), "block"))
        pats.destroy()
    pos = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["word_start"], s["word_end"] - 1))))
    per_row = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return (tagged.select(*keep, "__row").join(per_row, "__row")
            .select(*keep, "n_words", F.size(pos).cast("long").alias("n_hit"), "items", "spans"))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Contract columns of ``find``'s result."""
    return found.select(
        doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    keep = [c for c in docs.columns if c != text]
    inner = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)],
                        docs[text].alias("__doc"), docs[text].alias("__scan"))
    names = [f"__k{i}" for i in range(len(keep))]
    found = find(inner, benchmark, [*names, "__doc"], "__scan", window).where("n_hit = 0")
    back = dict(zip(keep, names)) | {text: "__doc"}
    return found.select(*[F.col(back[c]).alias(c) for c in docs.columns])
