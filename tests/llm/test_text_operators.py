"""Text operators against brute force, on small frames that hold the odd cases: nulls, empty
and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import re

import pytest
from public_tokenizers import path

from tests.conftest import SF_SMALL

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BENCH_A = "the quick brown fox jumps over the lazy dog near the river bank today"
BENCH_B = "Only four words here"
SCHEMA = "doc_id long, text string, n_words string, items string, fp int, __row long, score string"


def words(t):
    return WORD.findall((t or "").translate(LOW))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


TEXTS = [
    (1, None), (2, ""), (3, "  \n "), (4, f"Intro, {BENCH_A.upper()}! and more"),
    (5, "x " + " ".join(BENCH_A.split()[:9]) + " y"), (6, "say ONLY-four words; here. only four words here"),
    (7, "word " * 30_000 + BENCH_A), (8, "Ünï çödé 日本 0-9_a"), (8, "Ünï çödé 日本 0-9_a"), (None, "no id"),
    (9, "CC BY 4.0. All rights reserved; cc by"), (10, "the GNU General Public License v3"),
    (11, "released under the MIT Licence by us"), (12, "á ﬁ Σς \x1c   <|endoftext|>don't"),
    (13, "a b c d e f g h i j"), (14, "a b c d e f g h i j"), (15, "a b"), (16, "junk" * 30_000),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z") for i, t in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_windows(texts, bench):
    wins = {}
    for item, t in bench:
        w = words(t)
        if item is not None and w:
            for i in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for i, t in texts:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[a:a + n]))) is not None:
                    hit.update(range(a, a + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return sorted(out, key=repr)


BENCH = [(10, BENCH_A), (9, BENCH_B), (9, BENCH_B), (8, None), (7, "!!"), (None, "a b c d e f g h i j"), (3, BENCH_A)]


@pytest.mark.parametrize("block_bytes", [4_000_000, 60])
def test_decontamination_matches_brute_force(spark, block_bytes):
    from shelfcheck.llm import decontaminate as dc

    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = dc.digest(dc.find(frame(spark), bench, ["doc_id"], block_bytes=block_bytes))
    assert result(got) == brute_windows(TEXTS, BENCH)


def test_decontamination_spans_and_clean(spark):
    from shelfcheck.llm import decontaminate as dc

    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = frame(spark)
    (row,) = [r for r in dc.find(docs, bench, ["doc_id"]).collect() if r["doc_id"] == 4]
    text = dict(TEXTS)[4]
    assert [text[s["char_start"]:s["char_end"]] for s in row["spans"]] == [BENCH_A.upper()]
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in TEXTS} - {4, 6, 7}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.clean(docs, empty).count() == len(TEXTS)
    assert dc.find(docs.limit(0), bench, ["doc_id"]).count() == 0


def test_bpe_is_exact(spark):
    import tokenizers

    from shelfcheck.llm.bpe import encode_decode

    tok = tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)),
                     sha(tok.decode(ids, skip_special_tokens=False))))
    assert result(encode_decode(frame(spark), path("word_bpe_49k.json"), ["doc_id"])) == sorted(want, key=repr)
    assert encode_decode(frame(spark).limit(0), path("word_bpe_49k.json"), ["doc_id"]).count() == 0


def test_bpe_words_and_pairs_against_the_library():
    import random

    import tokenizers

    from shelfcheck.llm.bpe import codec

    c, tok = codec(path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    rnd = random.Random(1)
    letters = [*"abcdefgtheinr", "'s", "12", "é", "ß", "Σ", "İ", "ﬁ", "日", "\U0001f600", " ", "\n", "\x1c", "\xa0", "<|", "|>",
               "<|startoftext|>", "!!", "~"]
    for _ in range(2000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30)))
        ids = tok.encode(t, add_special_tokens=False).ids
        packed = c.encode(t)
        assert packed == b"".join(x.to_bytes(4, "little") for x in ids), repr(t)
        assert c.decode(packed) == tok.decode(ids, skip_special_tokens=False), repr(t)


def test_token_counts_and_cache(spark, tmp_dir):
    import sentencepiece

    from shelfcheck.llm import token_counts as tc

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in TEXTS), key=repr)
    cache = f"{tmp_dir}/cache"
    assert result(tc.token_counts(frame(spark), path("piece_bpe_32k.model"), cache)) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in TEXTS})
    # A second run finds every digest and appends nothing; one new text appends one row.
    assert result(tc.token_counts(frame(spark), path("piece_bpe_32k.model"), cache)) == want
    assert spark.read.parquet(cache).count() == stored.count()
    tc.token_counts(frame(spark, [(1, "something new"), (2, "something new")]), path("piece_bpe_32k.model"), cache)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # Another tokenizer has counts of its own in the same cache.
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    few = TEXTS[:6]
    got = tc.token_counts(frame(spark, few), path("byte_bpe_50k.json"), cache)
    assert result(got) == sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))
                                  for i, t in few), key=repr)
    assert tc.token_counts(frame(spark).limit(0), path("piece_bpe_32k.model"), cache).count() == 0


def test_licenses_base_counts_match_brute_force(spark):
    from shelfcheck.llm import licenses as ls

    want = []
    for i, t in TEXTS:
        w, places, labels = words(t), [], set()
        for phrase, label in ls.BASE.items():
            p = phrase.split()
            at = [a for a in range(len(w) - len(p) + 1) if w[a:a + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = ls.digest(ls.scan(frame(spark), ["doc_id"]))
    assert result(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    assert ls.scan(frame(spark).limit(0), ["doc_id"]).count() == 0


def test_fuzzy_notices_match_an_edit_distance_search():
    import random

    from shelfcheck.llm.licenses import Scanner, edits_allowed

    def best(notice, text):  # least edits of the notice against any substring
        prev = [0] * (len(text) + 1)
        for i, a in enumerate(notice, 1):
            row = [i]
            for j, b in enumerate(text, 1):
                row.append(min(prev[j - 1] + (a != b), prev[j] + 1, row[-1] + 1))
            prev = row
        return min(prev)

    notice = "redistribution and use in source and binary forms"
    s, rnd = Scanner([(notice, "bsd")], {}), random.Random(4)
    for _ in range(150):
        chars = list(notice)
        for _ in range(rnd.randint(0, 6)):
            at, how = rnd.randrange(len(chars)), rnd.random()
            chars[at:at + 1] = [] if how < .3 else [rnd.choice("xyz")] if how < .7 else [chars[at], rnd.choice("xyz")]
        text = f"see {''.join(chars)} below"
        spans = s.scan(text)[7]
        if best(notice, " ".join(words(text))) > edits_allowed(notice):
            assert not spans
        elif spans:
            assert all(x[3] <= edits_allowed(notice) for x in spans)
        else:  # too many edits only once whole words at the borders are asked for
            assert chars[0] != notice[0] or chars[-1] != notice[-1] or best(notice, "".join(chars)) > 0
    assert s.scan("")[6] == 0.0 and s.scan(notice)[6] == 1.0


def test_a_shorter_notice_inside_does_not_displace_an_edited_longer_one():
    from shelfcheck.llm.licenses import Scanner

    s = Scanner()
    for text, edits in (("licenced under the gnu general public license version 3", 1),
                        ("licensed under gnu general public license version 3", 4)):
        _, _, _, _, _, labels, score, spans = s.scan(f"this is {text} or later")
        assert labels == ["gpl", "gpl-3"] and score == 1.0
        assert [(x[0], x[3]) for x in spans] == [("gpl", 0), ("gpl-3", edits)]
    # Another version's notice over the same words still gives way to the better one.
    assert s.scan("licenced under the gnu general public license version 2")[5] == ["gpl", "gpl-2"]
    assert s.scan("licensed under cc by sa 4 0")[5] == ["cc-by", "cc-by-sa"]


def test_adjacent_copies_of_a_notice_all_get_spans():
    import itertools

    from shelfcheck.llm.licenses import Scanner

    s = Scanner([("released under the mit license", "mit")], {})
    copies = {"released under the mit license": 0, "released under the mit licence": 1, "released undr the mit licens": 2}
    for order in itertools.product(copies, repeat=4):
        spans = s.scan(" x ".join(order))[7]
        assert [(x[1], x[3]) for x in spans] == [(6 * i, copies[c]) for i, c in enumerate(order)], order


def test_toxicity_separates_held_out_rows_and_skips_their_labels(spark):
    import random
    from zlib import crc32

    from shelfcheck.llm import toxicity as tx

    rnd = random.Random(0)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        t = [rnd.choice(vocab) for _ in range(40)]
        if bad:
            t[rnd.randrange(40)] = rnd.choice(["scumword", "trashword"])
        rows.append((i, " ".join(t)))
        held = crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(bad) if not held else int(not bad)))  # wrong where they must not be read
    rows += [(5000, None), (5001, ""), (None, "scumword"), (0, rows[0][1]), (5002, "fine " * 40_000)]
    labels += [(None, 1), (1, None)]
    docs = frame(spark, rows)
    scored = tx.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ["doc_id"])
    got = scored.select("doc_id", tx.held_out().alias("held"), "score").collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1200]
    assert all(r["held"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in own)
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in own if r["held"]]
    assert sum(right) >= 0.97 * len(right)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tx.score_documents(docs, none, ["doc_id"]).collect()} == {0.0}
    kept = tx.accept(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    assert result(kept.select("doc_id")) == sorted(
        [(r["doc_id"],) for r in got if r["score"] < tx.THRESHOLD], key=repr)


def test_toxicity_held_out_quality_on_the_test_table(spark):
    from shelfcheck.llm import toxicity as tx

    d = SF_SMALL.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = (tx.score_documents(docs, labels, ["doc_id"]).where(tx.held_out()).join(labels, "doc_id")
            .select("score", "toxic").collect())
    good = sorted(r["score"] for r in rows if not r["toxic"])
    bad = [r["score"] for r in rows if r["toxic"]]
    auc = sum(sum(g < b for g in good) + 0.5 * sum(g == b for g in good) for b in bad) / len(good) / len(bad)
    assert auc > 0.97


def test_license_scan_is_linear_in_long_texts():
    """Texts of a million characters: inexact copies of notices, and a base phrase over and over."""
    import time

    from shelfcheck.llm.licenses import Scanner

    sc, at = Scanner(), {}
    for n in (4_000, 32_000):
        copies = "released under the mit licence x " * n
        began = time.process_time()
        found = sc.scan(copies)
        at[n] = time.process_time() - began
        assert len(found[-1]) == n and found[5] == ["mit"] and all(s[3] == 1 for s in found[-1])
    assert len(copies) > 1_000_000 and at[32_000] < 10
    began = time.process_time()
    assert sc.scan("cc by " * 200_000)[:4] == (400_000, 200_000, 0, 399_998)
    assert time.process_time() - began < 10
    mixed = "licensed under the gnu general public license version 2 all rigts reserved " * 12_000
    found = sc.scan(mixed)
    assert sorted({s[0] for s in found[-1]}) == ["gpl", "gpl-2", "reserved"] and len(found[-1]) == 36_000


def test_decontamination_holds_one_block_at_a_time(spark, monkeypatch):
    """A benchmark of many blocks: results as with one, and every broadcast below the bound."""
    from pyspark import SparkContext

    from shelfcheck.llm import decontaminate as dc

    docs = frame(spark)
    bench = spark.createDataFrame([(f"i{k}", t) for k, (_, t) in enumerate(TEXTS) if t], "item_id string, text string")
    whole = result(dc.digest(dc.find(docs, bench, ["doc_id"])))
    alive, most, sizes, send = [0], [0], [], SparkContext.broadcast

    def counted(self, value):
        made = send(self, value)
        sizes.append(sum(len(p) + len(",".join(i)) + 2 for p, i in value))
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        gone = made.destroy
        made.destroy = lambda *a: (alive.__setitem__(0, alive[0] - 1), gone(*a))
        return made

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    assert result(dc.digest(dc.find(docs, bench, ["doc_id"], block_bytes=20_000))) == whole
    assert len(sizes) > 2 and most[0] == 1 and alive[0] == 0
    assert sorted(sizes)[-2] < 2 * 20_000 < max(sizes)  # a word of 120,000 characters is a window of its own


def test_toxicity_training_matches_a_plain_ftrl():
    """Features and per-coordinate updates written out in plain Python, word by word."""
    import random
    import re
    from math import exp, sqrt
    from zlib import crc32

    from shelfcheck.llm import toxicity as tx

    def slots(text):
        h = [crc32(w.encode()) for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())]
        out, spread, whole = {0}, 0x9E3779B97F4A7C15, (1 << 64) - 1
        for i in range(len(h)):
            out.add(max(1, (h[i] * spread & whole) >> (64 - tx.BITS)))
            for kind, gaps in enumerate([(1,), (2,), (3,), (1, 1)], 1):
                if i + sum(gaps) < len(h):
                    x, at = h[i] + (kind << 32), i
                    for g in gaps:
                        at += g
                        x = (x * spread & whole) ^ h[at]
                    x ^= x >> 29
                    out.add(max(1, (x * spread & whole) >> (64 - tx.BITS)))
        return out

    rnd, words = random.Random(8), [f"w{k}" for k in range(60)] + ["vile", "awful"]
    rows = []
    for _ in range(300):
        t = [rnd.choice(words[:60]) for _ in range(rnd.randint(0, 25))]
        y = rnd.random() < 0.4
        rows.append((" ".join(t + ([rnd.choice(words[60:])] * 2 if y else [])), int(y)))
    z, n, state = {}, {}, tx.Ftrl()

    def weight(s):
        if abs(z.get(s, 0.0)) <= tx.L1:
            return 0.0
        return -(z[s] - (1 if z[s] > 0 else -1) * tx.L1) / ((tx.BETA + sqrt(n[s])) / tx.ALPHA + tx.L2)

    for text, y in rows:
        own = slots(text)
        assert own == set(tx.features(text).tolist())
        w = {s: weight(s) for s in own}
        g = 1 / (1 + exp(-sum(w.values()))) - y
        for s in own:
            old = n.get(s, 0.0)
            z[s] = z.get(s, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / tx.ALPHA * w[s]
            n[s] = old + g * g
        state.learn(tx.features(text), y)
    at, w = state.model()
    want = {s: weight(s) for s in z if weight(s)}
    assert set(at.tolist()) == set(want) and len(want) > 3
    assert all(abs(want[s] - x) < 1e-9 for s, x in zip(at.tolist(), w.tolist()))


def test_license_scan_with_own_notices(spark):
    from shelfcheck.llm import licenses as ls

    docs = spark.createDataFrame([(1, "Under the Example Licence, release 3."), (2, "released under the mit license"), (3, None)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in ls.scan(
        docs, ["doc_id"], notices=[("under the example license release 3", "example")], base={"release 3": "third"}).collect()}
    assert got == {1: (["example", "third"], 1), 2: ([], 0), 3: ([], 0)}
    assert {r["doc_id"]: r["labels"] for r in ls.scan(docs, ["doc_id"]).collect()}[2] == ["mit"]


def test_bpe_special_strings_of_any_form(tmp_path):
    """A tokenizer file whose special strings share no beginning."""
    import json

    import public_tokenizers as P
    import tokenizers

    from shelfcheck.llm.bpe import Codec

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for added, name in zip(spec["added_tokens"], ("[START]", "</END>")):
        spec["model"]["vocab"][name] = spec["model"]["vocab"].pop(added["content"], added["id"])
        added["content"] = name
    spec["post_processor"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    codec, tok = Codec(str(path)), tokenizers.Tokenizer.from_file(str(path))
    for t in ("a [START] b</END>", "[START]", "plain text", "", "[start] </end> <|startoftext|>", "x</END></END>y [START"):
        ids = tok.encode(t, add_special_tokens=False).ids
        packed = codec.encode(t)
        assert [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)] == ids, t
