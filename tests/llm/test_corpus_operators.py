"""Near-duplicates, personal data, search, archives, shards and the pipeline against brute
force and exact round trips, on small frames that hold the odd cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import TEXTS, brute_windows, frame, result, sha


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(t):
    from xxhash import xxh64_intdigest

    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = sorted(label)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    return {f: root(f) for f in fps}


def near_copies():
    rnd = random.Random(9)
    rows = list(TEXTS)
    for g in range(6):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(300)]
        for k in range(14):
            t = list(base)
            for _ in range(k % 4):
                t[rnd.randrange(300)] = "zz"
            rows.append((100 + 20 * g + k, " ".join(t)))
    return rows


def test_simhash_matches_brute_force(spark):
    from shelfcheck.llm import simhash as sh

    rows = near_copies()
    fps = [brute_fingerprint(t) for _, t in rows]
    part = brute_components(fps)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[part[f]] = min(i, low.get(part[f], i))
    want = sorted(((i, f"{f:016x}", low.get(part[f])) for (i, _), f in zip(rows, fps)), key=repr)
    got = sh.near_duplicates(frame(spark, rows)).select("doc_id", sh.hex_fingerprint().alias("x"), "component_id")
    assert result(got) == want
    assert len(set(part.values())) < len(set(fps))  # some links are between different fingerprints
    docs = frame(spark, rows)
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({part[f] for f in fps})
    assert sorted(x for x in ids if x is not None) == sorted(low.values())
    assert sh.near_duplicates(docs.limit(0)).count() == 0 and sh.keep_one(docs.limit(0)).count() == 0


def test_links_never_broadcast_the_copies(spark):
    from shelfcheck.llm import simhash as sh

    near = sh.links(spark.createDataFrame([(0b1011,), (0b1000,), (1 << 60 | 0xFFFF,), (-1,)], "fp long"))
    assert result(near) == [(0b1000, 0b1011)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_anchor_covering_reaches_every_pair():
    from shelfcheck.llm import simhash as sh

    rnd = random.Random(2)
    for _ in range(300):
        x = y = rnd.getrandbits(63)
        for b in rnd.sample(range(63), rnd.randint(0, 2)):
            y ^= 1 << b
        (ax, hx), (ay, hy) = sh.anchors(x, 2), sh.anchors(y, 2)
        assert hx.sum() == hy.sum() == 1
        assert ax[hx][0] in ay and ay[hy][0] in ax


def test_components_of_chains_and_hubs(spark):
    from shelfcheck.llm.graph import components

    rnd = random.Random(7)
    chain = list(range(60))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3), (7, 6), (7, 6)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- personal data

def brute_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_match_brute_force_and_method_spans_come_on_top(spark):
    from shelfcheck.llm import pii

    rnd = random.Random(5)
    bits = ["1", "2", "4", "9", "0", "25", "255", "256", ".", "-", " ", "+", "(", ")", "a", "_", "%", "@", "é", "\U0001f600",
            "\n", "x.com", "@b.c", "4532015112830366", "1.2.3.4", "+1 (555) 555-0100", "::", " call "]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50)))) for i in range(600)]
    rows += TEXTS[:6] + [(9001, "7 " * 30_000), (9002, "a@b.c_d@e.f" * 2_000), (9003, "1." * 8_000), (9004, "9" * 50_000)]
    rows += [(9100 + i, "contact: jo.doe [at] example [dot] com, phone 415-555-0133 ok") for i in range(40)]
    docs = frame(spark, rows)
    got = pii.digest(docs).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        b = brute_spans(t)
        want.append((i, *[sum(k == x for x, _, _ in b) for k in pii.KINDS], sha(",".join(f"{k}:{s}:{e}" for k, s, e in b))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        mine = set(r["spans"].split(",")) - {""}
        t = dict(rows)[r["doc_id"]] if r["doc_id"] != 8 else ""
        assert {f"{k}:{s}:{e}" for k, s, e in brute_spans(t)} <= mine or r["doc_id"] in (8, None)
        if (r["doc_id"] or 0) >= 9100:
            assert mine  # from the method alone
    assert pii.digest(docs.limit(0)).count() == 0


def test_redaction(spark):
    from shelfcheck.llm import pii

    rows = [(1, "mail a.b@c.org now"), (2, None), (3, "clean"), (3, "clean"), (None, "ip 10.0.0.1, +1 (555) 555-0100 é 4532015112830366!")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id long, text string, n_chars long, kind string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    want = [(1, "mail <EMAIL> now", 16, "k"), (2, None, 0, "k"), (3, "clean", 5, "k"), (3, "clean", 5, "k"),
            (None, "ip <IP>, <PHONE> é <CARD>!", 26, "k")]
    assert result(out) == sorted(want, key=repr)


def test_estimation_trusts_the_reliable_labelers():
    from shelfcheck.llm import pii

    rnd, counts = random.Random(3), {}
    for _ in range(4000):
        real = rnd.random() < 0.4
        v = tuple((1 if (rnd.random() < p) == real else -1) for p in (0.95, 0.9, 0.55, 0.85, 0.5))
        counts[v] = counts.get(v, 0) + 1
    model = pii.estimate(sorted(counts.items()))
    assert abs(model["prior"] - 0.4) < 0.05
    right = [t[1, 1] for t in model["reliability"]]
    assert right[0] > right[2] and right[1] > right[4] and right[0] > 0.9


def test_span_classifier_learns_from_spans(spark):
    """Soft labels that hang on the word before and the length: the weights reproduce them, and
    agree with a plain logistic regression."""
    import numpy as np

    from shelfcheck.llm import pii

    rnd, rows = random.Random(4), []
    for _ in range(3000):
        f = (rnd.randrange(12), rnd.randrange(4), rnd.randrange(16), rnd.randrange(2), rnd.randrange(6), rnd.randrange(4))
        real = rnd.random() < 1 / (1 + np.exp(-(2.5 * (f[4] == 2) - 2.0 * (f[0] < 3) - 0.5)))
        rows.append(("phone", *f, 1, 0.95 if real else 0.05))
    cells = spark.createDataFrame(rows, f"kind string, {', '.join(f'{n} int' for n in pii.FEATURES)}, n long, s double").groupBy(
        "kind", *pii.FEATURES).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    w = pii.fit(cells)
    assert w["phone", "f_before", 2] > 1 + w["phone", "f_before", 1] and w["phone", "f_length", 1] < w["phone", "f_length", 9] - 1
    names = list(pii.FEATURES)
    at = {k: i for i, k in enumerate(sorted(w))}
    x = np.zeros((len(rows), len(at)))
    for i, r in enumerate(rows):
        x[i, at["phone", "one", 0]] = 1
        for n, v in zip(names, r[1:7]):
            x[i, at["phone", n, v]] = 1
    y, ridge, b = np.array([r[8] for r in rows]), np.array([0.0 if k[1] == "one" else pii.RIDGE for k in sorted(w)]), np.zeros(len(at))
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (p - y) + ridge * b)
    mine = np.array([w[k] for k in sorted(w)])
    p, q = (1 / (1 + np.exp(-x @ v)) for v in (mine, b))
    assert np.abs(p - q).max() < 0.08 and np.abs(p - q).mean() < 0.02
    assert pii.train(spark.createDataFrame([], pii.spans(pii.matches(spark.createDataFrame(
        [("a", 1)], "t string, __row long"), "t")).schema)) == {"kinds": {}, "weights": {}}


def test_loose_spans_are_decided_by_the_classifier(spark):
    """Votes label, features decide: in a corpus where numbers after ``call`` are phones and those
    after ``order`` are not, the loose ones are told apart."""
    from shelfcheck.llm import pii

    rnd = random.Random(6)
    number = lambda: f"{rnd.randrange(200, 999)}-{rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
    rows = [(i, f"please call {number()} today") for i in range(150)] + [(1000 + i, f"see order {number()}x") for i in range(150)]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != "" for i in range(150)) >= 145
    assert sum(got[1000 + i] != "" for i in range(150)) <= 5


# ---------------------------------------------------------------- search

def test_neighbours_recall_scores_and_odd_vectors(spark):
    import numpy as np

    from shelfcheck.llm import ann

    e = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding").collect()
    odd = [(None, [0.5] * 64), (100_020, None), (100_040, [0.0] * 64), (100_060, [float("nan")] + [1.0] * 63),
           (100_080, [None] + [1.0] * 63), (100_100, []), (100_120, [float("inf")] * 64), (100_140, [1.0, 2.0]),
           (100_141, [2.0, 1.0]), (3, [3.0] * 64), (3, [3.0] * 64)]
    rows = [(r["vec_id"], r["embedding"]) for r in e] + odd
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, block=700, queries=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i, _ in rows[:len(e)] if i % 20 == 0} | {100_140}
    assert [(r["vec_id"], r["score"]) for r in got.pop(100_140)] == [(100_141, 4.0)]
    ok = rows[:len(e)] + [odd[0], *odd[-2:]]
    v = np.array([x for _, x in ok], float)
    ids = [i for i, _ in ok]
    hit = total = 0
    for q, found in got.items():
        at = ids.index(q)
        s = (v * v[at]).sum(axis=1)
        order = sorted((j for j in range(len(ok)) if j != at), key=lambda j: (-s[j], ids[j] is None, ids[j] or 0))[:20]
        hit += len({ids[j] for j in order} & {r["vec_id"] for r in found})
        total += len({ids[j] for j in order})
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(min(abs(r["score"] - s[j]) for j in range(len(ok)) if ids[j] == r["vec_id"]) < 1e-12 for r in found)
        assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert hit / total >= 0.95
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours_at_production_block_size():
    """Recall and the share of candidates verified, over all levels tried, in one full block."""
    import numpy as np

    from shelfcheck.llm import ann

    rng = np.random.default_rng(0)
    n = ann.BLOCK_BYTES // (8 * 64)
    spread = rng.standard_normal((n, 64))
    groups = rng.standard_normal((60, 64))[rng.integers(0, 60, n)] + 0.3 * rng.standard_normal((n, 64))
    for v, most in ((spread / np.linalg.norm(spread, axis=1)[:, None], 0.25), (groups, 0.15)):
        arrays = ann.Arrays(np.arange(n), np.arange(n), v, np.linalg.norm(v, axis=1).max())
        asked, hit = np.arange(0, n, 400), 0
        for q, (at, score) in zip(asked, arrays.search(v[asked], asked, 20)):
            s = v @ v[q]
            s[q] = -np.inf
            hit += len(set(np.argsort(-s)[:20]) & set(at.tolist()))
            assert np.allclose(score, s[at])
        assert hit / (20 * len(asked)) >= 0.95
        assert arrays.verified / (n * len(asked)) < most


def test_neighbours_of_unequal_norms(spark):
    """Blocks by norm: long vectors win by inner product wherever they point."""
    import numpy as np

    from shelfcheck.llm import ann

    rng = np.random.default_rng(1)
    v = rng.standard_normal((900, 16)) * np.exp(rng.uniform(-3, 3, 900))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(got[q] & set(sorted((j for j in range(900) if j != q), key=lambda j: -(v[j] @ v[q]))[:20])) for q in got)
    assert len(got) == 45 and hit / (20 * 45) >= 0.95


# ---------------------------------------------------------------- archives

PAGES = [(5, "http://a/", "x" * 200), (2, "http://b/ c", "x" * 200), (9, None, "x" * 200), (None, "u", "x" * 200),
         (2, "dup", "x" * 200), (3, "s", "short"), (4, "s", "short"), (6, "n", None), (7, "e", ""),
         (8, "long", "ünï " * 200_000), (1, "h", "a\r\n\r\nWARC/1.1\r\n" * 20)]


def test_warc_round_trip(spark):
    from shelfcheck.llm import warc

    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, first int")
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        same = [j for j, _, x in PAGES if x == h and j is not None]
        revisit = len(b) >= 100 and i != min(same, default=i)
        want.append((i, len(b), sha(b), "revisit" if revisit else "response", min(same) if revisit else None))
    assert result(warc.round_trip(pages)) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_keeps_text_ids(spark):
    from shelfcheck.llm import warc

    ids = ["", "<z>", "a\r\nb", None, "50% + é/ ?", "urn:page:", "plain"]
    same = "y" * 150
    pages = spark.createDataFrame([(i, "u", f"page {k}") for k, i in enumerate(ids)] + [("<a", "u", same), ("<b", "u", same)],
                                  "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.round_trip(pages).collect()}
    assert set(got) == {*ids, "<a", "<b"}
    assert all(got[i] == ("response", None, sha(f"page {k}".encode())) for k, i in enumerate(ids))
    assert got["<a"][:2] == ("response", None) and got["<b"][:2] == ("revisit", "<a")


def test_warc_records_are_single_members_and_damage_is_found(spark, tmp_dir):
    from shelfcheck.llm import warc

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages, f"{tmp_dir}/w")
    (file,) = [r["file"] for r in manifest.collect()]
    records = warc.read(spark, manifest).orderBy("offset").collect()
    assert [bytes(r["payload"]).decode() for r in records if r["record_type"] == "response"] == [
        h or "" for (i, _, h) in PAGES if not (h == "x" * 200 and i != 2)]
    raw = open(file.removeprefix("file://"), "rb").read()
    for r in records:  # each record can be read on its own from its offset
        z = zlib.decompressobj(31)
        body = z.decompress(raw[r["offset"]:])
        assert z.eof and body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
    broken = bytearray(raw)
    at = records[3]["offset"] + 40
    broken[at] ^= 0xFF
    open(f"{tmp_dir}/broken.warc.gz", "wb").write(broken)
    with pytest.raises(warc.WarcError):
        list(warc.read_file(f"{tmp_dir}/broken.warc.gz"))
    left = list(warc.read_file(f"{tmp_dir}/broken.warc.gz", strict=False))
    assert len(left) == len(records) - 1
    open(f"{tmp_dir}/cut.warc.gz", "wb").write(raw[:-20])
    with pytest.raises(warc.WarcError):
        list(warc.read_file(f"{tmp_dir}/cut.warc.gz"))
    lie = warc.member(warc.record("response", "urn:page:1", "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None))
    open(f"{tmp_dir}/lie.warc.gz", "wb").write(lie)
    with pytest.raises(warc.WarcError):
        list(warc.read_file(f"{tmp_dir}/lie.warc.gz"))
    assert [r["verified"] for r in warc.read_file(f"{tmp_dir}/lie.warc.gz", strict=False)] == [False]


# ---------------------------------------------------------------- training order

def test_feistel_is_a_keyed_permutation():
    import numpy as np

    from shelfcheck.llm.training_order import Feistel

    for n in (1, 2, 3, 7, 64, 1000, 70_001):
        f = Feistel(n)
        s = f.slots(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (f.numbers(s) == np.arange(n)).all()
    assert (Feistel(1000, 1).slots(np.arange(1000)) != Feistel(1000, 2).slots(np.arange(1000))).mean() > 0.9


def test_shards_hold_every_sequence_once(spark, tmp_dir):
    import numpy as np
    import public_tokenizers as P

    from shelfcheck.llm import training_order as to

    docs, stride, per_shard = frame(spark), 16, 100
    index = to.materialise(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, f"{tmp_dir}/s", stride=stride, per_shard=per_shard)
    tok = to.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for i, t in TEXTS:
        ids = tok.encoding.encode_ordinary(t) + [tok.end] if t else []
        want += [(i, n // stride, ids[n:n + stride]) for n in range(0, len(ids), stride)]
    rows = index.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(want)))
    assert all((r["shard"], r["record"]) == divmod(r["slot"], per_shard) for r in rows)
    records = dict(to.read_slots(index, 0, stride, per_shard))
    assert all(len(x) == stride for x in records.values())
    got = [(r["doc_id"], r["seq_no"], records[r["slot"]][:r["n_ids"]].tolist()) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for start in (1, per_shard - 1, per_shard, 3 * per_shard + 7):  # resumed anywhere
        assert [s for s, _ in to.read_slots(index, start, stride, per_shard)] == list(range(start, len(want)))
    back = to.read_back(spark, index, stride).collect()
    assert {(r["slot"], r["ids_sha256"]) for r in back} == {
        (r["slot"], sha(records[r["slot"]][:r["n_ids"]].astype("<u2").tobytes())) for r in rows}
    assert all(r["byte_offset"] == r["record"] * stride * 2 for r in back)
    # Neighbouring sequences are far apart in training order.
    assert np.mean([abs(a["slot"] - b["slot"]) for a, b in zip(*[sorted(rows, key=lambda r: (str(r["doc_id"]), r["seq_no"]))[k:] for k in (0, 1)])]) > len(want) / 10
    none = to.round_trip(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert none.count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_against_brute_force(spark, tmp_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-duplicates", "decontamination", "personal-data", "bpe"]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"{tmp_dir}/{k}")
        out = spark.read.parquet(f"{tmp_dir}/{k}")
        before, after = docs.collect(), out.collect()
        ids = sorted(r["doc_id"] for r in after)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "toxicity":
            assert 0 < len(after) < len(before)
        if name == "near-duplicates":
            fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
            part, low = brute_components(fps.values()), {}
            for i, f in sorted(fps.items()):
                low.setdefault(part[f], i)
            assert ids == sorted(low.values())
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
            hit = brute_windows([(r["doc_id"], r["text"]) for r in before], bench)
            assert ids == sorted(r[0] for r in hit if not r[5])
        if name == "personal-data":
            assert ids == sorted(r["doc_id"] for r in before)
            assert all(not brute_spans(r["text"]) and len(r["text"]) == r["n_chars"] for r in after if "<" in r["text"])
        if name == "bpe":
            assert ids == sorted(r["doc_id"] for r in before)
            assert all(sha(bytes(r["ids"])) == r["ids_sha256"] and sha(r["decoded"]) == r["decoded_sha256"] for r in after)
        docs = out


