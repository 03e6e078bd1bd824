"""Clustering and vector codes against plain brute force."""

import hashlib
import math
import random

import numpy as np
import pytest


def vectors(n, dim, seed=3, spread=0.5, centres=9):
    rnd = random.Random(seed)
    mid = [[rnd.uniform(-2, 2) for _ in range(dim)] for _ in range(centres)]
    return [[rnd.gauss(m, spread) for m in mid[i % centres]] for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr(
        "vec_id", "embedding", "label", "'clash' AS block", "'clash' AS vectors", "'clash' AS cluster", "0 AS error")


def odd_rows(dim):
    good = [0.25] * dim
    return [(900_001, None, 1), (900_002, [], 1), (900_003, good[:-1], 1), (900_004, [None, *good[1:]], 1),
            (900_005, [float("nan"), *good[1:]], 1), (900_006, [float("inf"), *good[1:]], 1), (900_007, [1e300, *good[1:]], 1)]


def whole(rows, dim, scale):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and max(map(abs, v)) < 1e9]


def sq(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


# ---------------------------------------------------------------- clusters

def brute_clusters(rows, k, rounds, dim):
    kept = whole(rows, dim, 64)
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [r[1] for r in order[:k]]

    def nearest(v):
        return min(range(len(cent)), key=lambda c: (sq(v, cent[c]), c))

    for _ in range(rounds):
        at = [nearest(v) for _, v, _ in kept]
        for c in range(len(cent)):
            own = [r[1] for r, a in zip(kept, at) if a == c]
            if own:
                cent[c] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, nearest(v), min(sq(v, c) for c in cent)) for i, v, _ in kept]
    total = sum(d for _, _, d in out)
    per = {c: sum(d for _, x, d in out if x == c) for c in range(len(cent))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, d, per[c], total, sha[c]) for i, c, d in out), key=repr)


@pytest.mark.parametrize("spread", [0.02, 0.8])
def test_clusters_match_brute_force(spark, spread):
    from shelfcheck.llm import heap_kmeans as hk

    dim = 64
    vs = vectors(420, dim, spread=spread)
    rows = [(i, v, i % 3) for i, v in enumerate(vs)] + [(5, vs[0], 1), (None, vs[1], 1), (None, vs[7], None)]
    rows += [(2000 + i, vs[3], 0) for i in range(150)] + odd_rows(dim)
    got, cent, popped = hk.cluster(frame(spark, rows).repartition(3), k=16, rounds=3)
    got = sorted(map(tuple, hk.with_inertia(got, cent).collect()), key=repr)
    assert got == brute_clusters(rows, 16, 3, dim)
    if spread < 0.1:  # bounds hold for vectors that lie close to their centroid
        assert popped[-1] < 420


def test_clusters_of_few_and_no_vectors(spark):
    from shelfcheck.llm import heap_kmeans as hk

    rows = [(i, v, 0) for i, v in enumerate(vectors(3, 64))]
    for some in (rows[:1], rows, odd_rows(64), []):
        got, cent, _ = hk.cluster(frame(spark, some))
        assert sorted(map(tuple, hk.with_inertia(got, cent).collect())) == brute_clusters(some, 16, 3, 64)


def test_heaps_pop_only_what_expires():
    from shelfcheck.llm import heap_kmeans as hk
    from shelfcheck.llm import vector_blocks as vb

    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (600, 8))
    cent = v[:7].copy()
    heaps, drift, seen = hk.Heaps.fresh(v, cent), np.zeros(7), 0
    for step in (0, 1, 2, 9, 3):
        new = cent + rng.integers(-step, step + 1, cent.shape)
        drift, cent = drift * (1 + hk.SLACK) + hk.drifts(cent, new), new
        at, _ = heaps.advance(v, cent, drift)
        row = dict(zip(("cluster", "sizes", "keys", "positions"), heaps.dump()))
        heaps = hk.Heaps.load(row)
        assert (heaps.cluster == vb.squared(v, cent).argmin(1)).all()
        assert sum(row["sizes"]) == 600
        seen += len(at)
        assert step or not len(at)
    assert 0 < seen < 5 * 600


# ---------------------------------------------------------------- vector codes

def brute_codes(rows, parts, entries, rounds, dim):
    kept, w = whole(rows, dim, 256), dim // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(r[1], p) for r in order] for p in range(parts)]

    def nearest(p, x):
        return min(range(len(books[p])), key=lambda e: (sq(x, books[p][e]), e))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(p, cut(v, p)), []).append(cut(v, p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    out, by = [], {}
    for i, v, label in kept:
        code = [nearest(p, cut(v, p)) for p in range(parts)]
        err = sum(sq(cut(v, p), books[p][e]) for p, e in enumerate(code))
        by[label] = by.get(label, 0) + err
        out.append((i, "".join(f"{e:02x}" for e in code), err, label))
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=repr)


def test_codes_match_brute_force(spark):
    from shelfcheck.llm import cover_codes as cc

    dim = 64
    vs = vectors(260, dim, spread=0.3)
    rows = [(i, v, [0, 1, None][i % 3]) for i, v in enumerate(vs)] + [(5, vs[0], 1), (None, vs[1], 1), (None, vs[7], None)]
    rows += [(2000 + i, vs[3], 0) for i in range(120)] + odd_rows(dim)
    got = cc.with_label_error(*cc.compress(frame(spark, rows).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows, 16, 64, 2, dim)


def test_labels_of_any_type(spark):
    from shelfcheck.llm import cover_codes as cc

    rows = [(i, v, ["a", "", None][i % 3]) for i, v in enumerate(vectors(30, 64))]
    coded, books = cc.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"))
    assert {r["vec_id"]: r["label"] for r in coded.collect()} == {i: x for i, _, x in rows}
    assert sorted(map(tuple, cc.with_label_error(coded, books).collect()), key=repr) == brute_codes(rows, 16, 64, 2, 64)


def test_codes_of_few_and_no_vectors(spark):
    from shelfcheck.llm import cover_codes as cc

    rows = [(i, v, 0) for i, v in enumerate(vectors(5, 64))]
    for some in (rows, odd_rows(64), []):
        got = cc.with_label_error(*cc.compress(frame(spark, some)))
        assert sorted(map(tuple, got.collect())) == brute_codes(some, 16, 64, 2, 64)


def test_cover_trees_assign_exactly():
    from shelfcheck.llm import cover_codes as cc
    from shelfcheck.llm import vector_blocks as vb

    rng = np.random.default_rng(4)
    for points in (rng.integers(-60, 60, (3000, 4)), np.repeat(rng.integers(-5, 5, (40, 4)), 30, axis=0),
                   np.zeros((20, 4), np.int64), rng.integers(-9, 9, (1, 4)), rng.integers(0, 2, (500, 2)) * 1000):
        order, nodes = cc.cover_tree(points)
        assert sorted(order.tolist()) == list(range(len(points)))
        for node in nodes:  # radius and ranges hold
            own = points[order[node["start"]:node["end"]]]
            assert ((own - points[node["point"]]) ** 2).sum(1).max() <= node["radius"] ** 2 * (1 + 1e-9)
            kids = nodes[node["child"]:node["child"] + node["kids"]]
            if len(kids):
                assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"]
                assert (kids["start"][1:] == kids["end"][:-1]).all() and (kids["radius"] <= node["radius"] / 2 + 1e-9).all()
        entries = np.concatenate([points[:30], points[:5]])  # repeated entries: ties
        code, sums, counts = cc.walk(points, order, nodes, entries)
        want = vb.squared(points, entries).argmin(1)
        assert (code == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        assert (sums == np.array([points[want == e].sum(0) for e in range(len(entries))])).all()


def test_blocks_keep_every_vector(spark):
    from shelfcheck.llm import cover_codes as cc
    from shelfcheck.llm import vector_blocks as vb

    rows = [(i, v, 0) for i, v in enumerate(vectors(50, 64))]
    kept = frame(spark, rows).coalesce(1).select("vec_id", vb.integers("embedding", 4).alias("vector"))
    out = vb.to_blocks(kept, 64, size=7).collect()
    assert len({r["block"] for r in out}) == 8
    assert [x for r in out for x in r["ids"]] == list(range(50))
    assert np.concatenate([vb.unpack(r["vectors"], 64) for r in out]).tolist() == [
        [math.floor(4 * x) for x in v] for _, v, _ in rows]
    with pytest.raises(ValueError):
        cc.compress(frame(spark, rows), parts=7)
