"""Approximate nearest neighbours by collision counting over sorted projections.

Largest inner product becomes smallest distance: candidates are scaled by the largest norm of
their block and lifted onto the unit sphere by one more coordinate, queries are scaled to
norm 1. Blocks hold vectors of like norm, so that the lift tells their directions apart. Each
of ``m`` random directions has one array of the candidates sorted by their projection. For
a query, windows centred on its own projections grow level by level (virtual rehashing:
half-width ``WIDTH`` times the radius of the level), and a candidate whose place in an array
lies within the window collides there. A candidate with at least ``collisions`` of m
collisions is verified on the original vectors. The search ends at the first radius that
holds k verified candidates, or when the windows hold everything; there is no cap on
candidates. As both only grow with the radius, the first such level is found by stepping up or
down from the level at which the query before ended.

A candidate nearer than the final radius has the needed collisions with probability
``RECALL`` or more, which sets the threshold. The directions are orthogonal, so collisions are
less spread than independent ones would be: what they say of a vector beyond its length, and
the threshold is the higher for it.

The query set meets all rows in blocks: candidates are dealt into blocks of BLOCK_BYTES and
queries into parts of QUERY_BYTES, one task per pair of block and part holds both, builds the
block's arrays once and returns k rows per query, and the best k of all blocks are ranked per
query. The projections use no data; only largest norms and row counts per class of like
norms come from the input.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part on either side; a vector meets only vectors of its own length; a repeated vec_id or
vector is a candidate like any other, and a query leaves out its own row alone; rows with a
null vec_id are candidates (last among ties) and never queries; with fewer than k
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcheck.llm.util import materialize, prepare

K = 20
M = 64            # projections
WIDTH = 1.6       # half-width of a window at radius 1
RECALL = 0.9     # chance that a candidate at the final radius is verified
FIRST, RATIO = 0.02, 1.03
BLOCK_BYTES, QUERY_BYTES = 8 << 20, 8 << 20  # of components as doubles
MAX_BLOCK = 1 << 15  # places in an array fit 16 bits
NORM_STEP = 1.05     # norms of one class are within this factor
SEED = 20_240_229

FOUND = "query long, query_id long, vec_id long, score double"


def collisions(dim: int, m: int = M, width: float = WIDTH, recall: float = RECALL) -> int:
    """Collision threshold of lifted vectors of ``dim`` components: reached with probability
    ``recall`` at the window's radius.

    A projection collides with probability p. Directions that fill the space add up to the
    distance itself, which is given: of the variance of a count that part goes which collisions
    share with the squared projections, by as much of the space as a group of directions fills.
    """
    p = erf(width / sqrt(2))
    shared = (2 * width * exp(-width * width / 2) / sqrt(2 * pi)) ** 2 / (2 * p * (1 - p))
    groups = [dim] * (m // dim) + [m % dim]
    spread = sum(g * p * (1 - p) * (1 - shared * g / dim) for g in groups)
    return max(1, int(m * p + NormalDist().inv_cdf(1 - recall) * sqrt(spread)))


def directions(dim: int, m: int = M, seed: int = SEED):
    """m random directions, orthogonal in groups of ``dim``."""
    import numpy as np

    rng = np.random.default_rng([seed, dim])
    out = []
    while sum(len(x) for x in out) < m:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append((q * np.sign(np.diag(r))).T * sqrt(dim))
    return np.concatenate(out)[:m]


class Arrays:
    """One block of candidates: a sorted array per projection, and every candidate's place in it."""

    def __init__(self, rows, ids, vectors, top: float):
        import numpy as np

        self.rows, self.ids, self.vectors, self.top = rows, ids, vectors, top
        unit = vectors / top
        lift = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        self.a = directions(vectors.shape[1] + 1)
        self.need = collisions(vectors.shape[1] + 1)
        h = (np.concatenate([unit, lift[:, None]], axis=1) @ self.a.T).T
        order = np.argsort(h, axis=1, kind="stable")
        self.place = np.empty(h.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(rows), dtype=np.uint16)[None, :], axis=1)
        # All arrays in one: array i is shifted by i times more than any projection.
        self.shift = np.arange(len(h))[:, None] * (4 * sqrt(h.shape[0] + vectors.shape[1] + 1) + 64 * FIRST)
        self.sorted = (np.take_along_axis(h, order, axis=1) + self.shift).ravel()
        self.start = np.arange(len(h)) * len(rows)
        self.single = vectors.astype(np.float32)
        self.reach = sqrt(vectors.shape[1] + 1)  # of a projection
        self.levels = ceil(log(2 * self.reach / (WIDTH * FIRST)) / log(RATIO)) + 1
        self.level, self.verified = self.levels // 2, 0
        self.inside, self.hit = np.empty_like(self.place), np.empty(self.place.shape, bool)

    def _collided(self, h, radius: float):
        """Candidates with enough collisions at a radius."""
        import numpy as np

        half = min(WIDTH * radius, 2 * self.reach)
        edges = np.searchsorted(self.sorted, np.concatenate([h - half, h + half], axis=1).ravel() + np.repeat(self.shift, 2))
        low, high = (edges.reshape(-1, 2) - self.start[:, None]).T
        np.subtract(self.place, low.astype(np.uint16)[:, None], out=self.inside)
        np.less(self.inside, (high - low).astype(np.uint16)[:, None], out=self.hit)
        return np.flatnonzero(np.add.reduce(self.hit.view(np.uint8), axis=0, dtype=np.uint8) >= self.need)

    def search(self, queries, own, k: int):
        """Positions and scores of the k best found per query."""
        import numpy as np

        norms = np.sqrt((queries * queries).sum(axis=1))
        projected = (queries / norms[:, None]) @ self.a[:, :-1].T
        for q, vector in enumerate(queries):
            single, done = vector.astype(np.float32), {}

            def ends(level: int) -> bool:
                """Whether the search ends at this level or before."""
                if level not in done:
                    radius = FIRST * RATIO ** level
                    at = self._collided(projected[q][:, None], radius)
                    self.verified += len(at)
                    at = at[self.rows[at] != own[q]]
                    score = self.single[at] @ single
                    last = level >= self.levels
                    if len(score) >= k and not last:
                        kth = np.partition(score, len(score) - k)[len(score) - k]
                        last = sqrt(max(0.0, 2.0 - 2.0 * float(kth) / (norms[q] * self.top))) <= radius
                    done[level] = last, at, score
                return done[level][0]

            level = self.level
            if ends(level):
                while level > 0 and ends(level - 1):
                    level -= 1
            else:
                while not ends(level):
                    level += 1
            self.level = level
            _, at, score = done[level]
            if len(at) > k:  # all that may be among the best k in double precision
                kth = np.partition(score, len(score) - k)[len(score) - k]
                at = at[score >= kth - 1e-4 * (1 + abs(kth))]
            yield at, exact(self.vectors[at], vector)


def exact(vectors, query):
    """Inner products in double precision, summed in component order."""
    import numpy as np

    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * query[j]
    return total


def usable(v) -> "F.Column":
    """Vectors that take part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def search(candidates: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
           block: int | None = None, queries: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row that ``is_query``
    (a Column over ``vec_id``) selects, among all other rows. ``block`` and ``queries`` are
    rows of a block and of a part, where not as many as their bytes hold."""
    spark = candidates.sparkSession
    prepare(spark)
    v = candidates[vector].cast("array<double>")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = materialize(
        candidates.select(F.monotonically_increasing_id().alias("row"), candidates[vec_id].cast("long").alias("vec_id"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query"), v.alias("vector"))
        .where(usable(F.col("vector"))).select("*", F.size("vector").alias("dim"), norm.alias("norm"))
        .withColumn("class", F.floor(F.log("norm") / log(NORM_STEP)).cast("long")), "vectors")
    sizes = rows.groupBy("dim", "class").agg(  # one row per vector length and class of norms
        F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q"), F.max("norm").alias("top")).collect()
    out = None
    for dim in sorted({s["dim"] for s in sizes}):
        mine = [s for s in sizes if s["dim"] == dim]
        asked = sum(s["q"] for s in mine)
        if asked:
            part = _search_dim(rows.where(F.col("dim") == dim), mine, asked, k,
                               block or max(1, min(MAX_BLOCK, BLOCK_BYTES // (8 * dim))), queries or max(1, QUERY_BYTES // (8 * dim)))
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search_dim(rows: DataFrame, sizes, asked: int, k: int, block: int, queries: int) -> DataFrame:
    classes, blocks = [], 0
    for s in sorted(sizes, key=lambda s: s["class"]):
        own = -(-s["n"] // block)
        # A block is dealt by hash and may hold somewhat more than its share.
        classes.append((s["class"], blocks, own, s["top"]))
        blocks += own
    parts = -(-asked // queries)
    dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(classes, "class long, first int, own int, top double")), "class")
    slot = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    left = dealt.select("row", "vec_id", "vector", "top", (F.col("first") + slot(F.col("own"))).alias("b"),
                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    right = rows.where("is_query").select(*[F.col(c).alias(c) for c in ("row", "vec_id", "vector")], slot(F.lit(parts)).alias("p"),
                                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def pair(cands, asked):
        import numpy as np
        import pandas as pd

        if not len(cands) or not len(asked):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        arrays = Arrays(cands["row"].to_numpy(), cands["vec_id"], np.stack(cands["vector"]), cands["top"].iloc[0])
        none, ids = cands["vec_id"].isna().to_numpy(), cands["vec_id"].fillna(0).to_numpy(np.int64)
        found = []
        for i, (at, score) in enumerate(arrays.search(np.stack(asked["vector"]), asked["row"].to_numpy(), k)):
            best = np.lexsort((ids[at], none[at], -score))[:k]  # nulls last among ties
            found.append((np.full(len(best), i), at[best], score[best]))
        q, at, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query": asked["row"].to_numpy()[q], "query_id": asked["vec_id"].to_numpy()[q],
                             "vec_id": pd.Series(ids[at], dtype="Int64").mask(none[at]), "score": score})

    return left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(pair, FOUND)
