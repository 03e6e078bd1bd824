"""Centroid clustering: Lloyd's rounds with heap-ordered bounds.

Every block of vectors keeps one heap per cluster. A vector enters its cluster's heap with
the gap between its second nearest and its nearest centroid, plus the drift that the cluster
has accumulated by then; a cluster's drift grows each round by the way its own centroid
moved plus the longest way of any other. As long as a vector's key exceeds its cluster's
drift, no other centroid can have become nearer. So a round pops only what lies at or below
the drift, rescans just these vectors exactly against all centroids, and pushes them again;
the sums of the centroids change by the vectors that moved.

Components and centroids are integers: distances and sums are exact, and the bounds, which
are floating point, are rounded against the vector, so results equal a full rescan.

Blocks are written once, bucketed by block number; a round writes only the heaps, bucketed
alike, and the next one joins them block by block without shuffling vectors. What reaches the
driver each round is one sum and count per cluster and dimension.

Defined cases: see vector_blocks for vectors that take no part; first centroids are the k
vectors whose ``seed_key`` comes first (nulls last; equal keys by components), fewer vectors
give fewer centroids; an emptied cluster keeps its centroid; ties go to the smaller number;
repeated vec_ids are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcheck.llm import vector_blocks as vb
from shelfcheck.sources.bucketed import Bucketed
from shelfcheck.llm.util import materialize, prepare
from shelfcheck.session import scratch_path

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
# Heaps of a block, cluster after cluster: entries per cluster, then (key, position) of each.
STATE = "block long, cluster binary, sizes array<int>, keys binary, positions binary, sums array<long>, popped long"
SLACK = 1e-9  # relative room for the rounding of square roots and drift sums


def seed_hash(vec_id: Column | str = "vec_id") -> Column:
    """Order of the first centroids: SHA-256 of ``1:<vec_id>``."""
    return F.sha2(F.concat(F.lit("1:"), F.col(vec_id).cast("string")), 256)


def nearest(vectors, centroids):
    """(cluster, gap): the nearest centroid, and how much farther the second is, rounded down."""
    import numpy as np

    d = vb.squared(vectors, centroids)
    cluster = d.argmin(1)
    if len(centroids) == 1:
        return cluster, np.full(len(vectors), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return cluster, (two[:, 1] - two[:, 0]) - SLACK * (1 + two.sum(1))


def drifts(old, new):
    """Per cluster: own way plus the longest way of another, rounded up."""
    import numpy as np

    way = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
    return np.array([w + max([*way[:c], *way[c + 1:]], default=0.0) for c, w in enumerate(way)])


class Heaps:
    """One block's heaps and the cluster of every vector."""

    def __init__(self, k: int, cluster, heaps):
        self.k, self.cluster, self.heaps = k, cluster, heaps

    @classmethod
    def fresh(cls, vectors, centroids):
        import numpy as np

        cluster, gap = nearest(vectors, centroids)
        heaps = []
        for c in range(len(centroids)):
            at = np.flatnonzero(cluster == c)
            at = at[np.argsort(gap[at], kind="stable")]  # a sorted list is a heap
            heaps.append(list(zip(gap[at].tolist(), at.tolist())))
        return cls(len(centroids), cluster.astype(np.int16), heaps)

    @classmethod
    def load(cls, row: dict):
        import numpy as np

        keys, at = np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["positions"], np.int32).tolist()
        heaps, done = [], 0
        for n in row["sizes"]:
            heaps.append(list(zip(keys[done:done + n], at[done:done + n])))
            done += n
        return cls(len(heaps), np.frombuffer(row["cluster"], np.int16).copy(), heaps)

    def advance(self, vectors, centroids, drift):
        """One round: pop the expired, rescan them, push them. Returns (popped positions, their
        former clusters)."""
        from heapq import heappop, heappush

        import numpy as np

        popped = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                popped.append(heappop(heap)[1])
        at = np.array(popped, np.int64)
        before = self.cluster[at].copy()
        if len(at):
            cluster, gap = nearest(vectors[at], centroids)
            self.cluster[at] = cluster
            for i, c, g in zip(popped, cluster.tolist(), (gap + drift[cluster]).tolist()):
                heappush(self.heaps[c], (g, i))
        return at, before

    def dump(self):
        import numpy as np

        flat = [e for h in self.heaps for e in h]
        return (self.cluster.tobytes(), [len(h) for h in self.heaps],
                np.array([e[0] for e in flat], np.float64).tobytes(), np.array([e[1] for e in flat], np.int32).tobytes())


def sums(vectors, cluster, k: int):
    """Component sums and counts per cluster, flat: k * (dim + 1) integers."""
    import numpy as np

    out = np.zeros((k, vectors.shape[1] + 1), np.int64)
    for c in np.unique(cluster):
        own = vectors[cluster == c]
        out[c, :-1], out[c, -1] = own.sum(0), len(own)
    return out.ravel()


def _rounds(frame: DataFrame, centroids, drift, dim: int) -> DataFrame:
    """Heaps after a round over ``frame``: blocks alone (all vectors are scanned), or blocks
    joined with their heaps (the expired are). ``sums`` holds what changed."""
    prepare(frame.sparkSession)
    columns, schema = frame.columns, T._parse_datatype_string(STATE)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i].as_py() for j, c in enumerate(columns)}
                v = vb.unpack(row["vectors"], dim)
                if "keys" in row:
                    heaps = Heaps.load(row)
                    at, before = heaps.advance(v, centroids, drift)
                    change = sums(v[at], heaps.cluster[at], heaps.k) - sums(v[at], before, heaps.k)
                else:
                    heaps, at = Heaps.fresh(v, centroids), v
                    change = sums(v, heaps.cluster, heaps.k)
                out = (row["block"], *heaps.dump(), change.tolist(), len(at))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, want)], schema=want)

    return frame.mapInArrow(run, schema)


def _assigned(frame: DataFrame, centroids, drift, dim: int) -> DataFrame:
    """(vec_id, cluster, distance) after a last round over blocks joined with their heaps."""
    prepare(frame.sparkSession)
    columns = frame.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i].as_py() for j, c in enumerate(columns)}
                v, heaps = vb.unpack(row["vectors"], dim), Heaps.load(row)
                heaps.advance(v, centroids, drift)
                d = ((v - centroids[heaps.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(heaps.cluster, pa.int32()), pa.array(d, pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    return frame.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed_key: Column | None = None,
            vec_id: str = "vec_id", vector: str = "embedding"):
    """Returns (frame, centroids, popped): (vec_id, cluster, distance) per vector, the final
    centroids, and how many vectors each round after the first rescanned."""
    import numpy as np

    spark = rows.sparkSession
    v = rows[vector]
    kept = rows.where(vb.usable(v, dim, scale)).select(
        rows[vec_id].cast("long").alias("vec_id"), vb.integers(v, scale).alias("vector"))
    key = seed_hash() if seed_key is None else seed_key
    first = kept.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64), []
    centroids = np.array([r["vector"] for r in first], np.int64)
    k = len(centroids)

    home = scratch_path(spark, "llm", f"clusters-{uuid.uuid4().hex}")
    blocks = Bucketed.open(spark, f"{home}/blocks", vb.BLOCK, "block")
    blocks.append(vb.to_blocks(kept, dim))

    def with_heaps(state: Bucketed) -> DataFrame:
        # The heaps of a bucket are a few per cent of its vectors: they are the hashed side.
        heaps = state.frame().select("block", "cluster", "sizes", "keys", "positions").hint("shuffle_hash")
        return blocks.frame().join(heaps, "block")

    drift, totals, popped, state = np.zeros(k), np.zeros(k * (dim + 1), np.int64), [], None
    for r in range(rounds):
        frame = blocks.frame() if state is None else with_heaps(state)
        state = Bucketed.open(spark, f"{home}/round-{r}", STATE, "block", blocks.buckets)
        state.append(_rounds(frame, centroids, drift, dim), placed=r > 0)
        totals += np.array(vb.total(state.frame(), "sums", k * (dim + 1)), np.int64)
        if r:
            popped.append(state.frame().agg(F.sum("popped")).first()[0])
        by = totals.reshape(k, dim + 1)
        moved = np.where(by[:, -1:] > 0, by[:, :-1] // np.maximum(by[:, -1:], 1), centroids)
        drift = drift * (1 + SLACK) + drifts(centroids, moved)
        centroids = moved
    if state is None:
        raise ValueError("at least one round")
    return materialize(_assigned(with_heaps(state), centroids, drift, dim), "clusters"), centroids, popped


def with_inertia(assigned: DataFrame, centroids) -> DataFrame:
    """Adds the distance summed per cluster and over all, and each centroid's digest: k rows
    are broadcast."""
    spark = assigned.sparkSession
    by = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, by.get(c, 0), sum(by.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest())
            for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
