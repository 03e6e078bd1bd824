"""Vector codes: every vector is cut into equal parts, and each part becomes the number of the
nearest entry in its position's codebook, trained by Lloyd's rounds over cover trees.

Each block of vectors carries one cover tree per part position. A node stands for a point and
covers all points within its radius; its children are points more than half that radius
apart, which cover halves of it, down to leaves of a few points or one repeated point. The
points lie in tree order, so every subtree is a range, and cumulative sums of the points give
any subtree's sum by one subtraction. A round walks the trees level by level: an entry
farther from a node's point than the nearest entry by more than twice the radius can be
nearest to nothing below (triangle inequality); a node left with one entry gives its whole
subtree to it, others pass their entries on to their children, and only leaves that are still
ambiguous compare their points exactly.

Components are integers: distances, sums and floors are exact. The square roots in the bounds
are rounded so that ties and near ties descend.

Trees are built once and written beside the vectors; a round is a map over the blocks that
yields one sum and count per part, entry and component for each partition, and only their
totals reach the driver (parts * entries * (width + 1) numbers).

Defined cases: see vector_blocks for vectors that take no part (``dim`` states the length);
first entries are the parts of the ``entries`` smallest vec_ids (nulls last; equal ids by
components), fewer vectors give fewer entries; unused entries stay; ties go to the lower
number; repeated vec_ids are vectors of their own; null labels form one group; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.llm import vector_blocks as vb
from shelfcheck.llm.util import materialize, prepare

DIM, SCALE, PARTS, ENTRIES, ROUNDS = 64, 256, 16, 64, 2
LEAF = 8
# Nodes level by level; children of a node stand together. kids is 0 for a leaf.
NODE = [("point", "i4"), ("start", "i4"), ("end", "i4"), ("radius", "f8"), ("child", "i4"), ("kids", "i4")]
TREES = "orders binary, nodes array<binary>"


def cover_tree(points):
    """(order, nodes): the points' tree order and the nodes of a cover tree over them."""
    import numpy as np

    n = len(points)
    order, starts, ends = np.arange(n), np.array([0]), np.array([n])
    centres = np.array([0])  # position of each group's point, a point of the group
    levels, base = [], 0
    while True:
        sizes = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        group = np.repeat(np.arange(len(starts)), sizes)
        own = order[at]
        d = ((points[own] - points[centres[group]]) ** 2).sum(1)
        far = np.maximum.reduceat(d, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        nodes = np.zeros(len(starts), NODE)
        nodes["point"], nodes["start"], nodes["end"], nodes["radius"] = centres, starts, ends, np.sqrt(far.astype(np.float64))
        levels.append(nodes)
        split = (far > 0) & (sizes > LEAF)
        # Cover what is to be split: the node's own point first, then the first point left over.
        live = split[group]
        at, group, own = at[live], group[live], own[live]
        child = np.full(len(at), -1)
        limit, made, made_group = far[group], [], []
        left, first = np.arange(len(at)), True
        while len(left):
            g = group[left]
            if first:
                heads = np.unique(g)
                pick = centres[heads]
            else:
                heads, where = np.unique(g, return_index=True)
                pick = own[left[where]]
            number = len(made) + np.searchsorted(heads, g)
            near = ((points[own[left]] - points[pick[np.searchsorted(heads, g)]]) ** 2).sum(1) * 4 <= limit[left]
            child[left[near]] = number[near]
            made.extend(pick.tolist())
            made_group.extend(heads.tolist())
            left, first = left[~near], False
        if not made:
            return order.astype(np.int32), np.concatenate(levels)
        # Children of a node follow each other in the order in which they were picked.
        made_group = np.array(made_group)
        rank = np.argsort(made_group, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        sort = np.argsort(place[child], kind="stable")
        order[at] = own[sort]
        counts = np.bincount(place[child], minlength=len(rank))
        kids = np.bincount(made_group, minlength=len(starts))
        first_kid = base + len(starts) + np.concatenate([[0], np.cumsum(kids)[:-1]])
        nodes["kids"], nodes["child"] = kids, np.where(kids > 0, first_kid, 0)
        base += len(starts)
        within = np.concatenate([[0], np.cumsum(counts)[:-1]])
        parent_first = np.concatenate([[0], np.cumsum(np.bincount(made_group[rank], counts, len(starts)).astype(np.int64))[:-1]])
        parents = made_group[rank]
        starts = nodes["start"][parents] + (within - parent_first[parents])
        ends = starts + counts
        centres = np.array(made)[rank]


def walk(points, order, nodes, entries):
    """(code of every point, sums, counts): the nearest entry, subtree by subtree."""
    import numpy as np

    k = len(entries)
    sorted_points = points[order]
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(sorted_points, axis=0)])
    codes = np.empty(len(points), np.int16)  # in tree order
    sums, counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
    at, may = np.array([0]), np.ones((1, k), bool)
    while len(at):
        node = nodes[at]
        d = np.sqrt(vb.squared(points[node["point"]], entries).astype(np.float64))
        d[~may] = np.inf
        least = d.min(1)
        may &= d * (1 - 1e-12) <= (least + 2 * node["radius"])[:, None] * (1 + 1e-12)
        sole = may.sum(1) == 1
        for n, c in zip(node[sole], d[sole].argmin(1)):
            codes[n["start"]:n["end"]] = c
        np.add.at(sums, d[sole].argmin(1), total[node["end"][sole]] - total[node["start"][sole]])
        np.add.at(counts, d[sole].argmin(1), (node["end"] - node["start"])[sole])
        leaf = ~sole & (node["kids"] == 0)
        if leaf.any():
            size = (node["end"] - node["start"])[leaf]
            where = np.repeat(node["start"][leaf] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            exact = vb.squared(sorted_points[where], entries)
            exact[~np.repeat(may[leaf], size, axis=0)] = np.iinfo(np.int64).max
            code = exact.argmin(1)
            codes[where] = code
            np.add.at(sums, code, sorted_points[where])
            counts += np.bincount(code, minlength=k)
        down = ~sole & (node["kids"] > 0)
        kids = node["kids"][down]
        at = np.repeat(node["child"][down] - np.concatenate([[0], np.cumsum(kids)[:-1]]), kids) + np.arange(kids.sum()) \
            if len(kids) else np.empty(0, np.int64)
        may = np.repeat(may[down], kids, axis=0)
    out = np.empty(len(points), np.int16)
    out[order] = codes
    return out, sums, counts


def trees_of(parts: int):
    """For ``vector_blocks.to_blocks``: the trees of a block's vectors."""
    def build(vectors):
        import numpy as np

        made = [cover_tree(p) for p in np.split(vectors, parts, axis=1)]
        return np.concatenate([o for o, _ in made]).tobytes(), [t.tobytes() for _, t in made]
    return build


def _walk_block(row: dict, books, dim: int):
    """Per part: (points, codes, sums, counts)."""
    import numpy as np

    v = vb.unpack(row["vectors"], dim)
    parts = len(books)
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, len(v))
    for p, points in enumerate(np.split(v, parts, axis=1)):
        yield points, *walk(points, orders[p], np.frombuffer(row["nodes"][p], NODE), books[p])


def _rows(batches, columns):
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(j)[i].as_py() for j, c in enumerate(columns)}


def _round(blocks: DataFrame, books, dim: int) -> DataFrame:
    """Sums and counts per part, entry and component: one flat array per partition."""
    prepare(blocks.sparkSession)
    frame = blocks.select("vectors", "orders", "nodes")
    columns = frame.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        whole = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for row in _rows(batches, columns):
            for p, (_, _, sums, counts) in enumerate(_walk_block(row, books, dim)):
                whole[p, :, :-1] += sums
                whole[p, :, -1] += counts
        yield pa.RecordBatch.from_arrays([pa.array([whole.ravel().tolist()], pa.list_(pa.int64()))], names=["sums"])

    return frame.mapInArrow(run, "sums array<long>")


def _coded(blocks: DataFrame, books, dim: int) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    prepare(blocks.sparkSession)
    frame = blocks.select("ids", "label", "vectors", "orders", "nodes")
    columns = frame.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for row in _rows(batches, columns):
            codes, error = [], np.zeros(len(row["ids"]), np.int64)
            for p, (points, code, _, _) in enumerate(_walk_block(row, books, dim)):
                codes.append(code.astype(np.uint8))
                error += ((points - books[p][code]) ** 2).sum(1)
            text = [x.tobytes().hex() for x in np.stack(codes, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["label"], pa.string()), pa.array(text), pa.array(error)],
                names=["vec_id", "label", "code", "error"])

    return frame.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             dim: int = DIM, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"):
    """Returns (frame, codebooks): (vec_id, label, code, error) per vector and the final
    (parts, entries, dim / parts) integer codebooks."""
    import numpy as np

    if dim % parts or not 0 < entries <= 256:
        raise ValueError("dim must be a multiple of parts, and entries fit a byte")
    spark, width, v, kind = rows.sparkSession, dim // parts, rows[vector], rows.schema[label].dataType
    kept = rows.where(vb.usable(v, dim, scale)).select(
        rows[vec_id].cast("long").alias("vec_id"), vb.integers(v, scale).alias("vector"), rows[label].cast("string").alias("label"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        none = spark.createDataFrame([], "vec_id long, label string, code string, error long")
        return none.withColumn("label", F.col("label").cast(kind)), np.zeros((parts, 0, width), np.int64)
    books = np.stack(np.split(np.array([r["vector"] for r in first], np.int64), parts, axis=1))
    blocks = materialize(vb.to_blocks(kept, dim, "label", TREES, trees_of(parts)), "cover-trees")
    shape = (*books.shape[:2], width + 1)
    for _ in range(rounds):
        by = np.array(vb.total(_round(blocks, books, dim), "sums", int(np.prod(shape))), np.int64).reshape(shape)
        books = np.where(by[..., -1:] > 0, by[..., :-1] // np.maximum(by[..., -1:], 1), books)
    coded = _coded(blocks, books, dim).withColumn("label", F.col("label").cast(kind))
    return materialize(coded, "codes"), books


def with_label_error(coded: DataFrame, books) -> DataFrame:
    """Adds the error summed over equal labels and the codebooks' digest. Sums are written
    before they are joined back, so that a label that holds many rows can be split."""
    text = ",".join(str(x) for x in books.ravel().tolist())
    none, value = F.col("label").isNull(), F.coalesce(F.col("label").cast("string"), F.lit(""))
    keyed = coded.select("vec_id", "code", "error", none.alias("none"), value.alias("value"))
    sums = materialize(keyed.groupBy("none", "value").agg(F.sum("error").alias("label_error")), "label-errors")
    return keyed.join(sums, ["none", "value"], "left").select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
