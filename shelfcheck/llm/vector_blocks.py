"""Vectors as blocks: one row holds the ids of up to ``ROWS`` vectors and their integer
components, so that a task can work on many vectors at once with bounded memory.

A component x becomes floor(scale * x) of x as a double. Vectors that are null, have another
length or hold null or non-finite components take no part; nor do vectors with a component
beyond ``LIMIT`` after scaling, as their squared distances would not fit a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcheck.llm.util import prepare

ROWS = 4096
LIMIT = 1 << 26
BLOCK = "block long, ids array<long>, vectors binary"


def usable(vector: Column, dim: int, scale: int) -> Column:
    """Vectors that take part (never null)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale >= float(LIMIT)))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def to_blocks(rows: DataFrame, dim: int, carry: str = "", fields: str = "", build=None, size: int = ROWS) -> DataFrame:
    """Blocks of ``rows`` (vec_id long, vector array<int>, and the ``carry`` column, a text),
    in scan order, with what ``build(vectors)`` makes of a block's vectors (``fields``, DDL).

    A block's number holds its partition's, so a task that runs again numbers alike.
    """
    prepare(rows.sparkSession)
    names = ["vec_id", "vector"] + ([carry] if carry else [])
    schema = T._parse_datatype_string(
        BLOCK + (f", {carry} array<string>" if carry else "") + (f", {fields}" if fields else ""))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        base, done, kept, held = TaskContext.get().partitionId() << 32, 0, [], 0

        def block(b):
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.int32).reshape(-1, dim)
            out = [[base + done], [b.column(0).to_pylist()], [v.tobytes()]]
            out += [[b.column(2).to_pylist()]] if carry else []
            out += [[x] for x in build(v.astype(np.int64))] if build else []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, want)], schema=want)

        for b in batches:
            while b.num_rows:
                kept.append(b.slice(0, size - held))
                held += kept[-1].num_rows
                b = b.slice(kept[-1].num_rows)
                if held == size:
                    yield block(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                    done, kept, held = done + 1, [], 0
        if held:
            yield block(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return rows.select(*names).mapInArrow(run, schema)


def unpack(data: bytes, dim: int):
    """The (n, dim) integer matrix of a block."""
    import numpy as np

    return np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.int64)


def squared(a, b):
    """Exact squared Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def total(parts: DataFrame, column: str, n: int) -> list[int]:
    """Sum by position of an array column of ``n`` longs: n rows reach the driver."""
    out = [0] * n
    for r in (parts.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()):
        out[r["at"]] = r["x"]
    return out
