"""Shared plumbing: shipping the package, written intermediate tables, Arrow row maps."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfcheck.session import scratch_path

# Rows per Arrow batch. Texts can be long, so batches stay small; whole texts are
# processed whatever their length, one batch at a time.
BATCH_ROWS = 512

_WORDS = bytes(i + 32 if 65 <= i <= 90 else
               i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


# What the operator now running in this Python worker has built (automaton, codec, weights).
_STATE: dict = {}


def worker_state(key, build: Callable):
    """``build()``, kept in this worker until another operator needs its memory."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]


def free_worker_state() -> None:
    """For maps without a state of their own: let go of the last operator's."""
    _STATE.clear()


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and bound the Arrow batches of this session."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfcheck_shipped", None) is None:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="shelfcheck-ship-"), "shelfcheck_pkg.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(archive)
        sc._shelfcheck_shipped = archive
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor costs a re-read, not a recomputation) and gives later
    joins a plain scan, so that adaptive execution can split their skewed partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def words_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text, in UTF-8.

    Every separator is ASCII, so splitting the UTF-8 bytes splits the characters. A null
    has no words.
    """
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def map_text(df: DataFrame, text_col: str, keep: list[str], out: str,
             make: Callable[[], Callable[[list], list[tuple | None]]], stateful: bool = True) -> DataFrame:
    """Per row of ``df``: ``keep`` columns plus the ``out`` fields computed from the text.

    ``make()`` runs once per task and returns a function from a list of texts (None for
    null) to one tuple per text, or None to leave the row out. No shuffle; one Arrow
    batch is held at a time. ``stateful=False``: ``make`` keeps no ``worker_state``.
    """
    spark = df.sparkSession
    prepare(spark)
    extra = T._parse_datatype_string(out)
    clash = {f.name for f in extra.fields} & set(keep)
    if clash:
        raise ValueError(f"output columns clash with kept columns: {sorted(clash)}")
    src = df.select(*[df[c] for c in keep], df[text_col].alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + list(extra.fields))
    n_keep, n_out = len(keep), len(extra.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        if not stateful:
            free_worker_state()
        fn = make()
        for b in batches:
            rows = fn(b.column(n_keep).to_pylist())
            kept = [b.column(i) for i in range(n_keep)]
            if any(r is None for r in rows):
                at = pa.array([i for i, r in enumerate(rows) if r is not None], pa.int32())
                kept = [c.take(at) for c in kept]
                rows = [r for r in rows if r is not None]
            cols = list(zip(*rows)) if rows else [()] * n_out
            made = [pa.array(c, want.field(n_keep + i).type) for i, c in enumerate(cols)]
            kept = [c.cast(want.field(i).type) if c.type != want.field(i).type else c
                    for i, c in enumerate(kept)]
            yield pa.RecordBatch.from_arrays(kept + made, names=want.names)

    return src.mapInArrow(run, schema)
