"""Training-order materialisation of token ids.

Every document's ids, closed by an end token, are cut into sequences of ``stride`` ids (the
last one padded with the end token). Sequences are numbered 0..N-1 in scan order, a keyed
Feistel network with cycle-walking permutes the numbers into global slots, and slot s goes
to record ``s % per_shard`` of shard ``s // per_shard``: shards are ranges of slots, written
as fixed-stride little-endian 16-bit records, so any slot is found by arithmetic and a
reader can stop and resume anywhere.

N must be known before the first slot, so texts are tokenized into a written table first: per
document its ids, the scan partition it came from and its place in it. One number per partition
reaches the driver and gives each partition its offset, as ``zipWithIndex`` does; from then on
nothing depends on how the scan was split. Sequences then cross the network once, in PASSES
ranges of shards: a pass reads the written ids, sends what belongs to its shards and writes
them, so that only a part of the sequences lies in shuffle files at a time.

Shards are written below a shared folder under a name of the task attempt; the index, a
Parquet table with one row per sequence, names the files of the attempts that succeeded.

Defined cases: a null or empty text has no sequence; repeated rows are sequences of their
own; null doc_ids are carried; an empty table gives no shard and no rows. Only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from shelfcheck.llm.util import materialize, prepare, worker_state
from shelfcheck.llm.warc import _fs, _uri
from shelfcheck.session import scratch_path

STRIDE = 256          # ids per sequence
PER_SHARD = 65_536    # sequences per shard
KEY = 0x5EED_0F_0DE2
ROUNDS = 6
PASSES = 4            # ranges of shards written one after the other
SLICE = 8192          # sequences per batch of output

INDEX = "slot long, shard int, record int, file string, n_ids int, doc_id {id}, seq_no int"


# ---------------------------------------------------------------- permutation

class Feistel:
    """A keyed permutation of 0..size-1."""

    def __init__(self, size: int, key: int = KEY, rounds: int = ROUNDS):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")
                     for r in range(rounds)]

    def _mix(self, x, key: int):
        import numpy as np

        with np.errstate(over="ignore"):
            x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << self.half) - 1)

    def _once(self, x, keys, inverse: bool):
        import numpy as np

        shift, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> shift, x & mask
        for k in keys:
            if inverse:
                left, right = right ^ self._mix(left, k), left
            else:
                left, right = right, left ^ self._mix(right, k)
        return (left << shift) | right

    def _walk(self, numbers, keys, inverse: bool):
        import numpy as np

        x = self._once(np.asarray(numbers, np.uint64), keys, inverse)
        while True:  # cycle-walking: apply again to what falls outside
            out = np.flatnonzero(x >= np.uint64(self.size))
            if not len(out):
                return x.astype(np.int64)
            x[out] = self._once(x[out], keys, inverse)

    def slots(self, numbers):
        return self._walk(numbers, self.keys, False)

    def numbers(self, slots):
        return self._walk(slots, self.keys[::-1], True)


# ---------------------------------------------------------------- ids

def read_ranks(path: str) -> tuple[dict[bytes, int], int]:
    """(ranks, end): the end token is the number after the last rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end = max(ranks.values()) + 1
    if end >= 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    return ranks, end


class ByteBpe:
    """Ids of a rank file as little-endian 16-bit numbers."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, self.end = read_ranks(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pack(self, text: str) -> bytes:
        ids = array("H", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def tokenizer(path: str, pattern: str) -> ByteBpe:
    return worker_state(("ranks", path), lambda: ByteBpe(path, pattern))


# ---------------------------------------------------------------- Spark jobs

def materialise(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str, doc_id: str = "doc_id",
                text: str = "text", stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write the shards below ``folder``; the index, one row per sequence."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    encoded = _encode(rows, tokenizer_path, pattern, stride)
    counts = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("n_seq").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):  # one number per partition of the scan
        first[part] = total
        total += counts[part]
    n_shards = max(1, -(-total // per_shard))
    end = read_ranks(tokenizer_path)[1]
    index = INDEX.format(id=rows.schema["doc_id"].dataType.simpleString())
    parts = []
    for lo, hi in _ranges(n_shards, PASSES):
        placed = _placed(encoded, first, total, Feistel(total, key), (lo, hi), end, stride, per_shard)
        parts.append(materialize(placed.mapInArrow(_writer(_uri(folder), per_shard), index), "shard-index"))
        del placed
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner delete the pass's shuffle files
    return reduce(DataFrame.unionByName, parts)


def _ranges(n: int, passes: int) -> list[tuple[int, int]]:
    """0..n-1 in up to ``passes`` ranges of nearly equal length."""
    cuts = [n * i // min(n, passes) for i in range(min(n, passes) + 1)]
    return list(zip(cuts, cuts[1:]))


def _encode(rows: DataFrame, tokenizer_path: str, pattern: str, stride: int) -> DataFrame:
    """Written once: (doc_id, part, at, n_seq, ids) of every text with ids; ``at`` is the number of
    its first sequence within its partition of the scan."""
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("part", LongType()),
                         StructField("at", LongType()), StructField("n_seq", LongType()), StructField("ids", BinaryType())])

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tok, part, at = tokenizer(tokenizer_path, pattern), TaskContext.get().partitionId(), 0
        end = tok.end.to_bytes(2, "little")
        for b in batches:
            keep, starts, sizes, ids = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    keep.append(i)
                    ids.append(tok.pack(t) + end)
                    sizes.append(-(-len(ids[-1]) // (2 * stride)))
                    starts.append(at)
                    at += sizes[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int32())), pa.array([part] * len(keep), pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return materialize(rows.mapInArrow(encode, schema), "token-ids", compression="zstd")


def _placed(encoded: DataFrame, first: dict, total: int, network: Feistel, shards: tuple[int, int], end: int, stride: int,
            per_shard: int) -> DataFrame:
    """The sequences of a range of shards, each shard in one partition and in order."""
    lo, hi = shards
    schema = StructType([StructField("slot", LongType()), StructField("shard", IntegerType()),
                         StructField("n_ids", IntegerType()), StructField("doc_id", encoded.schema["doc_id"].dataType),
                         StructField("seq_no", IntegerType()), StructField("ids", BinaryType())])
    size, pad = 2 * stride, end.to_bytes(2, "little") * stride

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            per_doc = b.column(3).to_numpy()
            if not len(per_doc):
                continue
            begin = np.array([first[p] for p in b.column(1).to_pylist()], np.int64) + b.column(2).to_numpy()
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            slots = network.slots(begin[doc] + seq)
            mine = np.flatnonzero((slots >= lo * per_shard) & (slots < hi * per_shard))
            texts, at = b.column(4), 0
            while at < len(mine):  # output in slices of bounded bytes
                part = mine[at:at + SLICE]
                at += SLICE
                records, n_ids, held, ids = [], [], -1, b""
                for d, k in zip(doc[part].tolist(), seq[part].tolist()):
                    if d != held:
                        held, ids = d, texts[d].as_py()
                    record = ids[k * size:(k + 1) * size]
                    n_ids.append(len(record) // 2)
                    records.append(record if len(record) == size else record + pad[len(record):])
                yield pa.RecordBatch.from_arrays([
                    pa.array(slots[part]), pa.array((slots[part] // per_shard).astype(np.int32)), pa.array(n_ids, pa.int32()),
                    b.column(0).take(pa.array(doc[part])), pa.array(seq[part].astype(np.int32)), pa.array(records, pa.binary())],
                    names=schema.names)

    out = encoded.mapInArrow(emit, schema).withColumn("__to", F.col("shard") - lo)
    return out.repartitionById(hi - lo, F.col("__to")).drop("__to").sortWithinPartitions("slot")


def _writer(folder: str, per_shard: int):
    """Map function: shards as files below ``folder``; one index row per record."""
    def write(batches):
        import pyarrow as pa

        out, file, open_shard, done = None, None, None, 0
        for b in batches:
            slots, shards = b.column(0).to_pylist(), b.column(1).to_pylist()
            files, records = [], []
            for slot, shard, ids in zip(slots, shards, b.column(5).to_pylist()):
                if shard != open_shard:
                    if out is not None:
                        out.close()
                    fs, root = _fs(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.u16"
                    out, file = fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}"
                    open_shard, done = shard, 0
                if slot != shard * per_shard + done:
                    raise ValueError(f"slot {slot} is out of place in shard {shard}")
                out.write(ids)
                records.append(done)
                files.append(file)
                done += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(records, pa.int32()), pa.array(files, pa.string()),
                 b.column(2), b.column(3), b.column(4)],
                names=["slot", "shard", "record", "file", "n_ids", "doc_id", "seq_no"])
        if out is not None:
            out.close()

    return write


def read_slots(index: DataFrame, start: int = 0, stride: int = STRIDE, per_shard: int = PER_SHARD) -> Iterator:
    """(slot, ids) in training order from ``start`` on, reading shard after shard. The
    driver holds the shards' names (one per ``per_shard`` sequences) and one record."""
    import numpy as np

    shards = sorted((r["shard"], r["file"]) for r in index.select("shard", "file").distinct().collect())
    for shard, file in shards:
        skip = max(0, start - shard * per_shard)
        if skip >= per_shard:
            continue
        fs, path = _fs(file)
        with fs.open_input_file(path) as f:
            f.seek(skip * stride * 2)
            slot = shard * per_shard + skip
            while record := f.read(stride * 2):
                yield slot, np.frombuffer(record, "<u2")
                slot += 1


def read_back(spark: SparkSession, index: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The index with the digest of each record's ids, read sequentially from the shards."""
    prepare(spark)
    columns = ["slot", "shard", "record", "file", "n_ids", "doc_id", "seq_no"]
    fields = StructType([*index.select(*columns).schema.fields, *StructType.fromDDL(
        "byte_offset long, ids_sha256 string").fields])
    n = (index.agg(F.max("shard")).first()[0] or 0) + 1

    def run(batches):
        import pyarrow as pa

        f, opened = None, None
        for b in batches:
            offsets, digests = [], []
            for record, file, n_ids in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if file != opened:
                    fs, path = _fs(file)
                    f, opened = fs.open_input_stream(path, compression=None, buffer_size=1 << 20), file
                    at = 0
                offset = record * stride * 2
                if offset != at:
                    raise ValueError(f"{file}: record {record} does not follow")
                ids = f.read(stride * 2)
                at += len(ids)
                offsets.append(offset)
                digests.append(hashlib.sha256(ids[:2 * n_ids]).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(offsets, pa.int64()), pa.array(digests, pa.string())],
                                             names=fields.names)

    return (index.select(*columns).repartitionById(n, F.col("shard")).sortWithinPartitions("slot")
            .mapInArrow(run, fields))


def round_trip(docs: DataFrame, tokenizer_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Materialise ``docs`` below the shared folder and read every record back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "llm", f"shards-{uuid.uuid4().hex}")
    return read_back(spark, materialise(docs, tokenizer_path, pattern, folder, doc_id, text))
