"""WARC archives: one gzip member per record, written and read in parallel.

Writer: every partition becomes one ``.warc.gz`` file below a shared folder, named by task
attempt; a manifest written as Parquet lists the files of the attempts that succeeded, so a
lost executor leaves at most files that no manifest names. Of records with equal payloads
of at least ``MIN_REVISIT`` bytes the one with the smallest page_id is a response, the
others are revisits without payload that refer to it.

Reader: sequential, at most one record's payload in memory. Compressed blocks pass through
one incremental zlib object per member; the record is framed by Content-Length, and block
and payload digests are verified. Each gzip member must hold exactly one record.

Defined cases: page_ids of any type keep their value, texts percent-encoded in the record's id
and null under an id of its own; a null html is an empty payload, a null url an empty target; null page_ids
sort last (a revisit never refers to a null unless all its copies have none, and then all
are responses); rows that repeat the smallest page_id of a payload are all responses; an
empty table gives no archive and no rows. Damage (bad frame, digest, truncated member) raises
an error unless ``strict=False``, which marks records that fail a digest and skips to the
next member. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcheck.llm.util import materialize, prepare
from shelfcheck.session import scratch_path

MIN_REVISIT = 100
BLOCK = 1 << 18
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, n_records long, n_bytes long"
RECORDS = ("file string, offset long, record_id string, record_type string, refers_to string, "
           "target_uri string, payload_bytes long, payload_digest string, payload binary, verified boolean")


def _fs(uri: str):
    """(file system, path) of a folder or file that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


# ---------------------------------------------------------------- records

def record(kind: str, record_id: str, target: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose Content-Length is that
    of the full payload, and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", " ".join(target.split())),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class WarcError(ValueError):
    pass


def members(stream, strict: bool = True) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member, decompressed block by block."""
    buf, offset, more = b"", 0, True
    while True:
        if not buf and more:
            buf = stream.read(BLOCK)
            more = len(buf) > 0
        if not buf:
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                if not buf:
                    buf = stream.read(BLOCK)
                    if not buf:
                        raise WarcError(f"truncated member at {offset}")
                parts.append(z.decompress(buf))
                used += len(buf) - len(z.unused_data)
                buf = z.unused_data
        except (zlib.error, WarcError) as e:
            if strict:
                raise WarcError(f"member at {offset}: {e}") from e
            # Look for the next member's magic bytes past the damage.
            offset += max(used, 1)
            buf, skipped = _resync(stream, buf)
            offset += skipped
            continue
        yield offset, b"".join(parts)
        offset += used


def _resync(stream, buf: bytes) -> tuple[bytes, int]:
    skipped, buf = 0, buf[1:]
    while True:
        at = buf.find(b"\x1f\x8b\x08")
        if at >= 0:
            return buf[at:], skipped + at
        tail = buf[-2:]
        skipped += len(buf) - len(tail)
        more = stream.read(BLOCK)
        if not more:
            return b"", skipped
        buf = tail + more


def parse(data: bytes) -> dict:
    """Frame one record by its Content-Length; verify its digests."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise WarcError("not a record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise WarcError("bad header line")
        fields[k.decode().strip().lower()] = v.decode("utf-8").strip()
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    if len(rest) < size:
        raise WarcError("block is cut off")
    block, tail = rest[:size], rest[size:]
    if tail != b"\r\n\r\n":
        raise WarcError("record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    full = len(payload)
    for line in http.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if kind == "revisit" and k.strip().lower() == b"content-length":
            full = int(v)
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    ok = fields.get("warc-block-digest", "").partition(":")[2] == hashlib.sha256(block).hexdigest()
    if kind == "response":
        ok = ok and digest == hashlib.sha256(payload).hexdigest() and \
            all(int(line.partition(b":")[2]) == full for line in http.split(b"\r\n")[1:]
                if line.lower().startswith(b"content-length:"))
    return {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind,
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "target_uri": fields.get("warc-target-uri", ""), "payload_bytes": full,
            "payload_digest": digest, "payload": payload, "verified": ok}


def read_file(uri: str, strict: bool = True) -> Iterator[dict]:
    """The records of one archive, in order."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        for offset, data in members(stream, strict):
            try:
                r = parse(data)
            except WarcError as e:
                if strict:
                    raise WarcError(f"{uri} at {offset}: {e}") from e
                continue
            if strict and not r["verified"]:
                raise WarcError(f"{uri} at {offset}: digest does not match")
            yield {"file": uri, "offset": offset, **r}


# ---------------------------------------------------------------- Spark jobs

def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, first): ``first`` is the page that a revisit refers to."""
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"),
                        F.coalesce(pages[html], F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # Only payloads that occur more than once matter; the counts are written first, so that
    # the join below sees two plain scans and can split the rows of a very common payload.
    common = materialize(
        rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    return rows.join(common, "digest", "left")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; the manifest (file, n_records, n_bytes) of what was written."""
    spark = pages.sparkSession
    prepare(spark)
    folder = _uri(folder)
    rows = revisits(pages, page_id, url, html).select("page_id", "url", "html", "digest", "first")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        out, n, size, file = None, 0, 0, None
        for b in batches:
            for p, u, h, d, f in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs, root = _fs(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, file = fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}"
                kind = "revisit" if f is not None and p != f else "response"
                data = member(record(kind, _name(p), u or "", h, d, _name(f) if kind == "revisit" else None))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": file, "n_records": n, "n_bytes": size}])

    return materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


NO_ID = "urn:no-page"


def _name(page_id) -> str:
    """A record id of printable ASCII, whatever characters the page's id has."""
    return NO_ID if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def read(spark: SparkSession, manifest: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """All records of the archives that ``manifest`` (column ``file``) names, one row each.

    One task reads a file sequentially; files are dealt out evenly. ``payloads=False``
    verifies the payloads and leaves them out.
    """
    prepare(spark)
    files = manifest.select("file").distinct()
    n = max(1, min(files.count(), 10_000))
    fields = StructType.fromDDL(RECORDS)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        for b in batches:
            for f in b.column(0).to_pylist():
                rows, size = [], 0
                for r in read_file(f, strict):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    size += len(r["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.repartition(n).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives below the shared folder and read them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to per page."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    kind = pages.schema[page_id].dataType
    back = read(spark, write(pages, folder, page_id, url, html), payloads=False)

    def number(c: str):
        return F.when(F.col(c) != NO_ID, F.url_decode(F.substring(c, len("urn:page:") + 1, 1 << 30))).cast(kind)

    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", number("refers_to").alias("refers_to"))
