"""WARC archives: a parallel writer with revisit records, and a reader that splits gzip files.

Writer: each task writes one file, a gzip member per record, under a name of its own attempt; only the rows of
successful attempts name files, and these rows are the archive's manifest, so a task that is run again leaves no wrong
records behind. Reader: tasks take byte ranges, look for gzip magic, take a place as a record start if the member there
decodes to a WARC header, and own the records that start inside their range, reading on past its end for the last one.

Damage is never passed over: a file must begin with a record, another must follow where one ends, a member whose header
decodes must decode whole, and a file must have the size that is known of it. What fails this ends the read in an error or
becomes a row of type ``damaged`` by place (a run of damaged records gives at least one).

Defined cases: a null payload is empty; a null id is written without an id header and read back as null, and is
never what a revisit refers to; equal payloads whose ids are all null are all responses; rows that repeat the
largest id of a payload are all responses; an empty table writes no files and reads as no records; columns
besides id, target and payload are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT = 16 << 20
CHUNK = 1 << 20
MOST_PARTS = 100_000
EPOCH = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The table of an archive's files, in its folder.
MANIFEST, MANIFEST_DDL = "_files", "path string, bytes long, records long"
RECORD_DDL = "path string, position long, record_type string, id long, target string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme is local."""
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: int | None, target: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit carries the digest and length of the payload, not the payload."""
    body = payload if kind == "response" else b""
    target = (target or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{target}:{sha}')}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    lines += [f"X-Row-ID: {key}"] if key is not None else []
    lines += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Row-ID: {refers_to}"] if kind == "revisit" else []
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _payload(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string").cast("binary"), F.lit("").cast("binary"))


def plan_records(pages: DataFrame, key: str, target: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Rows (id, target, payload, sha, refers_to) to write; ``refers_to`` is set for revisits.

    Only payloads that occur twice or more enter the join; their largest ids combine before the shuffle. The
    join is an equi-join on the digest, whose large side Spark can split if one payload is very frequent.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{target}`").cast("string").alias("target"), _payload(payload).alias("payload")).withColumn("sha", F.sha1("payload"))
    again = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("largest")).where("n > 1").select("sha", "largest")
    joined = rows.join(again, "sha", "left")
    return joined.select("id", "target", "payload", F.when(F.col("id").eqNullSafe(F.col("largest")), None).otherwise(F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, key: str = "page_id", target: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives into ``folder`` (in a store that all executors reach); rows (path, bytes, records) of the files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        path, out, records = "", None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(path, compression=None)
                kind = "response" if r["refers_to"] is None else "revisit"
                out.write(record(kind, r["id"], r["target"], r["payload"], digest(r["payload"]), r["refers_to"]))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            prefix = folder[: -len(root)] if folder.endswith(root) else folder.split("/", 1)[0] + "//"
            yield pa.RecordBatch.from_pydict({"path": [prefix + path], "bytes": [size], "records": [records]})

    files = plan_records(pages, key, target, payload, least_bytes).mapInArrow(put, MANIFEST_DDL)
    files.write.parquet(f"{folder}/{MANIFEST}")
    return pages.sparkSession.read.schema(MANIFEST_DDL).parquet(f"{folder}/{MANIFEST}")


def members(uri: str, start: int, end: int, known_size: int | None = None) -> Iterator[tuple[int, bytes | None]]:
    """The place and the bytes of each record of a file that starts in [start, end); a place without bytes is damaged.

    The search for magic goes on only until a first record is validated; after that each next record begins where
    the one before ended. Memory is bounded by one record and a chunk.
    """
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        at, must = start, start == 0
        while at < min(end, size):
            found = decode(f, at)
            if isinstance(found, tuple):
                yield at, found[0]
                at, must = found[1], True
            else:
                if must or found:
                    yield at, None
                at, must = next_magic(f, at + 1, min(end, size)), False
        # The record after the range's last is another task's, which takes a place without a record for none.
        if must and at < size and decode(f, at, head_only=True) is False:
            yield at, None
        if known_size is not None and size != known_size and start <= min(size, known_size) < end:
            yield min(size, known_size), None


def next_magic(f: pa.NativeFile, at: int, end: int) -> int:
    """The first place from ``at`` on where magic begins; ``end`` or more if there is none before it."""
    while at < end:
        f.seek(at)
        window = f.read(CHUNK + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found >= 0:
            return at + found
        if len(window) < len(MAGIC):
            return end
        at += CHUNK
    return at


def decode(f: pa.NativeFile, at: int, head_only: bool = False) -> tuple[bytes, int] | bool:
    """The record whose gzip member begins at ``at`` and the place after it; False if none begins there, True if one
    does that cannot be decoded (or for ``head_only``, that need not be)."""
    f.seek(at)
    raw = f.read(4096)
    if raw[:3] != MAGIC:
        return False
    z, out, used = zlib.decompressobj(31), [], 0
    try:
        head = z.decompress(raw, 64)
    except zlib.error:
        return False
    if not head.startswith(b"WARC/1."):
        return False
    if head_only:
        return True
    try:
        out.append(head)
        used = len(raw)
        raw = z.unconsumed_tail
        while not z.eof:
            if not raw:
                raw = f.read(CHUNK)
                if not raw:
                    return True
                used += len(raw)
            out.append(z.decompress(raw))
            raw = z.unconsumed_tail
    except zlib.error:
        return True
    data = b"".join(out)
    return (data, at + used - len(z.unused_data)) if b"\r\n\r\n" in data else True


def parse(data: bytes | None) -> dict:
    """Headers and body of one record. A missing one, or a response whose payload does not fit its digest, is an error."""
    if data is None:
        raise ValueError("no whole record here")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    number = lambda k: int(fields[k]) if k in fields else None
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and sha and digest(body) != sha:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    return {"record_type": kind, "id": number("x-row-id"), "target": fields.get("warc-target-uri"), "payload_bytes": number("x-payload-length") if kind == "revisit" else len(body), "payload_digest": sha or digest(body), "refers_to": number("x-refers-to-row-id"), "payload": body if kind == "response" else None}


def read(files: DataFrame, split: int = SPLIT, payload: bool = True, damaged: str = "fail") -> DataFrame:
    """The records of the files (rows with path and bytes), read by ranges of ``split`` bytes.

    ``damaged`` is ``fail``, so that damage ends the read in an error, or ``row``, so that it becomes rows.
    """
    if damaged not in ("fail", "row"):
        raise ValueError(f"damaged must be fail or row, not {damaged}")
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    # Dealt by place, so that the ranges of one file go to different tasks; as many parts as ranges, as Spark would
    # else merge the ranges, whose rows are small, into few tasks.
    parts = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = ranges.repartition(max(1, min(int(parts), MOST_PARTS)), F.col("path"), F.col("start"))

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                rows, held = [], 0
                for at, data in members(path, int(start), int(start) + split, int(size)):
                    try:
                        row = {"path": path, "position": at} | parse(data)
                    except (KeyError, ValueError) as wrong:
                        if damaged == "fail":
                            raise ValueError(f"damaged record at {at} of {path}: {wrong}") from wrong
                        row = {"path": path, "position": at, "record_type": "damaged"}
                    held += len(data or b"")
                    rows.append(row if payload else {**row, "payload": None})
                    if held > 8 * CHUNK:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return ranges.mapInPandas(get, RECORD_DDL)


def frame(rows: list[dict]) -> pd.DataFrame:
    kinds = dict(x.split() for x in RECORD_DDL.split(", "))
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int64" if t == "long" else object) for c, t in kinds.items()})


def read_folder(spark: SparkSession, folder: str, split: int = SPLIT, manifest: bool = True, damaged: str = "fail") -> DataFrame:
    """The records of the archives in a folder: of those that its manifest names or, for archives of others, of all ``*.warc.gz``.

    Spark lists the folder then, and no file's content is read for that.
    """
    if manifest:
        files = spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/{MANIFEST}")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))
    return read(files, split, damaged=damaged)


def round_trip(pages: DataFrame, key: str = "page_id", target: str = "url", payload: str = "html", split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read the records back, with or without their payloads."""
    files = write(pages, scratch_path(pages.sparkSession, "warc"), key, target, payload)
    return read(files, split, with_payload)
