"""WARC archives as a chunked record table (operator 1).

``write`` puts one record per row into gzip archives below a folder, a member per record;
``read`` streams the archives and yields rows (record_id, chunk_no, data, ...), each with the
byte count and SHA-1 of the payload so far. Neither side builds a whole record: the writer is
handed a payload as rows of ``chunk_bytes``, and compression and digests run over these; revisits
hand it none. The writer's own digest must agree with the declared one. An archive is written
under a temporary name and renamed when complete, so a retried task replaces its file and readers
never see half of one.

Defined results: a null payload counts as empty; null ids give a record without an id, which is
always a response and read back as null; repeated rows are records of their own, and rows that
repeat the smallest id of their payload are all responses; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, size, digest, refers_to): refers_to is the smallest id of an equal payload of at least ``min_bytes`` bytes, null for that record itself.

    Payloads are equal if SHA-1 and length are. Smallest ids are combined before their shuffle;
    the payloads move once, by digest, and a hot digest's partition can be split.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    first = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("id") != F.col("first"), F.col("first"))
    return rows.join(first, ["digest", "size"], "left").select("id", "url", "payload", "size", "digest", refers.alias("refers_to"))


def _record(kind: str, rid: str | None, url: str | None, digest: str, refers: str | None, block_head: bytes, size: int) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    if rid is not None:
        head.append(f"WARC-Record-ID: <urn:x-row:{rid}>")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:x-row:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block_head) + size}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block_head


def write(records: DataFrame, path: str, chunk_bytes: int = CHUNK, level: int = 1) -> DataFrame:
    """Write ``records`` (as from :func:`mark_revisits`) to ``path``/part-N.warc.gz; returns the manifest (file, n_records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = _fs(path)
        final, temp, out, n = f"{base}/part-{part:06d}.warc.gz", f"{base}/_part-{part:06d}-{uuid.uuid4().hex}", None, 0
        z = sha = None
        for b in batches:
            for rid, url, size, digest, refers, no, last, data in zip(b["id"], b["url"], b["size"], b["digest"], b["refers_to"], b["no"], b["last"], b["data"]):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temp)
                revisit = isinstance(refers, str)
                if no == 0:
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    head = _record("revisit" if revisit else "response", rid if isinstance(rid, str) else None, url if isinstance(url, str) else None, base32_sha1(bytes.fromhex(digest)), refers if revisit else None, http, 0 if revisit else size)
                    z, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(z.compress(head))
                sha.update(data)
                out.write(z.compress(data))
                if last:
                    if not revisit and sha.hexdigest() != digest:
                        raise ValueError(f"the payload of record {rid} does not have the digest {digest}")
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
                    n += 1
        if out is not None:
            out.close()
            fs.move(temp, final)
            yield pd.DataFrame({"file": [f"part-{part:06d}.warc.gz"], "n_records": [n]})

    body = F.when(F.col("refers_to").isNull(), F.col("payload").cast("binary")).otherwise(F.lit(b""))
    ids = records.select(F.col("id").cast("string").alias("id"), "url", "size", "digest", F.col("refers_to").cast("string").alias("refers_to"), body.alias("body"))
    chunks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk_bytes)).cast("int")
    # a record's chunks stay in order, in the task that has the record
    rows = ids.withColumn("chunks", chunks).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("no"))
    rows = rows.select("id", "url", "size", "digest", "refers_to", "no", (F.col("no") == F.col("chunks") - 1).alias("last"), F.substring("body", F.col("no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))
    return rows.mapInPandas(run, "file string, n_records bigint")


class Stream:
    """Bytes of a gzip file of many members, inflated block by block."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.buf, self.z, self.over = raw, block, bytearray(), None, False

    def fill(self) -> bool:
        rest = b""
        if self.z is not None and self.z.eof:
            rest, self.z = self.z.unused_data, None
        if self.z is not None and self.z.unconsumed_tail:
            rest = self.z.unconsumed_tail
        data = rest or self.raw.read(self.block)
        if not data:
            self.over = True
            return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.buf += self.z.decompress(data, 4 * self.block)
        return True

    def line(self) -> bytes | None:
        """Up to CRLF, or None at the end."""
        at = 0
        while (i := self.buf.find(b"\r\n", max(0, at - 1))) < 0:
            at = len(self.buf)
            if not self.fill():
                return None
        out = bytes(self.buf[:i])
        del self.buf[: i + 2]
        return out

    def take(self, n: int) -> bytes:
        """At least one and at most n bytes, or none at the end."""
        while not self.buf and self.fill():
            pass
        out = bytes(self.buf[:n])
        del self.buf[: len(out)]
        return out


def records(raw, chunk_bytes: int = CHUNK) -> Iterator[tuple]:
    """(headers, http headers, chunk_no, data, bytes so far, SHA-1 so far, last) of every record of an open archive."""
    s = Stream(raw)
    while (first := s.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = _headers(s)
        left = int(head["content-length"])
        http: dict = {}
        if "application/http" in head.get("content-type", "") and left:
            status = s.line()
            got = _headers(s, used := [len(status) + 2])
            left, http = left - used[0], got
        digest, seen, no = hashlib.sha1(), 0, 0
        while True:
            want = min(left, chunk_bytes)
            parts = []
            while want:
                d = s.take(want)
                if not d:
                    raise EOFError("the archive ends inside a record")
                parts.append(d)
                want -= len(d)
            data = b"".join(parts)
            digest.update(data)
            seen, left = seen + len(data), left - len(data)
            yield head, http, no, data, seen, digest.digest(), left == 0
            no += 1
            if left == 0:
                break


def _headers(s: Stream, used: list[int] | None = None) -> dict[str, str]:
    out = {}
    while True:
        x = s.line()
        if x is None:
            raise EOFError("the archive ends inside a header")
        if used is not None:
            used[0] += len(x) + 2
        if not x:
            return out
        k, _, v = x.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()


def read(manifest: DataFrame, path: str, chunk_bytes: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``: one task per file, a chunk in memory at a time.

    Without ``data`` the chunk bytes are left out of the rows; digests and counts stay.
    """
    cols = "record_id string, record_type string, refers_to string, url string, declared_digest string, payload_length bigint, chunk_no int, chunk_bytes bigint, bytes_so_far bigint, sha1_so_far string, last boolean" + ", data binary" * data
    names = [c.split()[0] for c in cols.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(path)
        for b in batches:
            for f in b["file"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{f}", compression=None) as raw:
                    for h, http, no, d, seen, digest, last in records(raw, chunk_bytes):
                        rid, ref = h.get("warc-record-id"), h.get("warc-refers-to")
                        row = (_row_id(rid), h["warc-type"], _row_id(ref), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), int(http["content-length"]) if "content-length" in http else None, no, len(d), seen, base32_sha1(digest), last)
                        rows.append(row + (d,) * data)
                        held += len(d) * data + 200
                        if held >= 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(n).mapInPandas(run, cols)


def _row_id(x: str | None) -> str | None:
    return None if x is None else x.removeprefix("<urn:x-row:").removesuffix(">")


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0, data: bool = True) -> DataFrame:
    """Write ``pages`` and return the chunked record table read back from the archives."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    manifest = written(write(mark_revisits(pages, id_col, payload_col, url_col, min_bytes), path), "manifest")
    return read(manifest, path, data=data)


def page_digests(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's count and digest are those of the bytes read; a revisit's are the ones it declares.
    """
    kind = pages.schema["page_id"].dataType
    chunks = archive(pages, path, data=False).where("last")
    response = F.col("record_type") == "response"
    return chunks.select(
        F.col("record_id").cast(kind).alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        (~response | (F.col("sha1_so_far") == F.col("declared_digest"))).alias("verified"),
    )
