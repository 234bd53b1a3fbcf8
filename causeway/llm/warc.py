"""WARC archives, index first: records are written with an index of offset, length, URL and digest,
and selected records come back by sorted, coalesced byte-range reads."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyarrow.fs import FileSystem, HadoopFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import fresh_dir, materialise

REVISIT_FROM = 100  # payload bytes from which equal payloads are stored once
BROADCAST_ROWS = 200_000  # up to so many repeated digests are broadcast (about 100 bytes each)
GAP = 64 << 10  # bytes between two records that are read rather than skipped
MOST = 8 << 20  # bytes that one coalesced read takes, unless a single record is longer
INDEX_SCHEMA = "file string, offset long, length long, url string, payload_digest string, record_type string, id string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Hadoop's names of stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "file": "file"}


def file_system(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder that Spark names, and the folder's path in it.

    Object stores are reached by pyarrow's own clients, every other scheme (hdfs, viewfs and what else is in the
    cluster's configuration) by Hadoop's client.
    """
    scheme, sep, rest = folder.partition("://")
    if sep and scheme not in SCHEMES:
        return HadoopFileSystem.from_uri(folder), "/" + rest.partition("/")[2]
    return FileSystem.from_uri(f"{SCHEMES[scheme]}://{rest}" if sep else folder)


def record_bytes(id_: str, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP head, and with it the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{id_}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:none')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields[6:6] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's fields, the HTTP head's fields, and the payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length and its end don't agree")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(folder)
        # each attempt of a task has a file of its own; the index names only those of attempts that ended well
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for id_, url, html, refers_to in batch.itertuples(index=False, name=None):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                data = record_bytes(id_ or "", url, payload, refers_to, digest)
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                rows.append((name, at, len(data), url, digest, "response" if refers_to is None else "revisit", id_))
                at += len(data)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if out is not None:
            out.close()

    return write


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record per row under ``folder`` (a URI that all executors reach) and returns the index.

    Of rows with equal payloads of REVISIT_FROM bytes or more, the one with the smallest id is the
    response and the others revisit it. Null html counts as empty, null URLs are written as urn:none
    (the index keeps null), rows without an id never are the response others refer to. Repeated rows
    of the smallest id are all responses. An empty table gives an empty index; further columns are not read.
    """
    page = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), F.sha2(page, 256).alias("_digest"), F.octet_length(page).alias("_n"))
    firsts = rows.where(F.col("_n") >= REVISIT_FROM).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    firsts = materialise(firsts.where("_rows > 1 and _first is not null").select("_digest", "_first"), "warc-repeats")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, "_digest", "left")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    records = joined.select(F.col("_id").cast("string").alias("id"), "_url", "_html", refers.alias("refers_to"))
    index = records.mapInPandas(_writer(folder), INDEX_SCHEMA)
    return materialise(index, "warc-index")


def _ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last) of reads over records in order of offset."""
    first, start, end = 0, offsets[0], offsets[0] + lengths[0]
    for k in range(1, len(offsets)):
        stop = offsets[k] + lengths[k]
        if offsets[k] - end > GAP or stop - start > MOST:
            yield first, k, start, end
            first, start = k, offsets[k]
        end = max(end, stop)
    yield first, len(offsets), start, end


READ_SCHEMA = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` (or a selection of its rows) names, read back from the archives.

    A response's payload is checked against its digest and length. ``payloads`` adds a column with the
    payload (null for revisits, which store none). Rows of one file are read in order of offset.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")] + ["payload"] * payloads

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(folder)
        for batch in batches:
            for name, part in groupby(batch.itertuples(index=False, name=None), key=lambda r: r[0]):
                part = list(part)
                offsets, lengths = [r[1] for r in part], [r[2] for r in part]
                with fs.open_input_file(f"{path}/{name}") as f:
                    for first, stop, start, end in _ranges(offsets, lengths):
                        data, rows = f.read_at(end - start, start), []
                        for k in range(first, stop):
                            at = offsets[k] - start
                            fields, http, payload = parse_record(data[at : at + lengths[k]])
                            response, digest = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            n = int(http["Content-Length"])
                            if response and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                                raise ValueError(f"{name}: the payload at {offsets[k]} doesn't match its digest")
                            of = lambda x: x and (x.removeprefix("<urn:page:").removesuffix(">") or None)
                            rows.append((of(fields["WARC-Record-ID"]), part[k][3], n, digest, fields["WARC-Type"], of(fields.get("WARC-Refers-To"))) + ((payload if response else None),) * payloads)
                        yield pd.DataFrame(rows, columns=names)

    sorted_index = index.select("file", "offset", "length", "url").repartition("file").sortWithinPartitions("file", "offset")
    return sorted_index.mapInPandas(read, READ_SCHEMA + ", payload binary" * payloads)


def archive_round_trip(df: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and reads all of them back."""
    folder = fresh_dir(df.sparkSession, "warc")
    back = read_records(write_archives(df, folder), folder)
    kind = df.schema["page_id"].dataType
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
