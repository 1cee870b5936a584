"""WARC archives: written by tasks, read back record by record.

One gzip member holds one record. The reader streams an archive: it inflates a
member piece by piece, takes the head up to the empty line, and frames the
block by Content-Length; a member that ends early or late, or a payload that
does not have its digest, is an error. Its memory is one piece and the head,
not the archive (and the payload only if asked for).

Of records with equal payloads of ``min_bytes`` or more, that with the largest
id is a response; others are revisits that refer to it. Rows with one id and
payload are all responses if that id is the largest. A null id is smaller than
all others; a null payload is an empty one. Null urls have no target header;
characters that may not stand in a header are percent-encoded. An empty table
gives no archives and no rows. Other columns are not archived.

Each writing task names its archives anew, and only archives listed in the
stored manifest are read, so a task that ran twice does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.stored import Stored, shared_path

ARCHIVE_BYTES = 128 << 20
_PIECE = 1 << 18
_ID, _NO_ID = "urn:x-page:", "none"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is not as its records say."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<{_ID}{_NO_ID if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    text = uri.strip("<>").removeprefix(_ID)
    return None if text == _NO_ID else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = _HTTP if revisit else _HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _uri(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Profile": _SAME if revisit else None,
        "WARC-Refers-To": _uri(refers_to) if revisit else None,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member (read one before the next)."""
    raw = stream.read(_PIECE)
    while raw:
        inflater = zlib.decompressobj(wbits=31)

        def pieces() -> Iterator[bytes]:
            nonlocal raw
            while not inflater.eof:
                if not raw:
                    raise WarcError("the archive ends within a record")
                out = inflater.decompress(raw, _PIECE)
                raw = inflater.unconsumed_tail or inflater.unused_data or (
                    b"" if inflater.eof else stream.read(_PIECE))
                if out:
                    yield out

        yield pieces()
        if not inflater.eof:
            raise WarcError("a record was not read to its end")
        raw = raw or stream.read(_PIECE)


def read_record(pieces: Iterator[bytes], keep_payload: bool = False) -> dict:
    """Head and verified block of one member."""
    buffer = b""
    for piece in pieces:
        buffer += piece
        if b"\r\n\r\n" in buffer:
            break
    head, found, rest = buffer.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("a record without a head")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block, payload, start, kept, seen = hashlib.sha1(), hashlib.sha1(), b"", [], 0
    in_payload = False
    while True:
        part = rest[:max(0, length - seen)]
        after = rest[len(part):]
        block.update(part)
        seen += len(part)
        if not in_payload:
            start += part
            _, found, part = start.partition(b"\r\n\r\n")
            in_payload = bool(found)
        if in_payload:
            payload.update(part)
            if keep_payload:
                kept.append(part)
        if seen == length:
            tail = after + b"".join(pieces)
            break
        rest = next(pieces, b"")
        if not rest:
            raise WarcError("a block shorter than its Content-Length")
    if tail != b"\r\n\r\n":
        raise WarcError("a block longer than its Content-Length")
    digests = {"warc-block-digest": block}
    if fields["warc-type"] == "response":
        digests["warc-payload-digest"] = payload
    for name, got in digests.items():
        if fields[name] != f"sha1:{base64.b32encode(got.digest()).decode()}":
            raise WarcError(f"{name} does not hold for {fields['warc-record-id']}")
    return fields | {"payload": b"".join(kept) if keep_payload and fields["warc-type"] == "response" else None}


def with_referrals(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Pages with ``__copies`` (over 1 if others have the payload) and
    ``__chosen``, the id of the response among them. Digests alone are
    grouped, as partial sums; groups of one do not reach the join."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    wide = pages.withColumn("__sha", F.sha1(body)).withColumn("__len", F.length(body))
    groups = (wide.filter(F.col("__len") >= min_bytes).groupBy("__sha", "__len")
              .agg(F.count(F.lit(1)).alias("__copies"), F.max(id_col).alias("__chosen"))
              .filter("__copies > 1"))
    return wide.join(groups, ["__sha", "__len"], "left").drop("__sha", "__len")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Archive all pages; the manifest (path, n_records, n_bytes)."""
    root = root or shared_path(pages.sparkSession, "warc")
    rows = with_referrals(pages.select(id_col, url_col, payload_col), id_col, payload_col, min_bytes)

    def write(batches):
        fs, base = FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, entry = fs.open_output_stream(f"{base}/{name}", compression=None), [f"{root}/{name}", 0, 0]
                revisit = row["__copies"] is not None and row[id_col] != row["__chosen"]
                data = record(row[id_col], row[url_col], (row[payload_col] or "").encode(), revisit, row["__chosen"])
                out.write(data)
                entry[1], entry[2] = entry[1] + 1, entry[2] + len(data)
                if entry[2] >= ARCHIVE_BYTES:
                    out.close()
                    out = done.append(entry)
        if out is not None:
            out.close()
            done.append(entry)
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string())] + [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)],
            ["path", "n_records", "n_bytes"])

    manifest = rows.mapInArrow(write, "path string, n_records long, n_bytes long")
    return Stored(manifest, "warc-manifest").read()


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives listed in ``manifest``; a task reads
    whole archives, one after the other."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [c.split()[0] for c in schema.split(", ")] + ["payload"] * keep_payload

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = FileSystem.from_uri(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for pieces in members(stream):
                        f = read_record(pieces, keep_payload)
                        refers = f.get("warc-refers-to")
                        rows.append((_page_id(f["warc-record-id"]), int(f["x-payload-length"]),
                                     f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"],
                                     _page_id(refers) if refers else None, f["payload"]))
                        if len(rows) >= (64 if keep_payload else 4096):
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(
        read, schema + ", payload binary" * keep_payload)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """What reading the archives of these (id, payload) must give (unique ids)."""
    largest: dict[bytes, int] = {}
    for page, html in rows:
        body = (html or "").encode()
        largest[body] = max(page, largest.get(body, page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        again = largest[body] != page
        out.append((page, len(body), payload_digest(body), "revisit" if again else "response",
                    largest[body] if again else None))
    return out
