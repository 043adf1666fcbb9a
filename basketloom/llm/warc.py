"""WARC archives with an index, and coalesced byte-range reads.

Writing: each task streams its records, each a gzip member of its own, into one new file in the shared folder
and returns an index row for each record (file, offset, length, page_id, URL, digest, type).  The index table
is committed by Spark; the file of a task attempt that was lost or repeated is named by no index row.

Reading: the wanted index rows are dealt by file and stretch of the file, sorted by offset, and neighbouring
ranges are joined into one read as long as the gap and the joined length stay below their bounds.

Payloads are the html in UTF-8.  Among equal payloads of at least ``LEAST_BYTES`` bytes the record with the
largest page_id is the response and the others are revisits of it; smaller ones are all responses.

Nulls, empty tables and odd rows: a null html is an empty payload.  A null page_id is written as an empty
header, never outranks another id, and reads back as null; if all of a group are null or several rows share the
largest id, one of them (by URL, then any) is the response and the rest revisit it, rows alike in all three
included.  A null URL is written without a header and reads back as null, an empty one as an empty header.  An
empty table gives an empty index and no file.  Line breaks in URLs are percent-encoded.  Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import filesystem, new_path, written
from .textblocks import column_of

LEAST_BYTES = 1000
#: A read joins ranges with at most this gap, up to this length; a task is dealt this much of a file.
GAP, SPAN, STRETCH = 64 << 10, 8 << 20, 32 << 20
#: Digests that occur again are broadcast up to this number (a row takes some hundred bytes); beyond it, large payloads are shuffled to meet them.
BROADCAST_DIGESTS = 100_000

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _uri(page_id: int | None, url: str | None) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}"))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, uncompressed.  Revisits keep the digest and length of their payload, not the payload."""
    http = _HTTP % size
    block = http if is_revisit else http + payload
    safe = None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{_uri(page_id, url)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        *([] if safe is None else [f"WARC-Target-URI: {safe}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record again; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-ID"),
        "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": None if payload is None else payload.decode(),
    }


def _writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        schema = ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "file", "offset", "length")
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, size, digest, refers_to, is_revisit in zip(*(column_of(batch, k).to_pylist() for k in ("page_id", "url", "html", "size", "digest", "refers_to", "is_revisit"))):
                    if out is None:
                        files.create_dir(base, recursive=True)
                        out = files.open_output_stream(f"{base}/{name}", compression=None)  # members are gzipped already
                    payload = (html or "").encode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, size, digest, refers_to, is_revisit)) + packer.flush()
                    out.write(raw)
                    rows.append((page_id, url, digest, size, "revisit" if is_revisit else "response", refers_to, name, at, len(raw)))
                    at += len(raw)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(schema))
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder, index) of the archives of ``pages`` (page_id, url, html)."""
    folder = folder or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"digest": F.sha1(html.cast("binary")), "size": F.octet_length(html).cast("long")})
    large = F.col("size") >= LEAST_BYTES
    # Only digests that occur again matter: ``best`` is the response among them, and how many rows are alike in all that it holds.
    alike = rows.filter(large).groupBy("digest", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("twins"))
    groups = alike.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url", "twins")).alias("best"), F.sum("twins").alias("n"))
    groups = written(groups.filter("n > 1").select("digest", "size", "best"), "groups")
    with_best = groups.drop("size")
    if groups.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(with_best), "digest", "left")
    else:
        joined = rows.filter(large).join(with_best, "digest", "left").unionByName(rows.filter(~large), allowMissingColumns=True)
    repeated = F.col("best").isNotNull()
    is_best = repeated & F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    is_twin = is_best & (F.col("best.twins") > 1)
    revisit = repeated & ~is_best
    single = joined.filter(~is_twin).select(
        "page_id", "url", "size", "digest", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, F.col("best.page_id")).alias("refers_to"), revisit.alias("is_revisit")
    )
    # Of rows alike one is the response; a revisit needs no payload, so the others are made from their number.
    first = joined.filter(is_twin).groupBy("digest", "size", "page_id", "url").agg(F.max("html").alias("html")).withColumns({"refers_to": F.lit(None).cast("long"), "is_revisit": F.lit(False)})
    others = groups.filter("best.twins > 1").withColumn("k", F.explode(F.sequence(F.lit(2).cast("long"), F.col("best.twins"))))
    others = others.select("digest", "size", "best.page_id", "best.url", F.lit(None).cast("string").alias("html"), F.col("best.page_id").alias("refers_to"), F.lit(True).alias("is_revisit"))
    index = single.unionByName(first).unionByName(others).mapInArrow(_writer(folder), INDEX)
    return folder, written(index, "index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """Joins sorted (offset, length) ranges: (offset, length, first range, range after the last) of each read."""
    out: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(ranges):
        if out:
            start, size, first, _ = out[-1]
            end = max(start + size, offset + length)
            if offset - (start + size) <= gap and end - start <= span:
                out[-1] = (start, end - start, first, k + 1)
                continue
        out.append((offset, length, k, k + 1))
    return out


def _reader(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            wanted = sorted(zip(*(column_of(batch, k).to_pylist() for k in ("file", "offset", "length"))))
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in wanted:
                by_file.setdefault(file, []).append((offset, length))
            for file, ranges in by_file.items():
                with files.open_input_file(f"{base}/{file}") as source:
                    for start, size, first, last in coalesced(ranges):
                        raw = memoryview(source.read_at(size, start))
                        found = [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for o, n in ranges[first:last]]
                        kinds = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in kinds], names=[k for k, _ in kinds])

    return run


def read(folder: str, selected: DataFrame) -> DataFrame:
    """The records of the ``selected`` index rows, read by coalesced ranges."""
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # By bytes of the archives, which the small index says nothing of; small archives are shared out too.
    tasks = max(1, -(-size // STRETCH), min(selected.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    step = min(STRETCH, max(1 << 20, size // tasks))
    dealt = selected.select("file", "offset", "length").repartition(tasks, F.col("file"), F.floor(F.col("offset") / step)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(folder), RECORD)
